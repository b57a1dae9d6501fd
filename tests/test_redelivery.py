"""Problem 1 against a union-find, with nulls, spellings, chains, hot keys, empty tables and clashing columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators.components import components
from tesserae.operators.redelivery import delivery_changes, redundant_deliveries, unique_deliveries

SCHEMA = "delivery_id long, repository_id string, event_id string, correlation_id string, delivered_at timestamp, u string, m string, p string, k string, n long, total string"


def hexid(i):
    return f"{i:064x}"


def brute(rows):
    import re

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, repo, e, c, *_ in rows:
        if repo is None:
            continue
        if e and (m := re.search("[0-9a-f]{64}", e.lower())):
            parent[find(("d", d))] = find((repo, "e", m[0]))
        if c and re.search("[0-9a-f]{64}", c.lower()):
            parent[find(("d", d))] = find((repo, "c", re.sub(r"\s", "", c.lower())))
    groups = {}
    for r in rows:
        groups.setdefault(find(("d", r[0])), []).append((r[4] is None, r[4] or datetime.min, r[0]))
    return {x[2] for g in groups.values() for x in g if x != min(g)}


def made(seed, n, ids):
    r = random.Random(seed)
    t0 = datetime(2026, 1, 1)

    def spelled(x):
        return r.choice([x, x.upper(), "sha256:" + x, " " + x, x + "\n"])

    rows = []
    for d in range(n):
        e = r.choice([None, "", "n/a", *[spelled(hexid(r.randrange(ids))) for _ in range(5)]])
        c = r.choice([None, "-", *["claude-request:" + hexid(r.randrange(ids)) for _ in range(3)], *[f"codex-turn:{hexid(r.randrange(ids))}:{r.randrange(2)}" + r.choice(["", " "]) for _ in range(3)]])
        rows.append((d, r.choice(["a", "a", "b", None]), e, c, r.choice([None, t0 + timedelta(seconds=r.randrange(50))]), "x", "y", "z", "q", 1, "w"))
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_against_union_find(spark, hot_rows):
    rows = made(1, 400, 120)
    got = {r[0] for r in redundant_deliveries(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows).collect()}
    assert got == brute(rows)


def test_one_identifier_holds_most_rows(spark):
    rows = [(d, "a", hexid(7), "claude-request:" + hexid(1000 + d), datetime(2026, 1, 1), "", "", "", "", 0, "") for d in range(200)] + made(2, 100, 500)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = {r[0] for r in redundant_deliveries(spark.createDataFrame(rows, SCHEMA), hot_rows=20).collect()}
    assert got == brute(rows) and len(got) >= 199


def test_stored_rows_count_and_kept_rows_are_whole(spark):
    new = spark.createDataFrame([(2, "a", hexid(1), None, datetime(2026, 1, 2), "", "", "", "", 0, "")], SCHEMA)
    old = spark.createDataFrame([(1, "a", hexid(1).upper(), None, datetime(2026, 1, 1), "", "", "", "", 0, "")], SCHEMA)
    assert [r[0] for r in redundant_deliveries(new, old).collect()] == [2]
    assert unique_deliveries(old).columns[0] == "delivery_id" and set(unique_deliveries(old).columns) == set(old.columns)


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_kept_rows_and_changes(spark, hot_rows):
    rows = made(3, 300, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    gone = brute(rows)
    kept = unique_deliveries(df, hot_rows=hot_rows)
    assert kept.columns == df.columns and sorted((tuple(r) for r in kept.collect()), key=repr) == sorted((r for r in rows if r[0] not in gone), key=repr)
    got = {(r[0], r[1]) for r in delivery_changes(df.filter("delivery_id % 3 = 0"), df.filter("delivery_id % 3 <> 0"), hot_rows).collect()}
    assert got == {(r[0], "add") for r in rows if r[0] % 3 == 0 and r[0] not in gone} | {(d, "retract") for d in gone if d % 3}


def test_a_stored_copy_that_is_later_is_retracted(spark):
    new = spark.createDataFrame([(2, "a", hexid(1), None, datetime(2026, 1, 1), "", "", "", "", 0, "")], SCHEMA)
    old = spark.createDataFrame([(-1, "a", hexid(1), None, datetime(2026, 1, 2), "", "", "", "", 0, ""), (3, "a", hexid(1), None, None, "", "", "", "", 0, "")], SCHEMA)
    assert {tuple(r) for r in delivery_changes(new, old).collect()} == {(2, "add"), (-1, "retract"), (3, "retract")}
    assert [r["delivery_id"] for r in unique_deliveries(new, old).collect()] == [2] and unique_deliveries(old, new).count() == 0
    assert delivery_changes(new.filter("false"), new.filter("false")).count() == 0


def test_empty(spark):
    assert redundant_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert [tuple(r) for r in components(chain).groupBy("component").count().collect()] == [(0, 201)]
    assert components(chain.filter("false")).count() == 0
