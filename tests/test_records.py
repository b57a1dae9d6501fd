"""Records, symbols and text functions without SQL, on fixtures."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import records as R
from tesserae.operators.graph import import_issues, resolved_imports
from tesserae.operators.symbols import declared_symbols, references_of


def test_upsert_and_sequence(spark, ways):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9, "x"), (None, 8, "x"), ("c", 7, "x")], "k string, v int, c string")
    got = {tuple(r) for r in R.upserted(old, new, ["k"], spark.createDataFrame([("a",)], "k string")).collect()}
    assert got == {("b", 9), (None, 8), ("c", 7)} and R.upserted(old.filter("false"), new, ["k"]).count() == 3
    stored = spark.createDataFrame([("a", 0, "é"), ("a", 4, "x")], "artifact_id string, seq int, text string")
    add = spark.createDataFrame([("a", 0, "o", "password=abc"), ("a", 1, "o", "z" * 70_000), ("a", 2, "o", "late"), ("b", 0, "o", "new"), ("b", 1, "o", None)], "artifact_id string, ordinal int, stream string, text string")
    out = sorted((r["artifact_id"], r["seq"], len(r["text"])) for r in R.appended_chunks(stored, add, 65_600).collect())
    assert out == [("a", 5, 19), ("a", 6, 65_536), ("b", 0, 3)]


def test_packages_and_evidence(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), f"p{i:03}", datetime(2026, 1, 1 + i % 20), [f"e{r.randrange(40)}" for _ in range(r.randrange(6))] if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "repository_id string, package_id string, created_at timestamp, evidence array<string>")
    got = {(x["repository_id"], x["package_id"]) for x in R.kept_packages(df, 20, 15).filter("kept").collect()}
    want = set()
    for repo in "ab":
        held = set()
        for x in sorted((x for x in rows if x[0] == repo), key=lambda x: (x[2], x[1]), reverse=True)[:20]:
            if len(held | set(x[3] or [])) <= 15:
                held |= set(x[3] or [])
                want.add((repo, x[1]))
    assert got == want and R.kept_packages(df.filter("false")).count() == 0
    ev = spark.createDataFrame([("e1",), ("zz",)], "evidence_id string")
    assert [x[0] for x in R.unreferenced(ev, spark.createDataFrame([(["e1", "e2"],)], "refs array<string>"), "evidence_id", "refs").collect()] == ["zz"]
    rules = spark.createDataFrame([(["a"], 5), ([], 5), (None, 5), (["a", "a"], 5), (["a"], 9_999_999), ([str(i) for i in range(51)], 1)], "refs array<string>, size long")
    assert [x["why_not"] for x in R.evidence_rules(rules, "refs", "size").collect()] == [None, "no_references", "no_references", "repeated_reference", "too_large", "too_many_references"]


def test_admission_and_chains(spark, ways):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice([1, 5, 9])) for i in range(60)]
    got = {x["i"]: x["admitted"] for x in R.admitted(spark.createDataFrame(rows, "k string, i int, c int"), ["k"], [F.col("i")], F.col("c"), 40, 9).collect()}
    for k in "ab":
        used = n = 0
        open_ = True
        for _, i, c in (x for x in rows if x[0] == k):
            open_ = open_ and used + c <= 40 and n < 9
            used, n = used + c, n + 1
            assert got[i] is open_
    null = spark.createDataFrame([("a", 1, 1), ("a", 2, None), ("a", 3, 1)], "k string, i int, c int")
    assert [x["admitted"] for x in R.admitted(null, ["k"], [F.col("i")], F.col("c"), 40).orderBy("i").collect()] == [True, False, False]
    with pytest.raises(Exception, match="more than once"):
        R.without_duplicates(null.select(F.lit(1).alias("q")), ["q"]).collect()
    assert R.without_duplicates(null, ["i"]).count() == 3
    two = spark.createDataFrame([("a",), ("b",)], "repository_id string")
    assert R.of_one_repository(two.filter("repository_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="several repositories"):
        R.of_one_repository(two).collect()


def test_sessions_pages_and_raw(spark):
    s = spark.createDataFrame([("s1", "x", "active", 1), ("s2", "x", "active", 2), ("s3", "y", "closed", 3)], "session_id string, external_id string, session_status string, created_at int")
    got = {r["external_id"]: r for r in R.sessions_of(spark.createDataFrame([("x",), ("y",), ("y",)], "external_id string"), s).collect()}
    assert got["x"]["session_id"] == "s2" and not got["x"]["created"] and got["y"]["created"] and got["y"]["session_id"].startswith("session_")
    f = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, None)], "id int, file_content string")
    pages = R.source_page(f, 1, 2, F.when(F.col("id") == 1, F.sha2(F.lit("a\nb\nc\nd"), 256))).orderBy("id").collect()
    assert [(p["stale"], p["page"], p["next_offset"]) for p in pages] == [(False, "b\nc", 3), (True, None, None), (True, None, None)]
    raw = spark.createDataFrame([(bytearray(b"abcdef"), 4), (bytearray(b"ab"), 9), (bytearray(b"ab"), -3)], "d binary, room int")
    assert [(bytes(r["d"]), r["complete"]) for r in R.raw_appended(raw, "d", F.col("room"), F.lit(100)).collect()] == [(b"abcd", False), (b"ab", True), (b"", False)]


def test_text_functions(spark):
    texts = ["", None, "x" * 400, "🙂" * 200, "a" + "🙂" * 200, "y" * 299 + "🙂", "password=hunter22"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.text_value(F.col("t"))).collect()]
    assert got == [None, None, "x" * 300, "🙂" * 150, "a" + "🙂" * 149, "y" * 299, "password=[REDACTED]"]
    one = lambda c: spark.range(1).select(c).first()[0]
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    assert tuple(one(X.stamped(F.lit("2026-01-01T00:00:00Z"), at))) == (datetime(2026, 1, 1), "client") and one(X.stamped(F.lit("soon"), at))["source"] == "observed"
    assert one(X.within(F.lit("a/b/"), F.lit("a/b/c"))) and not one(X.within(F.lit("a/b"), F.lit("a/bc")))
    assert one(X.in_event_session(F.lit('{"session_id":"s"}'), F.lit("s"))) and one(X.in_event_session(F.lit('{"sessionId":"s"}'), F.lit("s"))) and not one(X.in_event_session(F.lit("x"), F.lit("s")))
    assert [one(X.lifecycle_step(F.lit(e))) for e in ("SessionStart", "PreCompact", "PostCompact", "SessionEnd", "Stop")] == ["open", "checkpoint", "checkpoint", "close", None]
    sig = lambda e, t: one(X.error_signature(F.lit("failure"), F.lit(e), F.lit(False), F.lit(False), F.lit(t)))
    assert sig(0, "a") is None and sig(1, "a\n\na") == sig(1, "a") != sig(2, "a")
    assert [one(X.wrapper_exit_code(F.lit(c), F.lit(t), F.lit(x), F.lit(i), F.lit(s))) for c, t, x, i, s in ((0, True, True, True, False), (0, True, True, False, True), (3, False, True, False, False), (None, False, False, False, True), (None, False, False, False, False), (7, False, False, None, None))] == [125, 124, 130, 128, 1, 7]
    assert one(X.formatted_bytes(F.lit(1536))) == "1.5 KiB" and one(X.formatted_bytes(F.lit(12))) == "12 B" and one(X.formatted_share(F.lit(1), F.lit(0))) is None


def test_symbols_and_references(spark):
    code = "export default class A {\n}\n  function inner() {}\nexport async function b() {}\nconst c = 1\ntype D = 1\nimport x from './x'\nawait import('./lazy')\nconst m = require(name)\nconst n = require(\"./n\")\n"
    files = spark.createDataFrame([(1, "r", "src/a.ts", code), (2, "r", "src/x.ts", None)], "file_id long, repository_id string, file_path string, file_content string")
    got = {(r["symbol_name"], r["symbol_kind"], r["exported"]) for r in declared_symbols(files).collect()}
    assert {("A", "class", True), ("b", "function", True), ("c", "const", False), ("D", "type", False)} <= got and not any(n == "inner" for n, *_ in got)
    refs = {(r["specifier"], r["dynamic"], r["confidence"]) for r in references_of(files).collect()}
    assert refs == {("./x", False, "exact"), ("./lazy", True, "literal"), ("<unresolved>", True, "unresolved"), ("./n", True, "literal")}


def test_every_outcome_of_an_import(spark):
    have = ["src/a.ts", "src/b.ts", "src/b.js", "src/c.tsx", "src/d/index.ts", "src/e.ts", "src/e.tsx", "src/f.js", "src/f.ts", "lib/g.mts"]
    said = {"./b": "ambiguous", "./c": "ok", "./d": "ok", "./e": "ambiguous", "./f.js": "ok", "../lib/g.mjs": "ok", "./c.js": "ok", "./none": "unresolved", "../../out": "outside_repository", "./q?raw": "unsupported_specifier"}
    code = "\n".join(f"import x from '{s}'" for s in [*said, "react"])
    files = spark.createDataFrame([("r", p, code if p == "src/a.ts" else "", False) for p in have], "repository_id string, file_path string, file_content string, is_test boolean")
    got = {x["specifier"]: (x["outcome"], x["target"]) for x in resolved_imports(files).collect()}
    assert {k: v[0] for k, v in got.items()} == said
    assert got["./f.js"][1] == "src/f.js" and got["./c.js"][1] == "src/c.tsx" and got["./d"][1] == "src/d/index.ts" and got["../lib/g.mjs"][1] == "lib/g.mts"
    report = import_issues(resolved_imports(files), 3).first()
    assert len(report["issues"]) == 3 and report["omitted"] == 2
