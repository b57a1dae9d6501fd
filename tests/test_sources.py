"""Scan of a tree, assembly of a package, token goldens, the stateful stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions.tokens import encoding, resolved_encoding
from tesserae.operators.context import packages, tokens_with_own_number
from tesserae.plans import streams
from tesserae.sources.files import fingerprint, scan_tree, write_versioned
from tesserae.streaming.redaction import first_deliveries, redacted_stream, run_once, windowed_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_scan_and_limits(spark, tmp_path, ways):
    root = tmp_path / "tree"
    for name, data in {"a.ts": b"let a", "b/c.py": b"x = 1\n" * 3, ".env": b"K=1", "node_modules/x.js": b"1", "d.bin": b"1", "e.md": b"\x00", "f.md": b"\xff\xfe", "g.md": b"z" * 400, "ig.ts": b"1", "Makefile": b"all:", "src/keep.ts": b"2"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["path"]: r["skipped"] for r in scan_tree(spark, str(root), max_file_bytes=300, ignore=["ig.*", "src", "!src/keep.ts", "!.env"]).collect()}
    assert got == {".env": "sensitive", "a.ts": None, "b/c.py": None, "node_modules/x.js": "sensitive", "d.bin": "unsupported", "e.md": "binary", "f.md": "not_utf8", "g.md": "too_large", "ig.ts": "ignored", "Makefile": None, "src/keep.ts": None}
    small = {r["path"]: r["skipped"] for r in scan_tree(spark, str(root), max_total_bytes=10, max_files=4).collect()}
    assert small["Makefile"] is None and small["a.ts"] is None and small["b/c.py"] == "total_limit" and "file_limit" in small.values()
    rows = scan_tree(spark, str(root)).filter("skipped is null")
    assert len(fingerprint(rows).first()["fingerprint"]) == 64
    out = write_versioned(rows.select("path", "hash"), str(tmp_path / "t"), "1")
    assert spark.read.parquet(out).count() == rows.count()
    with pytest.raises(Exception, match="exist"):
        write_versioned(rows.select("path"), str(tmp_path / "t"), "1")


def test_names_ignore_files_and_links(spark, tmp_path):
    root = tmp_path / "tree"
    files = {
        "__tests__/a.ts": "1", "src/__init__.py": "1", "src/_app.tsx": "1", ".eslintrc.json": "{}", "src/b.ts": "1", ".gitignore": "*.log.ts\n/gen/\n# note\n\ndeep/**/x.ts\n", "a.log.ts": "1", "gen/c.ts": "1",
        "sub/gen/c.ts": "1", "sub/.gitignore": "!keep.log.ts\n*.py\nmade/\n", "sub/keep.log.ts": "1", "sub/other.log.ts": "1", "sub/z.py": "1", "z.py": "1", "deep/1/2/x.ts": "1", "deep/1/y.ts": "1", "sub/made/q.ts": "1", "sub/made.ts": "1",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "outside.ts").write_text("secret")
    os.symlink(tmp_path / "outside.ts", root / "link.ts")
    os.symlink(tmp_path, root / "loop")
    got = {r["path"]: r["skipped"] for r in scan_tree(spark, str(root)).collect()}
    out = {"a.log.ts", "gen/c.ts", "sub/other.log.ts", "sub/z.py", "deep/1/2/x.ts", "sub/made/q.ts"}
    assert {p for p, why in got.items() if why == "ignored"} == out and {p for p, why in got.items() if why == "link"} == {"link.ts", "loop"}
    assert {p for p, why in got.items() if why is None} == set(files) - out - {".gitignore", "sub/.gitignore"} and set(got) == set(files) | {"link.ts", "loop"}
    (tmp_path / "empty").mkdir()
    assert scan_tree(spark, str(tmp_path / "empty")).count() == 0


def test_packages_stay_in_their_budgets(spark, ways):
    """Against the pass itself: add one after the other and measure, take the last optional ones away, then notes."""
    r = random.Random(2)
    schema = "task_id string, evidence_id string, path string, start_line long, code string, mandatory boolean, score double"
    rows, budgets = [], []
    for t in range(24):
        n = [0, 3, 12, 40][t % 4]
        rows += [(f"t{t}", f"e{i}", f"t{r.randrange(20):02}.ts", i, "é" * r.choice([0, 5, 80, 200, 900]) or None, r.random() < 0.08, float(r.randrange(30))) for i in range(n)]
        budgets.append((f"t{t}", 'a "task"', r.choice([60, 400, 1500, 5000])))
    got = {x["task_id"]: x for x in packages(spark.createDataFrame(rows, schema), spark.createDataFrame(budgets, "task_id string, task string, budget long")).collect()}
    assert set(got) == {b[0] for b in budgets}
    names = ["evidence_id", "path", "start_line", "code", "mandatory", "score"]
    for task, _, budget in budgets:
        mine = [dict(zip(names, (x[1], x[2], x[3], x[4] or "", x[5], x[6]))) for x in rows if x[0] == task]
        p = got[task]
        tokens = lambda x: -(-len(x.encode()) // 2)
        assert p["tokens"] == tokens(p["package"]) and json.loads(p["package"])["tokens"] == p["tokens"]
        assert (p["status"] == "ready") == (p["tokens"] <= budget)
        must = {x["evidence_id"] for x in mine if x["mandatory"]}
        shown = {x["evidence_id"] for x in p["sources"]}
        assert must <= shown and len(shown) == len(p["sources"]) and p["omitted_count"] == len(mine) - len(shown) and len(p["omitted"]) <= 20
        assert not {x["evidence_id"] for x in p["omitted"]} & shown
        if p["status"] == "budget_exceeded":
            assert shown == must and not p["omitted"]
        order = sorted(mine, key=lambda x: (not x["mandatory"], -x["score"] / max(1, tokens(x["code"])), x["path"], x["start_line"]))
        assert [x["evidence_id"] for x in p["sources"]] == [x["evidence_id"] for x in order if x["evidence_id"] in shown]
        # nothing that was left out would still fit beside its sources without any note
        bare = len(json.dumps({"purpose": 'a "task"', "status": "ready", "budget": budget, "tokens": 10**5, "sources": [dict(zip(names, s)) for s in p["sources"]], "omitted": [], "omitted_count": 99}, ensure_ascii=False, separators=(",", ":")).encode())
        notes = sum(len(json.dumps({"path": x["path"], "evidence_id": x["evidence_id"]}, separators=(",", ":"))) + 1 for x in order[:20])
        for x in order:
            if x["evidence_id"] not in shown:
                assert bare + len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()) + notes > 2 * budget - 40
    assert [spark.range(1).select(tokens_with_own_number(F.lit(n))).first()[0] for n in (0, 1, 17, 18, 196, 197)] == [1, 1, 9, 10, 99, 100]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    e = encoding(VOCABULARY)
    assert e.decode(e.encode_ordinary("Grüße, <|endoftext|> 你好")) == "Grüße, <|endoftext|> 你好" and e.encode_ordinary("") == []
    df = spark.createDataFrame([("a", None), ("z", None), (None, "narrow")], "m string, e string")
    got = [tuple(r["r"]) for r in df.select(resolved_encoding(F.col("m"), F.col("e"), {"a": "wide"}).alias("r")).collect()]
    assert got == [("wide", "verified"), (None, "unknown"), ("narrow", "unspecified")]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("a", "narrow")], "m string, e string").select(resolved_encoding(F.col("m"), F.col("e"), {"a": "wide"})).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "stdout", 0, "authorization: Bearer sk-this-is-a-"), ("a", "stdout", 1, "long-secret\nok\n"), ("b", "stdout", 0, "-----BEGIN PRIVATE KEY-----\nabc"), ("b", "stdout", 1, "\n-----END PRIVATE KEY-----\nend\n")]
    df = spark.createDataFrame(rows, "artifact_id string, stream string, seq int, chunk_text string")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    text = "".join(r["text"] for r in run_once(redacted_stream(stream), "redacted", str(tmp_path / "c1")).orderBy("artifact_id", "seq").collect())
    assert "long-secret" not in text and "abc" not in text and "ok\n" in text and text.endswith("end\n")
    assert run_once(first_deliveries(spark.readStream.schema(df.schema).parquet(src), ["artifact_id"]), "firsts", str(tmp_path / "c2")).count() == 2
    ev = spark.createDataFrame([("2026-01-01 01:00:00", "x"), ("2026-01-01 02:00:00", "x"), ("2026-01-09 02:00:00", "x")], "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    ev.write.parquet(str(tmp_path / "ev"))
    w = run_once(windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "t", "k"), "windows", str(tmp_path / "c3"), "complete")
    assert sorted(r["n"] for r in w.collect()) == [1, 2]


def test_stream_rows_stay_off_the_driver(spark, tmp_path):
    """stream_dedup with a limit for what the driver may get, far below the rows that the stream gives; tables without any row for it."""
    ids = spark.range(60_000).select(F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("correlation_id"), F.sha2((F.col("id") % 10_000).cast("string"), 256).alias("repository_id"))
    ids.write.parquet(str(tmp_path / "much/usage_deliveries.parquet"))
    ids.limit(3).withColumn("correlation_id", F.lit(None).cast("string")).write.parquet(str(tmp_path / "nulls/usage_deliveries.parquet"))
    ids.limit(0).write.parquet(str(tmp_path / "empty/usage_deliveries.parquet"))
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "600k")
    try:
        got = [streams.stream_dedup(spark, str(tmp_path / x)).agg(F.count("*"), F.min("events"), F.max("events")).first() for x in ("much", "nulls", "empty")]
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert [tuple(x) for x in got] == [(10_000, 2, 2), (0, None, None), (0, None, None)]
