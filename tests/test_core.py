"""Core operators on small fixtures."""

import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import redaction as X
from tesserae.functions.text import compact_json, csv_cell, estimated_tokens, is_indexed_sensitive, normalized_path, task_words, words
from tesserae.operators import graph, lines, reduce, search, snapshots, stats, store, usage
from tesserae.operators.running import greedy_fill, running_max, running_sum
from tesserae.plans import evidence
from tesserae.sources import telemetry as M
from tesserae.streaming.redaction import WITHHELD, StreamRedactor


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


# --- text and redaction


def test_words_and_sizes(spark):
    assert one(spark, "Fix parseHTTPToken2 in the_index for café", words) == ["parse", "httptoken", "in", "index", "café"]
    assert one(spark, "open entry.ts", task_words) == ["open", "entry"]
    assert one(spark, "你好🙂", estimated_tokens) == 4 and one(spark, None, words) is None


def test_paths(spark):
    assert one(spark, "./a\\b.ts", normalized_path) == "a/b.ts"
    assert one(spark, "a/../b", normalized_path) is None and one(spark, "/a", normalized_path) is None and one(spark, "C:\\a", normalized_path) is None
    assert one(spark, "src/.env.local", is_indexed_sensitive) and not one(spark, "src/env.ts", is_indexed_sensitive)


def test_json_and_csv(spark):
    text = '{ "id": 90071992547409931234, "id": -0, "escaped": "a \\" b", "space": " a  b " }'
    want = '{"id":90071992547409931234,"id":-0,"escaped":"a \\" b","space":" a  b "}'
    assert one(spark, text, compact_json) == want
    assert one(spark, '=HYPERLINK("evil")', csv_cell).startswith("\"'")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password="a secret with spaces"', 'password="[REDACTED]"'),
        ('{"password":"secret value","ok":true}', '{"password":"[REDACTED]","ok":true}'),
        ("src/token.ts:4 function accessTokenCount()", "src/token.ts:4 function accessTokenCount()"),
        ("authorization: Bearer abc.def", "authorization: Bearer [REDACTED]"),
        ("https://u:p@host/x", "https://[REDACTED]@host/x"),
        (None, None),
    ],
)
def test_redact(text, want):
    assert X.redact_text(text) == want


def test_redact_long_and_nested():
    assert X.redact_text('secret = "' + "x" * 200_000 + '"') == 'secret = "[REDACTED]"'
    assert X.sanitize_json('{"apiKey": "very-secret", "nested": ["password=secret"], "cookie": [ "kept" ], "n": 1.50, "n": 1e2}') == '{"apiKey":"[REDACTED]","nested":["password=[REDACTED]"],"cookie":["kept"],"n":1.50,"n":1e2}'
    assert X.sanitize_json('"a \\u00e9"') == '"a é"' and X.sanitize_json("[" * 5000 + "]" * 5000) == "[" * 5000 + "]" * 5000
    assert X.strict_json('{"a":1} x') is None and X.strict_json("[NaN]") is None and X.strict_json('{"a":1,"a":2}') == {"a": 2}


@given(st.text(alphabet="a€🙂\n", max_size=200), st.integers(4, 9))
@settings(max_examples=60, deadline=None)
def test_split_utf8(text, most):
    parts = X.utf8_pieces(text, most)
    assert "".join(parts) == text and all(len(p.encode()) <= most for p in parts)


def test_redacted_args(spark):
    """Against a pass over the arguments with one element of memory."""
    r = random.Random(6)
    rows = [[r.choice(["--token", "--secret", "v", "--api-key=w", "--cwd", "password=x1", None]) for _ in range(r.randrange(8))] for _ in range(200)] + [None]
    flag = lambda a: a is not None and X.SENSITIVE_FLAG.search(a)

    def want(args):
        out, hide = [], False
        for a in args:
            bare = not hide and flag(a) and "=" not in a
            out.append("[REDACTED ARGUMENT]" if hide else a[: a.index("=") + 1] + "[REDACTED ARGUMENT]" if flag(a) and "=" in a else X.redact_text(a))
            hide = bare
        return out

    got = spark.createDataFrame([(x,) for x in rows], "a array<string>").select(X.redacted_args(F.col("a")).alias("a")).collect()
    assert [g["a"] for g in got] == [None if x is None else want(x) for x in rows]
    assert spark.createDataFrame([("a€" * 40_000,)], "t string").select(F.array_join(X.split_utf8(F.col("t")), "") == F.col("t")).first()[0]


def test_stream_redactor():
    r = StreamRedactor()
    assert r.feed(b"authorization: Bearer sk-this-is-a-") == []
    assert "long-secret" not in "".join(r.feed(b"long-secret\n"))
    out = "".join(r.feed(b"-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\nok\n"))
    assert "abc" not in out and out.endswith("ok\n")
    euro = "€\n".encode()
    assert r.feed(euro[:2]) == [] and r.feed(euro[2:]) == ["€\n"]
    r = StreamRedactor(max_line=20)
    assert r.feed(b"a" * 100) == [WITHHELD + "\n"] and r.feed(b"tail\nok\n") == ["ok\n"]
    r = StreamRedactor(max_line=20)
    assert r.feed(b"-----BEGIN PRIVATE KEY-----\n" + b"k" * 50 + b"\n-----END PRIVATE KEY-----x\nA -----BEGIN PRIVATE KEY----- b -----END PRIVATE KEY-----\nfree\n") == ["[REDACTED PRIVATE KEY]\n", "[REDACTED PRIVATE KEY]\n", "free\n"]
    whole, r = b"one\n\xe2\x82\xac two\npassword=abc\nrest", StreamRedactor()
    cut_up = []
    for i in range(len(whole)):
        r = StreamRedactor(state=r.state)
        cut_up += r.feed(whole[i : i + 1])
    assert cut_up + r.end() == StreamRedactor().feed(whole, True) == ["one\n", "€ two\n", "password=[REDACTED]\n", "rest"]
    r = StreamRedactor()
    assert r.feed(b"first\r\nlast") == ["first\r\n"] and r.end() == ["last"]


# --- reduction


def outputs(spark, *texts, artifact=None, exit_code=None, **k):
    rows = [(i, t, artifact, exit_code, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, t string, a string, e int, output string")
    return sorted(reduce.reduced_outputs(df, "i", "t", artifact="a", exit_code="e", **k).collect(), key=lambda r: r["i"])


def test_reduction_goldens(spark):
    diff = "diff --git a/x b/x\nindex 0123456..89abcde 100644\n@@ -1 +1 @@\n-old\n+new\n" * 10
    texts = [
        "x\nx", "\n".join(["request 28 failed with actual 503 again"] * 7 + ["request 29"]), "FAIL src/a.test.ts\n✓ sensitive result 10ms\n\n\nTests: 2 failed",
        "C:\\repo\\a.ts:1:2:one\nC:\\repo\\a.ts:3:4:two\nC:\\repo\\a.ts:5:6:three", diff, "", None, '{ "id": 90071992547409931234, "id": -0, "escaped": "a \\" b", "space": " a  b " }',
    ]
    same, log, tests, hits, patch, empty, null, js = outputs(spark, *texts)
    assert same["reason"] == "no_gain" and same["output"] == "x\nx"
    assert log["reducer_id"] == "logs" and "7 occurrences" in log["output"] and "request 29" in log["output"]
    assert "✓ sensitive result 10ms" in tests["output"] and tests["reducer_id"] == "jest"
    assert hits["reducer_id"] == "search" and hits["output"].count("C:\\repo\\a.ts") == 1 and hits["output"].endswith("  5:6:three")
    assert patch["output"] == diff and patch["reason"] == "no_gain" and empty["reason"] == null["reason"] == "unknown_format"
    assert js["output"] == '{"id":90071992547409931234,"id":-0,"escaped":"a \\" b","space":" a  b "}'
    with_id = outputs(spark, diff, artifact="a", exit_code=0)[0]
    assert "NOT AN APPLYABLE PATCH" in with_id["output"] and with_id["output"].count("+new") == 10 and with_id["status"] == "success"
    assert outputs(spark, "future format; failure details", format="vitest")[0]["reason"] == "unknown_format"
    seen = outputs(spark, "request 1 failed: actual 503\n" * 9, mode="observe")[0]
    assert seen["reason"] == "observe_only" and seen["status"] == "unknown" and not seen["applied"]
    assert outputs(spark, "x\nx" * 9, consumer="machine")[0]["reason"].startswith("machine") and outputs(spark, "[seen]\nxx\nxx", marker="[seen]")[0]["reason"] == "already_reduced"
    assert [r["original_bytes"] for r in outputs(spark, "你好🙂")] == [10] and outputs(spark, "你好🙂")[0]["original_tokens"] == 4


def test_replay_cases_reach_the_published_sizes(spark):
    cases = reduce.replay_cases()
    df = spark.createDataFrame([(i, f, t, e, "replay:" + i) for i, f, t, e, _ in cases], "id string, format string, text string, e int, a string")
    got = {r["id"]: r for r in reduce.reduced_outputs(df, "id", "text", format="format", exit_code="e", artifact="a").collect()}
    assert sum(r["original_bytes"] for r in got.values()) == 22_881 and sum(r["reduced_bytes"] for r in got.values()) == 3_695
    assert all(r["valid"] and all(x in r["output"] for x in must) for i, _, _, _, must in cases for r in [got[i]])


def test_a_faulty_form_is_rejected(spark):
    text = "first line of evidence\nsecond line of evidence"
    good = {f.id: f for f in reduce.FORMATS}
    for held in ("tsc", "search", "logs", "json", "vitest"):
        bad = reduce.Format(held, lambda t: F.lit(True), lambda t: F.lit("lost"), good[held].holds)
        r = outputs(spark, text, formats=[bad])[0]
        assert r["reason"] == "preservation_failed" and r["output"] == text and not r["valid"]
    # hits under another path, a wrong number of repeats, a failing line dropped
    wrong = {"search": ("a:1:x\nb:2:y", "a\n  2:y\nb\n  1:x"), "logs": ("m\nm\nm", "m\n" + reduce.REPEATED_TEXT % 2), "vitest": ("FAIL a\nPASS b.ts\nPASS c.ts", "2 successful test/suite lines grouped.\nFAIL a")}
    for held, (given_text, out) in wrong.items():
        bad = reduce.Format(held, lambda t: F.lit(True), lambda t, out=out: F.lit(out), good[held].holds)
        assert outputs(spark, given_text, formats=[bad])[0]["reason"] == "preservation_failed", held


def test_reduction_loses_nothing(spark):
    """Runs of lines and hits by path come back as they were, whatever they are."""
    r = random.Random(3)
    logs = ["\n".join(r.choice(["a", "b", "", "long line", reduce.REPEATED_TEXT % 3]) for _ in range(r.randrange(1, 30))) for _ in range(200)]
    hits = ["\n".join(f"{r.choice(['a.ts', 'b/c.ts', 'C:/d'])}:{r.randrange(9)}:{r.choice(['', '3:'])}{r.choice(['x', ' y', ':z'])}" for _ in range(r.randrange(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(a, b) for a, b in zip(logs, hits)], "a string, b string").select(reduce.lines_of(F.col("a")).alias("a"), reduce.lines_of(F.col("b")).alias("b"))
    back = df.cache().select("a", reduce.expanded_lines(reduce.collapsed_runs(F.col("a"))).alias("x"), F.array_sort("b").alias("b"), F.array_sort(reduce.hits_again(reduce.hits_by_path(F.col("b")))).alias("y")).collect()
    marks = reduce.REPEATED_TEXT % 3
    assert all(q["b"] == q["y"] for q in back) and all(q["a"] == q["x"] for q in back if marks not in q["a"])
    assert all(q["a"] == q["x"] or marks in q["a"] for q in back)  # a text that holds such a mark itself is caught by the check


# --- ordered selections


def test_running_sum_and_greedy(spark, ways):
    r = random.Random(3)
    rows = [("g" if r.random() < 0.7 else None, i, r.choice([None, 1, 5, 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, place long, v long")
    want, acc = {}, {}
    for k, i, v in rows:
        acc[k] = acc.get(k, 0) + (v or 0)
        want[i] = acc[k]
    assert {x["place"]: x["upto"] for x in running_sum(df, ["k"], "place", [], F.col("v"), block=16).collect()} == want
    most, acc = {}, {}
    for k, i, v in rows:
        acc[k] = v if acc.get(k) is None else acc[k] if v is None else max(acc[k], v)
        most[i] = acc[k]
    assert {x["place"]: x["most"] for x in running_max(df, ["k"], "place", [], F.col("v"), block=16).collect()} == most
    items = [(k or "h", i, v) for k, i, v in rows]
    got = {x["place"] for x in greedy_fill(spark.createDataFrame(items, "k string, place long, v long"), ["k"], [F.col("place")], "v", F.lit(333), "place").collect()}
    take, left = set(), {"g": 333, "h": 333}
    for k, i, v in items:
        if v is not None and v <= left[k]:
            left[k] -= v
            take.add(i)
    assert got == take


def test_prune_equals_the_sequential_pass(spark, ways):
    r = random.Random(5)
    rows = [(i, r.randrange(1, 50), r.random() < 0.2) for i in range(120)]
    used, want = sum(x[1] for x in rows), set()
    for i, size, expired in rows:
        if expired or used > 900:
            want.add(i)
            used -= size
    df = spark.createDataFrame(rows, "place long, size long, expired boolean").withColumn("g", F.lit(1))
    assert {x["place"] for x in store.pruned_artifacts(df, ["g"], "place", [], F.col("size"), F.col("expired"), 900).filter("pruned").collect()} == want


def test_epochs_and_pages(spark, ways):
    e = spark.createDataFrame([("s", 1, "checkpoint"), ("s", 2, "close"), ("s", 3, "checkpoint"), ("s", 4, None)], "s string, t long, k string")
    got = store.session_epochs(e, "s", ["t"], F.col("k") == "checkpoint", F.col("k") == "close").orderBy("t").collect()
    assert [(x["epoch"], x["rejected"]) for x in got] == [(1, False), (2, False), (2, True), (2, True)]
    df = spark.range(7).select(F.lit("a").alias("k"), F.col("id"))
    page = lines.keyset_page(df, ["k"], "id", 2, 3).collect()
    assert sorted(x["id"] for x in page) == [2, 3, 4] and all(x["has_more"] for x in page)
    with pytest.raises(ValueError):
        lines.keyset_page(df, ["k"], "id", 0, 0)


# --- snapshots and graph


def test_snapshot_diff(spark, ways):
    s = "repository_id string, path string, hash string"
    old = spark.createDataFrame([("r", "a.ts", "1"), ("r", "gone.ts", "2"), ("r", "same", None), ("r", "m", "5")], s)
    new = spark.createDataFrame([("r", "renamed.ts", "1"), ("r", "new.ts", "3"), ("r", "same", None), ("r", "m", "6")], s)
    got = {(x["change"], x["path"], x["previous_path"]) for x in snapshots.diff(old, new).collect()}
    assert got == {("renamed", "renamed.ts", "a.ts"), ("deleted", "gone.ts", None), ("added", "new.ts", None), ("modified", "m", None)}
    assert snapshots.diff(old.filter("false"), new).filter("change <> 'added'").count() == 0


def test_graph(spark):
    f = spark.createDataFrame(
        [
            ("r", "src/entry.ts", "import { a } from './middle';\nimport x from 'lib';\nexport * from '../../out';\nimport './missing.js';"),
            ("r", "src/middle.ts", "import b from './leaf.js'"),
            ("r", "src/leaf.ts", "import a from './entry';\nimport e from './end';\nimport m from './mixed'"),
            ("r", "src/end.ts", ""), ("r", "src/mixed.ts", None), ("r", "src/mixed.js", ""),
        ],
        "repository_id string, file_path string, file_content string",
    )
    res = graph.resolved_imports(f)
    got = {(x["file_path"], x["specifier"]): (x["outcome"], x["target"]) for x in res.collect()}
    assert got[("src/entry.ts", "./middle")] == ("ok", "src/middle.ts") and got[("src/middle.ts", "./leaf.js")] == ("ok", "src/leaf.ts")
    assert got[("src/entry.ts", "../../out")][0] == "outside_repository" and got[("src/entry.ts", "./missing.js")][0] == "unresolved"
    assert got[("src/leaf.ts", "./mixed")][0] == "ambiguous" and len(got) == 7
    roots = spark.createDataFrame([("r", "src/entry.ts")], "repository_id string, file_path string")
    out = graph.expand(res.filter("outcome = 'ok'"), roots, 2)
    assert {(x["file_path"], x["depth"], x["root"]) for x in out.collect()} == {("src/middle.ts", 1, "src/entry.ts"), ("src/leaf.ts", 2, "src/entry.ts")}
    assert graph.expand(res.filter("outcome = 'ok'"), roots, 3, 1).count() == 1


# --- telemetry and usage


def kv(**a):
    return "[" + ",".join(f'{{"key":"{k}","value":{{"stringValue":"{v}"}}}}' for k, v in a.items()) + "]"


def test_log_export(spark):
    rec = f'{{"body":{{"stringValue":"x.api_request"}},"attributes":{kv(request_id="r", input_tokens=10, cache_read_tokens=80, cache_creation_tokens=20, output_tokens=5)}}}'
    part = f'{{"attributes":{kv(**{"event.name": "api_request", "request_id": "q", "input_tokens": 10, "output_tokens": 5})}}}'
    skip = f'{{"attributes":{kv(request_id="z")}}}'
    doc = f'{{"resourceLogs":[{{"resource":{{"attributes":{kv(model="m")}}},"scopeLogs":[{{"logRecords":[{rec},{part},{skip}]}}]}}]}}'
    got = {x["request_id"]: x for x in M.log_requests(spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "k int, j string"), "k", "j").collect()}
    assert got["r"]["total"] == 115 and got["q"]["total"] is None and got["q"]["cached"] is None and set(got) == {"r", "q"} and got["r"]["attributes"]["model"] == "m"


def test_metric_export_and_turns(spark):
    def doc(t):
        return f'{{"resourceMetrics":[{{"scopeMetrics":[{{"metrics":[{{"name":"n","sum":{{"aggregationTemporality":{t},"dataPoints":[{{"timeUnixNano":"1700000010000000001","asInt":"7"}}]}}}}]}}]}}]}}'

    df = spark.createDataFrame([(1, doc(2))], "k int, j string")
    assert M.metric_points(df, "k", "j", "n").select("temporality", "value").first()[:] == (2, 7)
    with pytest.raises(Exception, match="temporality"):
        M.metric_points(spark.createDataFrame([(1, doc(0))], "k int, j string"), "k", "j", "n").collect()
    turn = '{"type":"turn.completed","usage":{"input_tokens":100,"cached_input_tokens":80,"output_tokens":20,"reasoning_output_tokens":10}}'
    rows = spark.createDataFrame([(1, turn), (2, "  "), (3, '{"type":"x"}')], "k int, l string")
    assert [x["total"] for x in M.completed_turns(rows, "k", "l").collect()] == [120]
    with pytest.raises(Exception, match="whole"):
        M.completed_turns(spark.createDataFrame([(1, turn.replace("80", "180"))], "k int, l string"), "k", "l").collect()
    for bad in ("-1", "1.5", str(2**53)):
        with pytest.raises(Exception, match="exact number"):
            one(spark, bad, M.token_count)


USAGE = "ordinal long, repository_id string, event_id string, correlation_id string, session_id string, task_id string, event_time timestamp, usage_source string, usage_scope string, model_name string, input_tokens long, cached_input_tokens long, cache_write_tokens long, output_tokens long, reasoning_tokens long, total_tokens long, counter_kind string, agent_name string"


def event(o, corr, total, source="client_reported", kind="delta"):
    return (o, "r", f"e{o}", corr, None, None, datetime(2026, 1, 1, 0, 0, o), source, "s", None, None, None, None, None, None, total, kind, None)


def test_usage_coverage(spark):
    df = lambda *r: spark.createDataFrame(list(r), USAGE)
    group = lambda *r: usage.coverage_groups(df(*r)).first()
    assert group(event(1, "a", 15), event(2, "a", 15), event(3, "b", 5))["recorded_tokens"] == 20
    assert group(event(1, "a", 15), event(2, "b", None))["recorded_tokens"] is None
    g = group(event(1, "a", 2**53 - 1), event(2, "b", 1))
    assert g["total_overflow"] and g["recorded_tokens"] is None
    g = group(event(1, "a", None), event(2, "b", 2**53 - 1), event(3, "c", 1))
    assert not g["total_overflow"] and g["missing_total_records"] == 1
    stats_ = usage.deduplicated(df(event(1, "a", 15), event(2, "a", 16), event(3, None, 1), event(4, None, 1)))[1].first()
    assert (stats_["duplicate_records"], stats_["conflicting_correlations"], stats_["analyzed_records"]) == (0, 1, 2)
    assert usage.observed_total(df(event(1, "a", 15), event(2, "b", 77, "who knows")), "repository_id").first()["observed_total"] == 15
    merged = usage.merge_import(df(event(1, "a", 1)), df(event(2, "a", 1), event(3, "a", 2), event(4, "n", 1)))
    assert {x["ordinal"]: x["outcome"] for x in merged.collect()} == {2: "duplicate", 3: "conflict", 4: "new"}
    with pytest.raises(Exception, match="conflicts"):
        usage.reject_conflicts(merged).collect()
    assert usage.coverage_groups(df(event(1, "a", 1)).filter("false")).count() == 0


def test_series(spark):
    s = "usage_source string, counter_kind string, series_id string, dimension string, start_time timestamp, sample_time timestamp, value long, ordinal long"
    rows = [("c", "cumulative", "x", "input", None, datetime(2026, 1, 1, 0, i), v, i) for i, v in enumerate([100, 150, 20])]
    got = usage.series_summary(spark.createDataFrame(rows, s)).first()
    assert (got["samples"], got["last_value"], got["resets"], got["missing_starts"]) == (3, 20, 1, 3)


# --- statistics


def test_statistics(spark):
    assert stats.bootstrap_interval([-20.0, -20.0, -20.0]) == (-20.0, -20.0) and stats.bootstrap_interval([1.0]) is None
    plan = list(range(50))
    assert stats.seeded_shuffle(plan, 19) == stats.seeded_shuffle(plan, 19) != stats.seeded_shuffle(plan, 20)
    assert sorted(stats.seeded_shuffle(plan, 19)) == plan
    rows = [("native", "a", 1, True, 100, "p"), ("treated", "a", 1, True, 80, "p"), ("treated", "b", 1, False, None, "p")]
    df = spark.createDataFrame(rows, "condition string, task string, repeat int, success boolean, tokens long, token_source string")
    got = {x["condition"]: x for x in stats.condition_rollup(df, ["native", "treated", "none"]).collect()}
    assert got["native"]["tokens_per_success"] == 100 and got["treated"]["tokens"] is None and got["none"]["runs"] == 0 and got["none"]["success_rate"] is None
    assert stats.paired_differences(df, "treated", "native").first()["token_difference"] == -20


def test_bootstrap_of_all_tasks(spark, sf):
    assert list(stats.lcg_slice(42, 1000, 777)) == list(stats.lcg_states(42, 1777)[1000:])
    rng = random.Random(3)
    groups = {"a": [rng.uniform(-1, 1) for _ in range(50)], "b": [rng.choice([-1.0, 0.0, 0.5]) for _ in range(17)], "c": [0.25]}
    df = spark.createDataFrame([(g, i * 1000, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, _o long, v double")
    for block in (7, 2**21):
        got = {r["g"]: r for r in stats.bootstrap_by(df, "g", "v", block=block).collect()}
        for g, vs in groups.items():
            ends = stats.bootstrap_interval(vs) or (None, None)
            assert got[g]["n"] == len(vs) and got[g]["mean"] == pytest.approx(sum(vs) / len(vs)) and (got[g]["low"], got[g]["high"]) == (pytest.approx(ends) if len(vs) > 1 else ends)
    assert stats.bootstrap_by(df.filter("false"), "g", "v").count() == 0
    assert evidence.paired_bootstrap(spark, sf).first()["n"] == evidence.paired_differences(spark, sf).count()


def test_imports_and_related_tests_bring_points(spark):
    rows = [(1, "src/quota.ts", "import { a } from './ledger';", False), (2, "src/ledger.ts", "import { b } from './base';", False), (3, "src/base.ts", "", False), (4, "tests/ledger.test.ts", "", True), (5, "tests/my-quota.test.ts", "", True), (6, "src/other.ts", "", False)]
    files = spark.createDataFrame([("r", *x) for x in rows], "repository_id string, file_id long, file_path string, file_content string, is_test boolean")
    scores = spark.createDataFrame([("t", 1, 1, False, 12.0)], "task_id string, file_id long, name_hits long, explicit boolean, score double")
    assert {x["file_id"]: x["score"] for x in search.with_related(scores, files).collect()} == {1: 12.0, 2: 6.0, 3: 3.0, 4: 5.0, 5: 5.0}
