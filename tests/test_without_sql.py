"""Core queries that SQL cannot express, over whole tables, against plain versions."""

import json
import os

import pytest

from tesserae.functions import redaction as X
from tesserae.functions.tokens import encoding
from tesserae.operators.search import relevance, required_files, text_matches
from tesserae.plans import evidence, records, reports, streams


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


@pytest.mark.skipif(not os.path.exists(reports.VOCABULARY), reason="no vocabulary here")
def test_exact_token_counts(spark, sf):
    e = encoding(reports.VOCABULARY)
    want = {r["doc_id"]: None if r["text"] is None else len(e.encode_ordinary(r["text"])) for r in rows(spark, sf, "documents")}
    assert {r["doc_id"]: r["tokens"] for r in reports.exact_token_counts(spark, sf).collect()} == want


def test_redacted_chunks_and_events(spark, sf):
    want = {(r["artifact_id"], r["seq"]): X.redact_text(r["chunk_text"]) for r in rows(spark, sf, "artifact_chunks")}
    assert {(r["artifact_id"], r["seq"]): r["text"] for r in reports.redacted_chunks(spark, sf).collect()} == want
    props = {r["event_id"]: r["props"] for r in rows(spark, sf, "events")}
    got = reports.sanitized_events(spark, sf).collect()
    assert len(got) == len(props)
    for r in got:
        value = X.strict_json(props[r["event_id"]])
        assert r["valid"] == (value is not None)
        if value is not None and not X.SENSITIVE_KEY.search(props[r["event_id"]]):
            assert json.loads(r["props"]) == json.loads(X.redact_text(json.dumps(value)))


def test_redacted_arguments_of_runs(spark, sf):
    def plain(args):
        out, hide = [], False
        for a in args or []:
            flag = X.SENSITIVE_FLAG.search(a)
            out.append("[REDACTED ARGUMENT]" if hide else a[: a.index("=") + 1] + "[REDACTED ARGUMENT]" if flag and "=" in a else X.redact_text(a))
            hide = bool(not hide and flag and "=" not in a)
        return " ".join(out)

    want = {r["run_id"]: plain(r["args"]) for r in rows(spark, sf, "run_results")}
    assert {r["run_id"]: r["args"] for r in streams.batch_redacted_runs(spark, sf).collect()} == want


def test_reduced_documents_never_grow(spark, sf):
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in rows(spark, sf, "documents")}
    got = evidence.reduced_documents(spark, sf).collect()
    assert {r["doc_id"]: r["original_bytes"] for r in got} == size
    assert all((r["reduced_bytes"] < r["original_bytes"]) == (r["reason"] == "reduced") and r["reduced_bytes"] <= r["original_bytes"] for r in got)


def test_shuffled_plan_is_a_permutation(spark, sf):
    plan = {tuple(r) for r in evidence.plan_cross_product(spark, sf).collect()}
    got = evidence.plan_shuffled(spark, sf).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(plan))) and {tuple(r)[1:] for r in got} == plan and [tuple(r)[1:] for r in got] != sorted(plan)


def test_context_queries(spark, sf):
    for r in reports.context_packages(spark, sf).collect():
        assert r["status"] == "ready" and 0 < r["tokens"] <= 4000
    files = {r["file_id"] for r in rows(spark, sf, "indexed_files")}
    assert all(0 < r["files"] <= min(len(files), r["fragments"]) for r in reports.context_fragments(spark, sf).collect())


def test_import_reports_symbols_and_references(spark, sf):
    bad = evidence.import_resolution(spark, sf).filter("outcome <> 'ok'").groupBy("repository_id").count().collect()
    assert {r["repository_id"]: r["issues"] + r["omitted"] for r in records.import_reports(spark, sf).collect()} == {r["repository_id"]: r["count"] for r in bad}
    refs = {r["dynamic"]: r["references"] for r in records.module_references(spark, sf).collect() if not r["dynamic"]}
    from tesserae.operators.graph import imports_of

    assert refs.get(False, 0) == imports_of(spark.read.parquet(f"{sf}/indexed_files.parquet")).count()
    # the tables bring symbols of a parser: top-level declarations by their lines find most of them
    from tesserae.operators.symbols import declared_symbols

    found = {(r["file_id"], r["symbol_name"]) for r in declared_symbols(spark.read.parquet(f"{sf}/indexed_files.parquet")).collect()}
    known = {(r["file_id"], r["symbol_name"]) for r in rows(spark, sf, "source_symbols")}
    assert len(found & known) >= 0.9 * len(known)


def test_package_retention(spark, sf):
    per = {}
    for r in {r["run_id"]: r for r in rows(spark, sf, "run_results")}.values():
        if r["session_id"] is not None:
            p = per.setdefault((r["repository_id"], r["session_id"]), [r["created_at"], set()])
            p[0] = max(p[0], r["created_at"])
            p[1] |= {r["artifact_id"]} - {None}
    want = set()
    for repo in {k[0] for k in per}:
        held = set()
        for key, (_, refs) in sorted(((k, v) for k, v in per.items() if k[0] == repo), key=lambda x: (x[1][0], x[0][1]), reverse=True)[:50]:
            if len(held | refs) <= 120:
                held |= refs
                want.add(key)
    assert {(r["repository_id"], r["package_id"]) for r in records.package_retention(spark, sf).filter("kept").collect()} == want


def test_search_for_many_words_and_named_paths(spark, monkeypatch):
    from tesserae.operators import search

    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, "")], "doc_id long, content string")
    tasks = spark.createDataFrame([("t", "find beta in src/a b.ts now"), ("u", "gamma")], "task_id string, task string")
    a = sorted(tuple(r) for r in text_matches(tasks, docs).collect())
    monkeypatch.setattr(search, "MOST_TERMS", 0)
    assert sorted(tuple(r) for r in text_matches(tasks, docs).collect()) == a and [x[:2] for x in a] == [("t", 1), ("u", 2)]
    files = spark.createDataFrame([(1, "src/a b.ts", "src/a b.ts"), (2, "", "x"), (3, "lib/gamma.ts", "lib/gamma.ts")], "file_id long, file_path string, names string")
    got = {(r["task_id"], r["file_id"]): (r["explicit"], r["reasons"]) for r in relevance(tasks, files, text_matches(tasks, docs)).collect()}
    assert got[("t", 1)][0] and "named in the task" in got[("t", 1)][1] and not got[("u", 3)][0] and got[("u", 3)][1] == ["words in names: 1"]
    need = required_files(spark.createDataFrame([("t", "lib/gamma.ts"), ("t", "gone.ts"), ("t", "gone.ts")], "task_id string, file_path string"), files)
    assert {tuple(r) for r in need.collect()} == {("t", "lib/gamma.ts", False), ("t", "gone.ts", True)}


def test_stream_of_redacted_lines(spark, sf):
    from tesserae.streaming.redaction import StreamRedactor

    want, per = {}, {}
    for r in sorted(rows(spark, sf, "artifact_chunks"), key=lambda r: (r["artifact_id"], r["stream"], r["seq"])):
        out = per.setdefault((r["artifact_id"], r["stream"]), StreamRedactor()).feed((r["chunk_text"] or "").encode())
        n, size = want.get((r["artifact_id"], r["stream"]), (0, 0))
        want[(r["artifact_id"], r["stream"])] = (n + len(out), size + sum(len(x.encode()) for x in out))
    got = {(r["artifact_id"], r["stream"]): (r["lines"], r["bytes"]) for r in streams.stream_redacted(spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_truncated_scan_and_other_policy(spark, sf):
    from tesserae.operators.snapshots import index_plan
    from tesserae.operators.usage import coverage_groups
    from tesserae.plans.usage import _events

    e = _events(spark, sf)
    most = max(r["count"] for r in e.groupBy("repository_id").count().collect())
    assert sorted(map(repr, coverage_groups(e, most).collect())) == sorted(map(repr, coverage_groups(e).collect()))
    cut = coverage_groups(e, most - 1).collect()
    big = {r["repository_id"] for r in e.groupBy("repository_id").count().filter(f"count = {most}").collect()}
    assert all(r["recorded_tokens"] is None for r in cut if r["repository_id"] in big)
    s = spark.createDataFrame([("r", "a", "1")], "repository_id string, path string, hash string")
    assert index_plan(s, s).first()["action"] == "unchanged" and index_plan(s, s, same_policy=False).first()["action"] == "reindex"
