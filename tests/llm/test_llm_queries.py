"""Every query of the subpackage runs on the smallest tables and agrees with its SQL."""

import pytest
from pyspark.sql import functions as F

from tesserae.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, compare, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.SQL.get(name))


# --- what SQL cannot express: plain versions over whole tables


def _rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_syntax_verdicts_of_json_and_python(spark, sf):
    import ast
    import json

    def broken(path, text):
        try:
            (json.loads if path.endswith(".json") else ast.parse)(text.removeprefix("﻿"))
        except (ValueError, SyntaxError):
            return True
        return False

    files = [r for r in _rows(spark, sf, "indexed_files") if r["file_path"] and r["file_path"].endswith((".json", ".py")) and r["file_content"] is not None]
    found = {r["file_id"] for r in catalog.QUERIES["p2_found"](spark, sf).collect()}
    assert {r["file_id"] for r in files} & found == {r["file_id"] for r in files if broken(r["file_path"], r["file_content"])}
    defects = catalog.QUERIES["p2_defects"](spark, sf).collect()
    assert {r["file_id"] for r in defects if r["edits"] > 0} == found and all((r["defect"] is None) == (r["edits"] == 0) for r in defects)
    rates = catalog.QUERIES["p2_rates"](spark, sf).collect()
    assert sum(r["broken"] for r in rates) == len(found) and sum(r["files"] for r in rates) == len(defects)


def test_runs_against_a_pass(spark, sf):
    from tesserae.llm.runs import same_event_text

    chunks = spark.read.parquet(f"{sf}/artifact_chunks.parquet").withColumn("said", same_event_text(F.col("chunk_text"))).dropDuplicates(["artifact_id", "stream", "seq"]).collect()
    runs, last = [], None
    for r in sorted((c for c in chunks if c["artifact_id"] is not None), key=lambda c: (c["artifact_id"], c["stream"], c["seq"])):
        key = (f"{r['artifact_id']}/{r['stream']}", r["said"])
        if key == last:
            runs[-1][2], runs[-1][3] = str(r["seq"]), runs[-1][3] + 1
        else:
            runs.append([key[0], str(r["seq"]), str(r["seq"]), 1])
        last = key
    found = {tuple(r)[1:] for r in catalog.QUERIES["p3_found"](spark, sf).filter("seq_kind = 'chunk'").collect()}
    assert found == {tuple(r[:3]) for r in runs if r[3] > 1}
    assert catalog.QUERIES["p3_collapsed"](spark, sf).filter("seq_kind = 'chunk'").agg(F.sum("events")).first()[0] == len(chunks)


def test_redaction_leaves_no_credential_and_nothing_else_changes(spark, sf):
    from tesserae.llm.secrets import find_secrets

    before = {r["file_id"]: r["file_content"] for r in _rows(spark, sf, "indexed_files")}
    after = catalog.QUERIES["p4_redacted_files"](spark, sf).collect()
    texts = [r["redacted_text"] or "" for r in after]
    assert len(after) == len(before) and sum(map(len, find_secrets(texts))) <= 0.01 * sum(r["credentials"] or 0 for r in after)
    for r in after:
        old = before[r["file_id"]]
        assert (r["redacted_text"] == old) if not r["credentials"] else r["redacted_text"].count("\n") == old.count("\n")
    chunks = catalog.QUERIES["p4_redacted_chunks"](spark, sf).collect()
    assert len(chunks) == spark.read.parquet(f"{sf}/artifact_chunks.parquet").dropDuplicates(["artifact_id", "stream", "seq"]).count()


def test_pieces_make_the_items_again(spark, sf):
    pieces = catalog.QUERIES["p5_pieces"](spark, sf).collect()
    limits = {r["item_kind"]: r["max_bytes"] for r in _rows(spark, sf, "split_limits")}
    assert all(r["bytes"] <= limits[r["item_kind"]] for r in pieces)
    files = {r["file_id"]: r["file_content"] for r in _rows(spark, sf, "indexed_files")}
    by = {}
    for r in sorted(pieces, key=lambda r: r["piece"]):
        by.setdefault((r["item_kind"], r["item_id"]), []).append(r["piece_text"].encode()[r["overlap_bytes"] :])
    for (kind, i), parts in by.items():
        if kind == "file":
            assert b"".join(parts).decode() == files[i]
    summary = {r["item_kind"]: r for r in catalog.QUERIES["p5_summary"](spark, sf).collect()}
    for kind in summary:
        mine = [r for r in pieces if r["item_kind"] == kind]
        assert (summary[kind]["items"], summary[kind]["pieces"], summary[kind]["largest"]) == (len({r["item_id"] for r in mine}), len(mine), max(r["bytes"] for r in mine))


def test_leaks_against_every_pair(spark, sf):
    from tesserae.llm.leaks import leak_words, own_text

    items = {r["item_id"]: leak_words(own_text(r["item_text"])) for r in _rows(spark, sf, "eval_items") if r["item_text"]}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 14):
            runs.setdefault(tuple(w[k : k + 15]), set()).add(i)
    exact = set()
    for r in _rows(spark, sf, "documents"):
        w = leak_words(r["text"])
        for k in range(len(w) - 14):
            exact |= {(r["doc_id"], i) for i in runs.get(tuple(w[k : k + 15]), ())}
    found = {tuple(r) for r in catalog.QUERIES["p7_found"](spark, sf).collect()}
    assert exact <= found
    by = {r["item_id"]: r["documents"] for r in catalog.QUERIES["p7_by_item"](spark, sf).collect()}
    assert sum(by.values()) == len(found) and len(by) == len(_rows(spark, sf, "eval_items"))


def test_handwritten_files_and_prose_are_the_rest(spark, sf):
    scores = {r["file_id"]: r for r in catalog.QUERIES["p6_scores"](spark, sf).collect()}
    hand = {r["file_id"] for r in catalog.QUERIES["p6_handwritten"](spark, sf).collect()}
    assert hand == {i for i, r in scores.items() if not r["is_case"]} and len(scores) == spark.read.parquet(f"{sf}/indexed_files.parquet").count()
    shares = catalog.QUERIES["p9_passages"](spark, sf).collect()
    found = {r["doc_id"] for r in catalog.QUERIES["p9_found"](spark, sf).collect()}
    assert found == {r["doc_id"] for r in shares if r["is_prose"] is False}
    assert all(abs(sum(r[k] for k in ("prose_share", "list_share", "table_share", "machine_share", "junk_share")) - 1) < 1e-9 for r in shares if r["is_prose"] is not None)


def test_mixture_keeps_its_promises(spark, sf):
    most = {r["source"]: r["max_repeats"] for r in _rows(spark, sf, "mix_targets")}
    used = {}
    for r in catalog.QUERIES["p8_mixture"](spark, sf).collect():
        used.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= most[s] for (s, _), c in used.items())
    shares = catalog.QUERIES["p8_shares"](spark, sf).collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9 and all(abs(r["actual_share"] - r["target_share"]) < 0.05 for r in shares)
