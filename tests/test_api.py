"""Settings, discovery, responses, named functions, results of tools."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tesserae import api
from tesserae.operators import hooks


def test_settings(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert api.project_root(str(tmp_path / "a" / "b")) is None and api.load_settings(str(tmp_path), env={}) == api.Settings()
    (tmp_path / api.CONFIG_FILE).write_text(json.dumps({"context_budget": 500, "mode": "balanced"}))
    assert api.project_root(str(tmp_path / "a" / "b")) == os.path.realpath(tmp_path)
    s = api.load_settings(str(tmp_path), {"max_depth": 3}, {"TESSERAE_CONTEXT_BUDGET": "600", "OTHER": "1"})
    assert (s.context_budget, s.mode, s.max_depth, s.max_files) == (600, "balanced", 3, 64)
    for bad in ({"nope": 1}, {"mode": "x"}, {"max_depth": 9}, {"context_budget": True}, {"text_weight": -1}):
        with pytest.raises(ValueError):
            api.load_settings(str(tmp_path), bad, {})
    os.symlink(tmp_path / api.CONFIG_FILE, tmp_path / "link")
    with pytest.raises(OSError):
        api.read_bounded(str(tmp_path / "link"))
    with pytest.raises(ValueError):
        api.read_bounded(str(tmp_path / api.CONFIG_FILE), 3)
    assert api.safe_path(str(tmp_path), "a/../a/b").endswith("/a/b")
    with pytest.raises(ValueError):
        api.safe_path(str(tmp_path), "../x")


def test_functions(spark, sf, tmp_path):
    out = api.prepare_context(spark, sf, "fix the cache reader", 900).first()
    assert out["status"] == "ready" and 0 < out["tokens"] <= 900
    one = spark.read.parquet(f"{sf}/artifact_chunks.parquet").groupBy("artifact_id").count().orderBy(F.desc("count"), "artifact_id").first()["artifact_id"]
    page = api.read_evidence(spark, sf, one, 0, 2).collect()
    assert [r["seq"] for r in page] == sorted(r["seq"] for r in page) and len(page) == 2 and page[0]["has_more"]
    df = spark.createDataFrame([("r", "a", "1"), ("r", "b", None)], "repository_id string, path string, hash string")
    assert api.response(df)[1] == {"repository_id": "r", "path": "b", "hash": None} and api.get_changes(df, df).count() == 0
    with pytest.raises(ValueError, match="allowed"):
        api.response(df, 20)
    api.write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_results_of_tools(spark):
    native = {"stdout": "x", "stderr": "", "interrupted": False, "isImage": False}
    noisy = "\n".join(["INFO queue poll for tenant returned zero pending work items"] * 40)
    ok = lambda **k: json.dumps({"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_response": native | k})
    events = {
        "reduced": ok(stdout=noisy, exitCode=0), "no_net_gain": ok(stdout="abcdefghij klmno\n" * 5 + "abcdefghij klmno", exit_code=None), "unknown_format": ok(stdout="plain text", truncated=False), "malformed": "{", "m2": None, "m3": "[1]",
        "lifecycle": json.dumps({"hook_event_name": "SessionEnd"}), "other_tool": json.dumps({"hook_event_name": "PostToolUse", "tool_name": "Read"}), "unknown_fields": ok(extra=1), "unknown_shape": ok(stdout=5), "s2": ok(exitCode=1.5), "s3": ok(truncated="no"),
        "interrupted_or_image": ok(interrupted=True), "already_reduced": ok(stderr="[evidence: a]"), "secret": ok(stdout="password=hunter22\n" + noisy),
    }
    same = {"m2": "malformed", "m3": "malformed", "s2": "unknown_shape", "s3": "unknown_shape", "secret": "reduced"}
    df = spark.createDataFrame(list(events.items()), "id string, event string")
    got = {r["id"]: r for r in hooks.reduced_results(df, "id", "event").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: same.get(k, k) for k in events}
    r = got["reduced"]
    assert r["applied"] and r["reduced_bytes"] < r["original_bytes"] and json.loads(r["shown"])["stdout"].endswith("[evidence: reduced; reducer logs]") and json.loads(r["shown"])["exitCode"] == 0
    assert "hunter22" not in got["secret"]["shown"] and got["malformed"]["shown"] == "{" and got["unknown_format"]["shown"] == events["unknown_format"]
    seen = {r["id"]: r for r in hooks.reduced_results(df, "id", "event", "observe").collect()}
    assert seen["reduced"]["reason"] == "observe_only" and not seen["reduced"]["applied"] and seen["reduced"]["saved_bytes"] == r["original_bytes"] - r["reduced_bytes"]
