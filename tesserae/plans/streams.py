"""Streaming queries, run over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions.redaction import redacted_args
from tesserae.functions.runtime import shared_folder, table
from tesserae.streaming import redaction as R


def _place(spark) -> str:
    """A checkpoint of its own for each run, in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_dedup(spark, d):
    """Deliveries with distinct repository and correlation, counted by source."""
    s = R.first_deliveries(R.folder_stream(spark, d, "usage_deliveries").filter("correlation_id is not null"), ["repository_id", "correlation_id"]).select("repository_id")
    out = R.run_once(s, "stream_dedup_" + uuid.uuid4().hex[:8], _place(spark))
    return out.groupBy("repository_id").agg(F.count(F.lit(1)).alias("events"))


def stream_windows(spark, d):
    """Daily counts of events by type, all windows."""
    s = R.folder_stream(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
    return R.run_once(s, "stream_windows_" + uuid.uuid4().hex[:8], _place(spark), "complete")


def batch_redacted_runs(spark, d):
    """Arguments of runs with the values of sensitive flags hidden."""
    r = table(spark, d, "run_results").dropDuplicates(["run_id"])
    return r.select("run_id", F.array_join(redacted_args(F.col("args")), " ").alias("args"))


def stream_redacted(spark, d):
    """Chunks of output as a stream of redacted lines, kept together by artifact and stream: what left for each of them."""
    out = R.run_once(R.redacted_stream(R.folder_stream(spark, d, "artifact_chunks").select("artifact_id", "stream", "seq", "chunk_text")), "stream_redacted_" + uuid.uuid4().hex[:8], _place(spark))
    return out.groupBy("artifact_id", "stream").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_windows, stream_redacted, batch_redacted_runs)}
SQL = {
    "stream_dedup": "select repository_id, count(distinct correlation_id) as events from usage_deliveries group by 1 having count(correlation_id) > 0",
    "stream_windows": "select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n from events group by 1, 2",
}
