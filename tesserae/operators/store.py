"""Evidence store: appends under quotas, retention, scopes, sessions, repeated failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut
from tesserae.operators.running import placed, running_sum


def quota_append(chunks: DataFrame, keys: list[str], place: str, ties: list[str], text: str, quota: int) -> DataFrame:
    """df with `available` bytes for each chunk, `kept_bytes` and `complete`: the chunk at which the quota ends is cut, later ones get nothing."""
    rows = running_sum(chunks, keys, place, ties, F.octet_length(text), "_upto")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    available = F.greatest(F.lit(0).cast("long"), F.lit(quota).cast("long") - (F.col("_upto") - size))
    return rows.withColumn("available", available).withColumn("kept_bytes", F.least("available", size)).withColumn("complete", F.col("kept_bytes") == size).drop("_upto")


def newest_kept(df: DataFrame, keys: list[str], created: str, tie: str, most: int, cutoff: Column) -> DataFrame:
    """df with `kept`: among the `most` newest of its group (ties: the later `tie`) and not older than the cutoff."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(created), F.desc(tie))
    return df.withColumn("kept", (F.row_number().over(w) <= most) & F.coalesce(F.col(created) >= cutoff, F.lit(False)))


def pruned_artifacts(df: DataFrame, keys: list[str], place: str, ties: list[str], size: Column, expired: Column, limit: int) -> DataFrame:
    """df with `pruned`, as an oldest-first pass decides that deletes what is expired and, while more than `limit` is used, anything.

    While the pass is above the limit it deletes all it meets; once below, it never comes above again. So an item is deleted if and only
    if it is expired or the total without all items before it exceeds the limit, and no sequential pass is needed. Places may be as far
    apart as they like (a time, say): the sums go over blocks of rows, not of places.
    """
    order = [F.col(place).asc_nulls_first(), *[F.col(t) for t in ties]]
    rows = running_sum(cut(placed(df, keys, order, "_place")), keys, "_place", [], size, "_upto").drop("_place")
    total = rows.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    used = F.col("_total") - F.col("_upto") + F.coalesce(size, F.lit(0)).cast("long")
    return rows.join(total, keys).withColumn("pruned", F.coalesce(expired, F.lit(False)) | (used > limit)).drop("_upto", "_total")


def session_epochs(events: DataFrame, session: str, order: list[str], checkpoint: Column, close: Column) -> DataFrame:
    """events with `epoch`, the number of checkpoints and closings so far, and `rejected`: anything after the first closing."""
    rows = placed(events, [session], [F.col(o) for o in order], "_place")
    rows = rows.withColumn("_close", F.coalesce(close, F.lit(False))).withColumn("_step", F.coalesce(checkpoint | close, F.lit(False)))
    # the first closing of each session is one row, however long the session
    first = rows.filter("_close").groupBy(F.col(session).alias("_s")).agg(F.min("_place").alias("_first"))
    rows = cut(rows.join(first, F.col(session).eqNullSafe(F.col("_s")), "left").withColumn("rejected", F.coalesce(F.col("_place") > F.col("_first"), F.lit(False))).drop("_s", "_first", "_close"))
    return running_sum(rows, [session], "_place", [], (F.col("_step") & ~F.col("rejected")).cast("long"), "epoch").drop("_step", "_place")


def repeated_failures(runs: DataFrame) -> DataFrame:
    """runs with `repeats`: a failed run whose command, source and outcome an earlier run of the session had already.

    The earliest run of each combination is found by an aggregate, so a command repeated without end meets in no single task.
    """
    keys = ["repository_id", "session_id", "executable", "args", "cwd", "source_fingerprint", "child_exit_code", "timed_out", "cancelled"]
    place = F.struct("created_at", "run_id")
    key = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    rows = runs.withColumn("_key", key).withColumn("_place", place)
    first = rows.groupBy("_key").agg(F.min("_place").alias("_first"))
    failed = ~F.coalesce(F.col("child_exit_code") == 0, F.lit(False))
    return rows.join(first, "_key").withColumn("repeats", failed & (F.col("_first") < F.col("_place"))).drop("_key", "_place", "_first")


def in_scope(df: DataFrame, repository: str, session: str | None, strict: bool = True) -> DataFrame:
    """Rows of one repository. strict: also exactly the session, null equals null only; else a session filters only if it is given."""
    rows = df.filter(F.col("repository_id") == repository)
    if strict:
        return rows.filter(F.col("session_id").eqNullSafe(F.lit(session)))
    return rows if session is None else rows.filter(F.col("session_id") == session)
