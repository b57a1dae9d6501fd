"""Usage telemetry: coverage without turning unknown values into zeros, conflict-checked deduplication, series resets, merging.

Every function takes usage events with repository_id, event_id, correlation_id, session_id, task_id, event_time, usage_source,
usage_scope, model_name, six token counts, counter_kind, agent_name, and an `ordinal` (a long) that orders records as supplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import SAFE_INT, usable_count
from tesserae.operators.running import placed

DIMENSIONS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
METRIC_SCOPE = "claude-otel-token-metric"  # a value of the data
SOURCES = ["client_reported", "provider_reported", "locally_estimated"]
_COMPARED = [*DIMENSIONS, "usage_source", "usage_scope", "counter_kind", "session_id", "task_id"]


def _source() -> Column:
    return F.when(F.col("usage_source").isin(SOURCES), F.col("usage_source")).otherwise("unknown")


def _is_metric() -> Column:
    return F.coalesce(F.col("usage_scope") == METRIC_SCOPE, F.lit(False))


def eligible() -> Column:
    """Deltas that a client or provider reported, other than metric samples: the only ones whose totals may be added."""
    return F.coalesce(F.col("counter_kind") == "delta", F.lit(False)) & F.col("usage_source").isin("client_reported", "provider_reported") & ~_is_metric()


def deduplicated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted events, per repository: duplicates, conflicts).

    Records with one correlation_id in a repository are one event if all compared fields agree with the first of them; the first is
    kept. Where one disagrees, the whole correlation is dropped as a conflict. A null correlation_id identifies nothing, such records
    all stay. Copies are counted map-side by their fields before they meet.
    """
    key = F.coalesce(F.col("correlation_id"), F.concat(F.lit("\x00"), F.col("ordinal").cast("string")))
    rows = events.withColumn("_key", key).withColumn("_h", F.sha2(F.to_json(F.struct(*_COMPARED)), 256))
    kinds = rows.groupBy("repository_id", "_key", "_h").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    per_key = kinds.groupBy("repository_id", "_key").agg(
        (F.min_by("n", "first") - 1).alias("duplicates"), (F.count(F.lit(1)) > 1).alias("conflict"), F.min("first").alias("first")
    )
    stats = per_key.groupBy("repository_id").agg(
        F.sum("duplicates").alias("duplicate_records"), F.count_if("conflict").alias("conflicting_correlations"), F.count_if(~F.col("conflict")).alias("analyzed_records")
    )
    keep = per_key.filter("not conflict").select(F.col("first").alias("ordinal"))
    return rows.drop("_key", "_h").join(keep, "ordinal", "left_semi"), stats


def coverage_groups(events: DataFrame, most_events: int | None = None) -> DataFrame:
    """For each repository, source and scope: records, deltas, cumulative samples, eligible deltas, those without a usable total, whether
    the sum left the safe range before a total was missing, and the recorded tokens, null if anything of the repository is in doubt.

    With `most_events` only the first so many records of each repository, by ordinal, are looked at; where there are more, the scan is
    truncated and no tokens are given.
    """
    whole = F.lit(True)
    if most_events is not None:
        total = events.groupBy("repository_id").agg((F.count(F.lit(1)) <= most_events).alias("_whole"))
        events = placed(events, ["repository_id"], [F.col("ordinal")], "_at").filter(F.col("_at") < most_events).drop("_at")
        whole = F.col("_whole")
    accepted, stats = deduplicated(events)
    if most_events is not None:
        stats = stats.join(total, "repository_id")
    rows = accepted.select(
        "repository_id", _source().alias("source"), F.coalesce(F.nullif("usage_scope", F.lit("")), F.lit("unknown")).alias("scope"), "counter_kind", eligible().alias("e"), usable_count(F.col("total_tokens")).alias("usable"), "total_tokens",
        F.struct(F.col("event_time").isNull().alias("n"), F.col("event_time").alias("t"), F.col("event_id").alias("i"), F.col("ordinal").alias("o")).alias("place"),
    )
    keys = ["repository_id", "source", "scope"]
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("counter_kind") == "cumulative").alias("cumulative_records"),
        F.count_if("e").alias("eligible_records"), F.count_if(F.col("e") & ~F.col("usable")).alias("missing_total_records"),
        F.min(F.when(F.col("e") & ~F.col("usable"), F.col("place"))).alias("missing_at"),
        F.sum(F.when(F.col("e") & F.col("usable"), F.col("total_tokens").cast("decimal(38,0)"))).alias("total"),
    )
    # totals are not negative, so the running sum left the range before the first missing total if and only if their sum did
    late = groups.filter(F.col("missing_at").isNotNull() & (F.col("total") > SAFE_INT)).select(*keys, F.col("missing_at").alias("until"))
    sums = rows.filter("e and usable").join(late, keys).filter(F.col("place") < F.col("until")).groupBy(*keys).agg(F.sum(F.col("total_tokens").cast("decimal(38,0)")).alias("early"))
    joined = groups.join(sums, keys, "left").join(stats.select("repository_id", "conflicting_correlations", whole.alias("_complete")), "repository_id")
    overflow = F.when(F.col("missing_at").isNull(), F.coalesce(F.col("total") > SAFE_INT, F.lit(False))).otherwise(F.coalesce(F.col("early") > SAFE_INT, F.lit(False)))
    return joined.withColumn("total_overflow", overflow).select(
        *keys, "records", (F.col("records") - F.col("cumulative_records")).alias("delta_records"), "cumulative_records", "eligible_records", "missing_total_records", "total_overflow",
        F.when((F.col("missing_total_records") == 0) & ~F.col("total_overflow") & (F.col("conflicting_correlations") == 0) & F.col("_complete"), F.col("total").cast("long")).alias("recorded_tokens"),
    )


def missing_fields(events: DataFrame) -> DataFrame:
    """For each repository the number of records without each field, and of records with a count that is not usable."""
    accepted, _ = deduplicated(events)
    empty = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    invalid = F.lit(False)
    for d in DIMENSIONS:
        invalid = invalid | (F.col(d).isNotNull() & ~usable_count(F.col(d)))
    return accepted.groupBy("repository_id").agg(
        *[F.count_if(~usable_count(F.col(d))).alias(f"no_{d}") for d in DIMENSIONS], empty("model_name").alias("no_model"), empty("session_id").alias("no_session"), empty("task_id").alias("no_task"),
        F.count_if(F.col("event_time").isNull()).alias("no_client_time"), empty("agent_name").alias("no_agent_type"), F.count(F.lit(1)).alias("no_agent_identity"), F.count_if(invalid).alias("invalid_counts"),
    )


def counter_kinds(events: DataFrame) -> DataFrame:
    """Records by class; the first that fits decides: unknown source, estimate, cumulative sample, metric delta, reported delta."""
    accepted, _ = deduplicated(events)
    kind = (
        F.when(_source() == "unknown", "unknown_source").when(_source() == "locally_estimated", "locally_estimated")
        .when(F.col("counter_kind") == "cumulative", "cumulative").when(_is_metric(), "metric_delta").otherwise("reported_delta")
    )
    return accepted.groupBy("repository_id", kind.alias("counter_class")).agg(F.count(F.lit(1)).alias("records"))


def attribution(query_source: Column, agent_type: Column) -> Column:
    """struct(category, basis) of an event: a reported category wins, then an agent type, then the main thread."""
    kinds = ["main", "subagent", "auxiliary"]
    has_agent = F.coalesce(agent_type, F.lit("")) != ""
    category = F.when(query_source.isin(kinds), query_source).when(has_agent, "subagent").when(query_source == "repl_main_thread", "main").otherwise("unknown")
    basis = F.when(query_source.isin(kinds), "reported-category").when(has_agent, "reported-agent-type").when(query_source == "repl_main_thread", "reported-main-thread").otherwise("unknown")
    return F.struct(category.alias("category"), basis.alias("basis"))


def observed_total(events: DataFrame, *by: str) -> DataFrame:
    """Eligible deltas and their total by the given columns; the total is null if there are none, one is unknown, or the sum is not exact."""
    rows = events.filter(eligible())
    known = F.count_if(usable_count(F.col("total_tokens")))
    total = F.sum(F.col("total_tokens").cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("deltas"), F.when((known == F.count(F.lit(1))) & (total <= SAFE_INT), total.cast("long")).alias("observed_total"))


def series_summary(samples: DataFrame) -> DataFrame:
    """Per cumulative or delta series: samples, first and last time, last value, missing starts, resets or decreases; totals are never given.

    samples: usage_source, counter_kind, series_id, dimension, start_time, sample_time, value, ordinal. A reset is a changed start time
    or a smaller value, between neighbours in time, in cumulative series only.
    """
    w = Window.partitionBy("usage_source", "counter_kind", "series_id").orderBy("sample_time", "ordinal")
    step = samples.withColumns({"p_start": F.lag("start_time").over(w), "p_value": F.lag("value").over(w)})
    reset = (F.col("counter_kind") == "cumulative") & (F.coalesce(F.col("p_start") != F.col("start_time"), F.lit(False)) | F.coalesce(F.col("value") < F.col("p_value"), F.lit(False)))
    place = F.struct("sample_time", "ordinal")
    return step.groupBy("usage_source", "counter_kind", "series_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("sample_time").alias("first_time"), F.max("sample_time").alias("last_time"), F.max_by("value", place).alias("last_value"),
        F.count_if(F.col("start_time").isNull()).alias("missing_starts"), F.count_if(reset).alias("resets"),
    )


def merge_import(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming events with `outcome`: new, duplicate (a stored event of the correlation agrees in all compared fields) or conflict.

    An import with a conflict must be rejected whole; see reject_conflicts. Stored correlations are unique after deduplication; of
    several, the first counts.
    """
    known = stored.filter("correlation_id is not null").groupBy("repository_id", "correlation_id").agg(F.min_by(F.sha2(F.to_json(F.struct(*_COMPARED)), 256), "ordinal").alias("_old"))
    rows = incoming.withColumn("_new", F.sha2(F.to_json(F.struct(*_COMPARED)), 256)).join(known, ["repository_id", "correlation_id"], "left")
    return rows.withColumn("outcome", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "duplicate").otherwise("conflict")).drop("_old", "_new")


def reject_conflicts(merged: DataFrame) -> DataFrame:
    """The new events of a merge; fails when it runs if any event conflicts."""
    ok = F.when(F.col("outcome") == "conflict", F.raise_error(F.lit("import rejected: an event conflicts with the stored one")).cast("boolean")).otherwise(F.col("outcome") == "new")
    return merged.filter(ok).drop("outcome")


def bounded_groups(events: DataFrame, max_events: int, max_groups: int) -> DataFrame:
    """Per repository: scanned and omitted records under a bound on records (the first supplied), groups kept and records in omitted
    groups under a bound on groups (the first seen)."""
    w = Window.partitionBy("repository_id").orderBy("ordinal")
    total = events.groupBy("repository_id").agg(F.count(F.lit(1)).alias("supplied"))
    scanned = events.select("repository_id", "ordinal", _source().alias("source"), F.coalesce("usage_scope", F.lit("unknown")).alias("scope")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max_events)
    groups = scanned.groupBy("repository_id", "source", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("seen"))
    ranked = groups.withColumn("g", F.row_number().over(Window.partitionBy("repository_id").orderBy("seen")))
    per = ranked.groupBy("repository_id").agg(F.sum("n").alias("scanned"), F.count_if(F.col("g") <= max_groups).alias("groups"), F.sum(F.when(F.col("g") > max_groups, F.col("n")).otherwise(0)).alias("omitted_group_records"))
    return total.join(per, "repository_id").select("repository_id", "scanned", (F.col("supplied") - F.col("scanned")).alias("omitted"), "groups", "omitted_group_records")
