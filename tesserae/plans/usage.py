"""Queries over usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.operators import usage as U


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_deliveries").withColumn("ordinal", F.col("delivery_id"))


def usage_groups(spark, sf_dir):
    return U.coverage_groups(_events(spark, sf_dir))


def usage_missing(spark, sf_dir):
    return U.missing_fields(_events(spark, sf_dir))


def usage_counters(spark, sf_dir):
    return U.counter_kinds(_events(spark, sf_dir))


def usage_attribution(spark, sf_dir):
    a = U.attribution(F.col("usage_source"), F.col("agent_name"))
    accepted, _ = U.deduplicated(_events(spark, sf_dir))
    return accepted.select("repository_id", a.alias("a")).groupBy("repository_id", F.col("a.category").alias("category"), F.col("a.basis").alias("basis")).agg(F.count(F.lit(1)).alias("records"))


def usage_observed_total(spark, sf_dir):
    return U.observed_total(_events(spark, sf_dir), "repository_id", "usage_scope")


def usage_dedup_conflicts(spark, sf_dir):
    return U.deduplicated(_events(spark, sf_dir))[1]


def usage_series_resets(spark, sf_dir):
    """Series of one token type each; a series starts anew each day, and every seventh delivery does not say when its series began."""
    e = _events(spark, sf_dir).filter(F.col("usage_scope") == U.METRIC_SCOPE)
    kinds = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens", "cache_creation": "cache_write_tokens"}
    points = F.filter(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in kinds.items()]), lambda x: x["value"].isNotNull())
    start = F.when(F.col("delivery_id") % 7 > 0, F.date_trunc("day", "event_time"))
    rows = e.select("*", start.alias("start_time"), F.explode(points).alias("x"))
    series = F.sha2(F.concat_ws("|", "repository_id", F.coalesce("session_id", F.lit("")), F.coalesce("model_name", F.lit("")), F.coalesce("agent_name", F.lit("")), "x.dimension"), 256)
    samples = rows.select("usage_source", "counter_kind", series.alias("series_id"), "x.dimension", "start_time", F.col("event_time").alias("sample_time"), "x.value", "ordinal")
    return U.series_summary(samples).select("usage_source", "counter_kind", "series_id", "samples", "last_value", "missing_starts", "resets")


def usage_import_merge(spark, sf_dir):
    e = _events(spark, sf_dir)
    stored, incoming = e.filter("delivery_id % 2 = 0"), e.filter("delivery_id % 2 = 1")
    return U.merge_import(stored, incoming).groupBy("repository_id", "outcome").agg(F.count(F.lit(1)).alias("events"))


def usage_bounds(spark, sf_dir):
    return U.bounded_groups(_events(spark, sf_dir), 100, 3)


_CMP = "input_tokens, cached_input_tokens, cache_write_tokens, output_tokens, reasoning_tokens, total_tokens, usage_source, usage_scope, counter_kind, session_id, task_id"
_BASE = f"""
with e as (select *, delivery_id as ordinal, coalesce(correlation_id, chr(1) || delivery_id) as k, row({_CMP}) as h from usage_deliveries),
fk as (select *, first_value(h) over (partition by repository_id, k order by ordinal) as fh, row_number() over (partition by repository_id, k order by ordinal) as rn from e),
pk as (select repository_id, k, count(*) filter (where h is not distinct from fh) - 1 as duplicates, count(*) filter (where h is distinct from fh) > 0 as conflict, min(ordinal) as first from fk group by 1, 2),
stats as (select repository_id, sum(duplicates) as duplicate_records, count(*) filter (where conflict) as conflicting_correlations, count(*) filter (where not conflict) as analyzed_records from pk group by 1),
a as (select e.*, case when usage_source in ('client_reported','provider_reported','locally_estimated') then usage_source else 'unknown' end as source,
      coalesce(nullif(usage_scope, ''), 'unknown') as scope,
      coalesce(counter_kind = 'delta', false) and coalesce(usage_source in ('client_reported','provider_reported'), false) and coalesce(usage_scope, '') <> 'claude-otel-token-metric' as el
      from e semi join (select first from pk where not conflict) p on e.ordinal = p.first)
"""
_U = lambda c: f"coalesce({c} >= 0 and {c} <= 9007199254740991, false)"
QUERIES = {f.__name__: f for f in (usage_groups, usage_missing, usage_counters, usage_attribution, usage_observed_total, usage_dedup_conflicts, usage_series_resets, usage_import_merge, usage_bounds)}
SQL = {
    "usage_groups": _BASE
    + f"""select g.repository_id, source, scope, records, records - cumulative_records as delta_records, cumulative_records, eligible_records, missing_total_records, total_overflow,
      case when missing_total_records = 0 and not total_overflow and conflicting_correlations = 0 then cast(total as bigint) end as recorded_tokens
    from (select repository_id, source, scope, count(*) as records, count(*) filter (where counter_kind = 'cumulative') as cumulative_records, count(*) filter (where el) as eligible_records,
      count(*) filter (where el and not {_U("total_tokens")}) as missing_total_records, coalesce(sum(case when el then total_tokens end), 0) > 9007199254740991 as total_overflow,
      sum(case when el and {_U("total_tokens")} then total_tokens end) as total from a group by 1, 2, 3) g join stats using (repository_id)""",
    "usage_missing": _BASE
    + "select repository_id, "
    + ", ".join(f"count(*) filter (where not {_U(d)}) as no_{d}" for d in U.DIMENSIONS)
    + """, count(*) filter (where coalesce(model_name, '') = '') as no_model, count(*) filter (where coalesce(session_id, '') = '') as no_session, count(*) filter (where coalesce(task_id, '') = '') as no_task,
      count(*) filter (where event_time is null) as no_client_time, count(*) filter (where coalesce(agent_name, '') = '') as no_agent_type, count(*) as no_agent_identity, count(*) filter (where """
    + " or ".join(f"({d} is not null and not {_U(d)})" for d in U.DIMENSIONS)
    + ") as invalid_counts from a group by 1",
    "usage_counters": _BASE
    + """select repository_id, case when source = 'unknown' then 'unknown_source' when source = 'locally_estimated' then source when counter_kind = 'cumulative' then 'cumulative'
      when usage_scope = 'claude-otel-token-metric' then 'metric_delta' else 'reported_delta' end as counter_class, count(*) as records from a group by 1, 2""",
    "usage_attribution": _BASE
    + """select repository_id, case when usage_source in ('main','subagent','auxiliary') then usage_source when coalesce(agent_name, '') <> '' then 'subagent' when usage_source = 'repl_main_thread' then 'main' else 'unknown' end as category,
      case when usage_source in ('main','subagent','auxiliary') then 'reported-category' when coalesce(agent_name, '') <> '' then 'reported-agent-type' when usage_source = 'repl_main_thread' then 'reported-main-thread' else 'unknown' end as basis,
      count(*) as records from a group by 1, 2, 3""",
    "usage_observed_total": f"""select repository_id, usage_scope, count(*) as deltas, case when count(*) filter (where {_U("total_tokens")}) = count(*) and sum(total_tokens) <= 9007199254740991 then cast(sum(total_tokens) as bigint) end as observed_total
      from usage_deliveries where counter_kind = 'delta' and usage_source in ('client_reported','provider_reported') and coalesce(usage_scope, '') <> 'claude-otel-token-metric' group by 1, 2""",
    "usage_dedup_conflicts": _BASE + "select repository_id, cast(duplicate_records as bigint) as duplicate_records, conflicting_correlations, analyzed_records from stats",
    "usage_series_resets": """with x as (select *, unnest(['input', 'output', 'cache_read', 'cache_creation']) as dim, unnest([input_tokens, output_tokens, cached_input_tokens, cache_write_tokens]) as v from usage_deliveries where usage_scope = 'claude-otel-token-metric'),
      s as (select usage_source, counter_kind, sha256(concat_ws('|', repository_id, coalesce(session_id,''), coalesce(model_name,''), coalesce(agent_name,''), dim)) as series_id, event_time as t, delivery_id as o, v,
        case when delivery_id % 7 > 0 then date_trunc('day', event_time) end as st from x where v is not null),
      w as (select *, lag(v) over q as pv, lag(st) over q as ps from s window q as (partition by usage_source, counter_kind, series_id order by t, o))
      select usage_source, counter_kind, series_id, count(*) as samples, arg_max_null(v, row(t, o)) as last_value, count(*) filter (where st is null) as missing_starts,
        count(*) filter (where counter_kind = 'cumulative' and (coalesce(v < pv, false) or coalesce(st <> ps, false))) as resets from w group by 1, 2, 3""",
    "usage_import_merge": f"""with s as (select repository_id, correlation_id, first(row({_CMP}) order by delivery_id) as h from usage_deliveries where delivery_id % 2 = 0 and correlation_id is not null group by 1, 2)
      select i.repository_id, case when s.correlation_id is null then 'new' when s.h is not distinct from row({_CMP.replace(", ", ", i.").replace("input_tokens", "i.input_tokens", 1)}) then 'duplicate' else 'conflict' end as outcome, count(*) as events
      from usage_deliveries i left join s on i.repository_id = s.repository_id and i.correlation_id = s.correlation_id where delivery_id % 2 = 1 group by 1, 2""",
    "usage_bounds": """with r as (select repository_id, case when usage_source in ('client_reported','provider_reported','locally_estimated') then usage_source else 'unknown' end as source, coalesce(usage_scope, 'unknown') as scope,
      row_number() over (partition by repository_id order by delivery_id) as k from usage_deliveries),
      g as (select repository_id, source, scope, count(*) as n, min(k) as seen from r where k <= 100 group by 1, 2, 3),
      q as (select *, row_number() over (partition by repository_id order by seen) as g from g)
      select repository_id, cast(sum(n) as bigint) as scanned, cast((select count(*) from r where r.repository_id = q.repository_id) - sum(n) as bigint) as omitted, count(*) filter (where g <= 3) as groups, cast(sum(case when g > 3 then n else 0 end) as bigint) as omitted_group_records from q group by 1""",
}
