"""Queries over snapshots, graphs, the evidence store, statistics, telemetry and reduction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.functions.text import stem_of
from tesserae.operators import graph as G
from tesserae.operators import reduce as R
from tesserae.operators import snapshots as N
from tesserae.operators import stats as T
from tesserae.operators import store as O
from tesserae.sources import telemetry as M


def _snapshots(spark, d):
    """Two states of the files: paths move, contents change, files come and go by the remainders of their ids."""
    f = table(spark, d, "indexed_files").select("repository_id", "file_id", F.col("file_path").alias("path"), F.sha2(F.coalesce("file_content", F.lit("")), 256).alias("hash"))
    old = f.filter("file_id % 17 <> 3").select("repository_id", "path", F.when(F.col("file_id") % 11 == 0, F.sha2("path", 256)).otherwise(F.col("hash")).alias("hash"))
    new = f.filter("file_id % 19 <> 5").select("repository_id", F.when(F.col("file_id") % 13 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "hash")
    return old, new


def snapshot_diff(spark, d):
    return N.diff(*_snapshots(spark, d))


def snapshot_stale(spark, d):
    return N.stale(*_snapshots(spark, d))


def incremental_index_plan(spark, d):
    old, new = _snapshots(spark, d)
    return N.index_plan(old, new).groupBy("repository_id", "action").agg(F.count(F.lit(1)).alias("files"))


def import_resolution(spark, d):
    return G.resolved_imports(table(spark, d, "indexed_files"))


def _linked(spark, d):
    """The files with imports that resolve: a specifier that names no file is taken to mean the first file of the repository with that stem,
    beside its own folder, so that its path is relative to the importer."""
    files = table(spark, d, "indexed_files").filter("file_path is not null")
    named = files.filter(F.col("file_path").rlike(r"\.[cm]?[jt]sx?$")).groupBy("repository_id", stem_of(F.col("file_path")).alias("name")).agg(F.min("file_path").alias("target"))
    refs = G.imports_of(files).withColumn("name", F.regexp_extract("specifier", r"([^/.]+)(?:\.\w+)?$", 1))
    up = F.repeat(F.lit("../"), F.size(F.split("file_path", "/")) - 1)
    said = refs.join(named, ["repository_id", "name"]).select("repository_id", "file_path", F.concat(F.lit("import x from './"), up, "target", F.lit("';")).alias("line")).distinct()
    content = said.groupBy("repository_id", "file_path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("file_content"))
    return files.drop("file_content").join(content, ["repository_id", "file_path"], "left")


def import_expansion(spark, d):
    """Files reached from tests over resolved imports; see _linked for what the imports are."""
    files = _linked(spark, d)
    edges = G.resolved_imports(files).filter("outcome = 'ok'").select("repository_id", "file_path", "specifier", "target")
    return G.expand(edges, files.filter("is_test").select("repository_id", "file_path"), 2, None).select("repository_id", "file_path", "depth")


def chunk_quota(spark, d):
    c = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])
    return O.quota_append(c, ["artifact_id"], "seq", [], "chunk_text", 500).select("artifact_id", "seq", "available", "kept_bytes", "complete")


def retention_sessions(spark, d):
    s = table(spark, d, "agent_sessions")
    return O.newest_kept(s, ["repository_id"], "created_at", "session_id", 5, F.lit("2026-04-01 00:00:00").cast("timestamp")).select("session_id", "kept")


def retention_artifacts(spark, d):
    a = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"]).groupBy("artifact_id").agg(F.sum(F.octet_length("chunk_text")).alias("bytes"), F.min("chunk_time").alias("since"))
    a = a.withColumn("place", F.unix_micros("since")).withColumn("g", F.lit(1))
    return O.pruned_artifacts(a, ["g"], "place", ["artifact_id"], F.col("bytes"), F.col("since") < F.lit("2026-03-15 00:00:00").cast("timestamp"), 100_000).select("artifact_id", "pruned")


def orphaned_chunks(spark, d):
    r = table(spark, d, "run_results").filter("run_status = 'failure'").select("artifact_id").filter("artifact_id is not null").distinct()
    return table(spark, d, "artifact_chunks").join(r, "artifact_id", "left_anti").groupBy("stream").agg(F.count(F.lit(1)).alias("chunks"))


def session_epochs(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    r = O.session_epochs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")
    return r.select("event_id", "epoch", "rejected")


def repeated_failure(spark, d):
    r = table(spark, d, "run_results").dropDuplicates(["run_id"])
    return O.repeated_failures(r).select("run_id", "repeats")


def replay_rollup(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    kept = F.octet_length(F.regexp_replace("text", r"(?m)^[ \t]*\r?\n", ""))
    cases = docs.select("lang", F.octet_length("text").cast("long").alias("original"), kept.cast("long").alias("reduced"), (F.octet_length("text") >= kept).alias("passed"))
    return T.replay_rollup(cases, "lang")


def _results(spark, d):
    o = table(spark, d, "orders")
    cond = F.when(F.col("o_orderkey") % 3 == 0, "native").when(F.col("o_orderkey") % 3 == 1, "tuned").otherwise("treated")
    return o.select(
        F.col("o_custkey").cast("string").alias("task"), F.row_number().over(Window.partitionBy("o_custkey", cond).orderBy("o_orderkey")).cast("int").alias("repeat"), cond.alias("condition"),
        (F.col("o_orderstatus") == "F").alias("success"), F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice")).cast("long")).alias("tokens"), F.col("o_orderpriority").alias("token_source"),
    )


def condition_rollup(spark, d):
    return T.condition_rollup(_results(spark, d), ["native", "tuned", "treated", "none"])


def paired_differences(spark, d):
    return T.paired_differences(_results(spark, d), "treated", "native")


def paired_bootstrap(spark, d):
    p = paired_differences(spark, d).withColumn("g", F.lit("treated-native")).withColumn("_o", F.col("task").cast("long"))
    return T.bootstrap_by(p, "g", "success_difference")


def plan_cross_product(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("task"))
    repeats = spark.range(3).select(F.col("id").cast("int").alias("repeat"))
    conditions = spark.createDataFrame([("native",), ("tuned",), ("treated",)], "condition string")
    return n.crossJoin(F.broadcast(repeats)).crossJoin(F.broadcast(conditions))  # three and three rows


def plan_shuffled(spark, d):
    rows = [tuple(r) for r in plan_cross_product(spark, d).orderBy("task", "repeat", "condition").collect()]  # 225 rows: tasks x 3 x 3
    return spark.createDataFrame([(i, *r) for i, r in enumerate(T.seeded_shuffle(rows, 19))], "place int, task string, repeat int, condition string")


def _kv(k, v):
    return F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))


def otlp_logs(spark, d):
    e = table(spark, d, "usage_deliveries").filter("usage_scope = 'claude-otel-api-request'")
    rec = F.struct(F.struct(F.lit("x.api_request").alias("stringValue")).alias("body"), F.array(_kv("request_id", F.col("delivery_id")), _kv("input_tokens", F.col("input_tokens")), _kv("cache_read_tokens", F.col("cached_input_tokens")), _kv("cache_creation_tokens", F.col("cache_write_tokens")), _kv("output_tokens", F.col("output_tokens"))).alias("attributes"))
    j = _envelopes(e, rec, "scopeLogs", "logRecords", "resourceLogs")
    return M.log_requests(j, "bucket", "j").select(F.col("request_id").cast("long").alias("delivery_id"), F.col("attributes")["repo"].alias("repo"), "input", "cached", "written", "output", "total")


def _envelopes(rows, record, scopes, records, resources):
    """Exports of some dozens of records each: several resources in a text, two scopes in a resource, several records in a scope."""
    of = rows.groupBy(F.floor(F.col("delivery_id") / 40).alias("bucket"), "repository_id").agg(F.collect_list(record).alias("r"))  # at most 40
    parts = F.array(F.struct(F.slice("r", 1, 2).alias(records)), F.struct(F.slice("r", 3, 40).alias(records)))
    res = F.struct(F.struct(F.array(_kv("repo", F.col("repository_id"))).alias("attributes")).alias("resource"), parts.alias(scopes))
    return of.groupBy("bucket").agg(F.collect_list(res).alias("x")).select("bucket", F.to_json(F.struct(F.col("x").alias(resources))).alias("j"))


def otlp_metrics(spark, d):
    e = table(spark, d, "usage_deliveries").filter("usage_scope = 'claude-otel-token-metric' and event_time is not null")
    point = F.struct(F.array(_kv("type", F.lit("input")), _kv("id", F.col("delivery_id"))).alias("attributes"), (F.unix_micros("event_time") * 1000).cast("string").alias("timeUnixNano"), F.col("input_tokens").cast("string").alias("asInt"))
    metric = F.struct(F.lit("token.usage").alias("name"), F.struct(F.when(F.col("counter_kind") == "cumulative", 2).otherwise(1).alias("aggregationTemporality"), F.array(point, _other(point)).alias("dataPoints")).alias("sum"))
    j = _envelopes(e, metric, "scopeMetrics", "metrics", "resourceMetrics")
    rows = M.metric_points(j, "bucket", "j", "token.usage").filter(F.col("attributes")["type"] == "input")
    return rows.select(F.col("attributes")["id"].cast("long").alias("delivery_id"), "temporality", F.col("attributes")["repo"].alias("repo"), (F.col("time_nanos") / 1000).cast("long").alias("micros"), "value")


def _other(point):
    """A second point of the same metric, of another type."""
    return F.struct(F.array(_kv("type", F.lit("output")), _kv("id", F.col("delivery_id"))).alias("attributes"), point["timeUnixNano"].alias("timeUnixNano"), F.lit("1").alias("asInt"))


def reduced_documents(spark, d):
    return R.reduced_outputs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "reducer_id", "reason", "original_bytes", "reduced_bytes")


def event_windows(spark, d):
    """An extension: tumbling windows."""
    e = table(spark, d, "events").withColumn("w", F.window("ts", "1 day"))
    return e.groupBy(F.col("w.start").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (snapshot_diff, snapshot_stale, incremental_index_plan, import_resolution, import_expansion, chunk_quota, retention_sessions, retention_artifacts, orphaned_chunks, session_epochs, repeated_failure, replay_rollup, condition_rollup, paired_differences, paired_bootstrap, plan_cross_product, plan_shuffled, otlp_logs, otlp_metrics, reduced_documents, event_windows)}

_SNAP = """f as (select repository_id, file_id, file_path as path, sha256(coalesce(file_content, '')) as hash from indexed_files),
  o as (select repository_id, path, case when file_id % 11 = 0 then sha256(path) else hash end as hash from f where file_id % 17 <> 3),
  n as (select repository_id, case when file_id % 13 = 1 then 'moved/' || path else path end as path, hash from f where file_id % 19 <> 5)"""
_DEDUP = "c as (select distinct on (artifact_id, seq) * from artifact_chunks)"
_RESULTS = """r as (select cast(o_custkey as varchar) as task, row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey) as repeat,
  case o_orderkey % 3 when 0 then 'native' when 1 then 'tuned' else 'treated' end as condition, o_orderstatus = 'F' as success, case when o_orderkey % 5 > 0 then cast(floor(o_totalprice + 0.5) as bigint) end as tokens, o_orderpriority as token_source from orders)"""
_IMPORTS = r"""i as (select distinct repository_id, file_path, unnest(regexp_extract_all(file_content, '(?m)^\s*(?:import|export)\b[^''";]*?(?:from\s*)?[''"]([^''"\n]+)[''"]', 1)) as specifier from indexed_files),
  b as (select *, regexp_replace(regexp_replace(file_path, '/?[^/]*$', '') || '/' || specifier, '/(?:\./)+', '/', 'g') as raw from i where regexp_matches(specifier, '^\.\.?/')),
  n as (select * exclude raw, regexp_replace(raw, '^/', '') as base, regexp_extract(regexp_extract(raw, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) as ext from b),
  w as (select repository_id, file_path, specifier, 0 as rank, base as target from n where ext in ('.ts','.tsx','.mts','.cts','.js','.jsx','.mjs','.cjs')
    union all select repository_id, file_path, specifier, 1, regexp_replace(base, '\.[^./]*$', '') || x from n, (values ('.js','.ts'),('.js','.tsx'),('.jsx','.tsx'),('.mjs','.mts'),('.cjs','.cts')) v(e, x) where ext = e
    union all select repository_id, file_path, specifier, 1, base || p || x from n, (values (''),('/index')) q(p), (values ('.ts'),('.tsx'),('.mts'),('.cts'),('.js'),('.jsx'),('.mjs'),('.cjs')) v(x) where ext = ''),
  m as (select repository_id, file_path, specifier, min(rank) as rank, count(*) filter (where rank = 1) as k, arg_min(target, (rank, target)) as target from w semi join (select repository_id as r, file_path as p from indexed_files) e on w.repository_id = e.r and w.target = e.p group by 1, 2, 3),
  res as (select n.repository_id, n.file_path, n.specifier, case when regexp_matches(n.specifier, '[\\\x00?#]') then 'unsupported_specifier' when regexp_matches(base, '^\.\.(?:/|$)') then 'outside_repository' when m.target is null then 'unresolved' when m.rank = 1 and k > 1 then 'ambiguous' else 'ok' end as outcome, m.target
    from n left join m using (repository_id, file_path, specifier))"""
SQL = {
    "snapshot_diff": f"""with {_SNAP}, a as (select n.*, row_number() over (partition by n.repository_id, n.hash order by n.path) as k from n anti join o using (repository_id, path)),
      g as (select o.*, row_number() over (partition by o.repository_id, o.hash order by o.path) as k from o anti join n using (repository_id, path)), p as (select a.repository_id ar, g.repository_id gr, a.path ap, g.path gp, a.hash ah from a full join g on a.repository_id = g.repository_id and a.hash = g.hash and a.k = g.k)
      select n.repository_id, 'modified' as change, n.path, null as previous_path, n.hash from n join o using (repository_id, path) where n.hash is distinct from o.hash
      union all select coalesce(ar, gr), case when ap is null then 'deleted' when gp is null then 'added' else 'renamed' end, coalesce(ap, gp), case when ap is not null then gp end, ah from p""",
    "snapshot_stale": f"with {_SNAP} select o.repository_id, o.path, case when n.path is null then 'vanished' else 'changed' end as state from o left join n using (repository_id, path) where n.hash is distinct from o.hash",
    "incremental_index_plan": f"with {_SNAP} select repository_id, case when n.path is null then 'delete' when o.path is null then 'index' when o.hash = n.hash then 'unchanged' else 'reindex' end as action, count(*) as files from o full join n using (repository_id, path) group by 1, 2",
    "import_resolution": f"with {_IMPORTS} select repository_id, file_path, specifier, outcome, case when outcome = 'ok' then target end as target from res",
    "import_expansion": rf"""with {_IMPORTS}, t as (select repository_id, regexp_replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]+$', ''), '\.(test|spec)$', '') as name, min(file_path) as target from indexed_files where regexp_matches(file_path, '\.[cm]?[jt]sx?$') group by 1, 2),
      e as (select i.repository_id, i.file_path, t.target from i join t on i.repository_id = t.repository_id and regexp_extract(i.specifier, '([^/.]+)(?:\.\w+)?$', 1) = t.name), roots as (select repository_id, file_path from indexed_files where is_test),
      d1 as (select distinct repository_id, target as file_path from e semi join roots using (repository_id, file_path)), n1 as (select * from d1 anti join roots using (repository_id, file_path)),
      d2 as (select distinct repository_id, target as file_path from e semi join n1 using (repository_id, file_path)), n2 as (select * from d2 anti join roots using (repository_id, file_path) anti join n1 using (repository_id, file_path))
      select *, 1 as depth from n1 union all select *, 2 from n2""",
    "chunk_quota": f"with {_DEDUP}, s as (select *, coalesce(strlen(chunk_text), 0) as n, sum(coalesce(strlen(chunk_text), 0)) over (partition by artifact_id order by seq) as u from c) select artifact_id, seq, cast(greatest(0, 500 - (u - n)) as bigint) as available, cast(least(greatest(0, 500 - (u - n)), n) as bigint) as kept_bytes, greatest(0, 500 - (u - n)) >= n as complete from s",
    "retention_sessions": "select session_id, row_number() over (partition by repository_id order by created_at desc nulls last, session_id desc) <= 5 and coalesce(created_at >= timestamp '2026-04-01', false) as kept from agent_sessions",
    "retention_artifacts": f"with {_DEDUP}, a as (select artifact_id, sum(strlen(chunk_text)) as bytes, min(chunk_time) as since from c group by 1), s as (select *, sum(coalesce(bytes, 0)) over () - sum(coalesce(bytes, 0)) over (order by since nulls first, artifact_id rows unbounded preceding) + coalesce(bytes, 0) as used from a) select artifact_id, coalesce(since < timestamp '2026-03-15', false) or used > 100000 as pruned from s",
    "orphaned_chunks": "select stream, count(*) as chunks from artifact_chunks where artifact_id not in (select artifact_id from run_results where run_status = 'failure' and artifact_id is not null) group by 1",
    "session_epochs": """with w as (select *, coalesce(bool_or(event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as rejected from events)
      select event_id, cast(sum(case when event_type in ('purchase','error') and not rejected then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as epoch, rejected from w""",
    "repeated_failure": "with r as (select distinct on (run_id) * from run_results) select run_id, not coalesce(child_exit_code = 0, false) and row_number() over (partition by repository_id, session_id, executable, args, cwd, source_fingerprint, child_exit_code, timed_out, cancelled order by created_at, run_id) > 1 as repeats from r",
    "replay_rollup": r"""with c as (select lang, strlen(text) as a, strlen(regexp_replace(text, '(?m)^[ \t]*\r?\n', '', 'g')) as b from documents where text is not null)
      select lang, count(*) as cases, cast(sum(a) as bigint) as original_bytes, cast(sum(b) as bigint) as reduced_bytes, case when sum(a) > 0 then (sum(a) - sum(b)) / sum(a) end as saved_share, bool_and(a >= b) as all_passed from c group by 1""",
    "condition_rollup": f"""with {_RESULTS}, g as (select condition, count(*) as runs, count(*) filter (where success) as successes, case when count(*) = count(tokens) and count(distinct token_source) = 1 and count(token_source) = count(*) then cast(sum(tokens) as bigint) end as tokens from r group by 1)
      select v.condition, coalesce(runs, 0) as runs, coalesce(successes, 0) as successes, tokens, case when runs > 0 then successes / runs end as success_rate, case when successes > 0 then tokens / successes end as tokens_per_success from (values ('native'), ('tuned'), ('treated'), ('none')) v(condition) left join g using (condition)""",
    "paired_differences": f"""with {_RESULTS} select t.task, count(*) as repeats, avg(cast(t.success as int) - cast(b.success as int)) as success_difference, case when count(t.tokens - b.tokens) = count(*) then avg(t.tokens - b.tokens) end as token_difference
      from r t join r b on t.task = b.task and t.repeat = b.repeat and t.condition = 'treated' and b.condition = 'native' group by 1""",
    "plan_cross_product": "select n_name as task, cast(i as integer) as repeat, condition from nation, range(3) t(i), (values ('native'), ('tuned'), ('treated')) c(condition)",
    "otlp_logs": "select delivery_id, repository_id as repo, input_tokens as input, cached_input_tokens as cached, cache_write_tokens as written, output_tokens as output, input_tokens + cached_input_tokens + cache_write_tokens + output_tokens as total from usage_deliveries where usage_scope = 'claude-otel-api-request'",
    "otlp_metrics": "select delivery_id, case when counter_kind = 'cumulative' then 2 else 1 end as temporality, repository_id as repo, epoch_us(event_time) as micros, input_tokens as value from usage_deliveries where usage_scope = 'claude-otel-token-metric' and event_time is not null",
    "event_windows": "select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
