"""Queries of reports: run lists, filters, counters, identifiers, fingerprints, sanitized records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions.redaction import is_strict_json, redacted, sanitized_json
from tesserae.functions.runtime import table
from tesserae.functions.tokens import exact_tokens, resolved_encoding, ship
from tesserae.operators.context import fragments, packages
from tesserae.operators.search import with_related
from tesserae.plans.text import TASKS, relevance_scores
from tesserae.sources.files import fingerprint

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _runs(spark, d):
    return table(spark, d, "run_results").dropDuplicates(["run_id"])


def run_states(spark, d):
    """Status and exit code that a wrapper passes on."""
    c = F.col
    return _runs(spark, d).select("run_id", X.status_of(c("child_exit_code")).alias("state"), X.wrapper_exit_code(c("child_exit_code"), F.coalesce("timed_out", F.lit(False)), F.coalesce("cancelled", F.lit(False))).alias("exit_code"))


def run_filter(spark, d):
    """Failed runs whose command line holds a word, in any case."""
    line = F.lower(F.concat_ws(" ", "executable", F.array_join("args", " ")))
    return _runs(spark, d).filter((F.col("run_status") == "failure") & line.contains("check")).select("run_id", "executable")


def session_search(spark, d):
    s = table(spark, d, "agent_sessions")
    return s.filter(F.lower(F.concat_ws(" ", "task", "session_id")).contains("cache")).select("session_id", "session_status")


def dashboard_counters(spark, d):
    runs = _runs(spark, d).groupBy("repository_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("run_status") == "failure").alias("failures"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"))
    sessions = table(spark, d, "agent_sessions").groupBy("repository_id").agg(F.count_if(F.col("session_status") == "active").alias("active_sessions"))
    return runs.join(sessions, "repository_id", "full_outer").select("repository_id", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), "mean_ms", F.coalesce("active_sessions", F.lit(0)).cast("long").alias("active_sessions"))


def newest_runs(spark, d):
    """The 200 newest runs that a report shows of each repository."""
    from pyspark.sql import Window

    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return _runs(spark, d).select("repository_id", "run_id", "created_at", F.row_number().over(w).alias("place")).filter("place <= 200").select("repository_id", "run_id", "place")


def evidence_ids(spark, d):
    f = table(spark, d, "indexed_files")
    return f.select("file_id", X.derived_id("source", 40, F.col("repository_id"), F.lit(""), F.col("file_path"), F.col("content_hash"), F.lit(1), F.col("line_count")).alias("evidence_id"))


def repository_fingerprints(spark, d):
    f = table(spark, d, "indexed_files").filter("octet_length(file_content) < 1048576")
    return fingerprint(f.select("repository_id", F.col("file_path").alias("path"), F.sha2("file_content", 256).alias("hash")), "repository_id").select("repository_id", "files", "fingerprint")


def command_identity(spark, d):
    """Runs by the identity of their command."""
    r = _runs(spark, d).withColumn("k", X.command_key(F.col("executable"), F.col("args"), F.col("cwd")))
    return r.groupBy("k").agg(F.min("executable").alias("executable"), F.count(F.lit(1)).alias("runs")).select("executable", "runs")


def unreported_sessions(spark, d):
    """Sessions without any run: a set difference."""
    return table(spark, d, "agent_sessions").select("session_id").subtract(_runs(spark, d).select("session_id"))


def sanitized_events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", is_strict_json(F.col("props")).alias("valid"), sanitized_json(F.col("props")).alias("props"))


def redacted_chunks(spark, d):
    """Output chunks by the core's own ten rules."""
    c = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])
    return c.select("artifact_id", "seq", redacted(F.col("chunk_text")).alias("text"))


def exact_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", exact_tokens(F.col("text"), ship(spark, VOCABULARY)).alias("tokens"))


def encoding_resolution(spark, d):
    known = {"model-a": "wide", "model-b": "narrow"}
    m = F.when(F.col("n_nationkey") % 3 == 0, "model-a").when(F.col("n_nationkey") % 3 == 1, "model-x")
    r = resolved_encoding(m, F.lit(None).cast("string"), known)
    return table(spark, d, "nation").select("n_name", r["encoding"].alias("encoding"), r["mapping"].alias("mapping"))


def context_fragments(spark, d):
    tasks = spark.createDataFrame(TASKS, "task_id string, task string")
    scores = with_related(relevance_scores(spark, d), table(spark, d, "indexed_files")).join(F.broadcast(tasks), "task_id")  # three tasks
    none = scores.select("task_id", "file_id").filter("false")
    f = fragments(table(spark, d, "indexed_files"), table(spark, d, "source_symbols"), scores, none)
    return f.groupBy("task_id").agg(F.count(F.lit(1)).alias("fragments"), F.countDistinct("file_id").alias("files"), F.sum("score").alias("points"))


def context_packages(spark, d):
    """A package of fragments for each task under a budget of 4,000 tokens."""
    tasks = spark.createDataFrame(TASKS, "task_id string, task string")
    files = table(spark, d, "indexed_files")
    scores = with_related(relevance_scores(spark, d), files).join(F.broadcast(tasks), "task_id")  # three tasks
    f = fragments(files, table(spark, d, "source_symbols"), scores, scores.select("task_id", "file_id").filter("false")).withColumnRenamed("file_path", "path")
    one = f.withColumn("evidence_id", F.concat_ws("-", "evidence_id", "file_id", "symbol")).dropDuplicates(["task_id", "evidence_id"])
    p = packages(one, tasks.withColumn("budget", F.lit(4000)))
    return p.select("task_id", "status", "tokens", F.size("sources").alias("sources"), "omitted_count")


QUERIES = {f.__name__: f for f in (context_packages, run_states, run_filter, session_search, dashboard_counters, newest_runs, evidence_ids, repository_fingerprints, command_identity, unreported_sessions, sanitized_events, redacted_chunks, exact_token_counts, encoding_resolution, context_fragments)}

_R = "with r as (select distinct on (run_id) * from run_results)"
SQL = {
    "run_states": _R + " select run_id, case when child_exit_code is null then 'unknown' when child_exit_code = 0 then 'success' else 'failure' end as state, case when timed_out then 124 when cancelled then 130 else coalesce(child_exit_code, 1) end as exit_code from r",
    "run_filter": _R + " select run_id, executable from r where run_status = 'failure' and contains(lower(concat_ws(' ', executable, array_to_string(args, ' '))), 'check')",
    "session_search": "select session_id, session_status from agent_sessions where contains(lower(concat_ws(' ', task, session_id)), 'cache')",
    "dashboard_counters": _R
    + """, a as (select repository_id, count(*) as runs, count(*) filter (where run_status = 'failure') as failures, round(avg(duration_ms), 1) as mean_ms from r group by 1), s as (select repository_id, count(*) filter (where session_status = 'active') as active_sessions from agent_sessions group by 1)
      select repository_id, coalesce(runs, 0) as runs, coalesce(failures, 0) as failures, mean_ms, coalesce(active_sessions, 0) as active_sessions from a full join s using (repository_id)""",
    "newest_runs": _R + ", w as (select repository_id, run_id, cast(row_number() over (partition by repository_id order by created_at desc nulls last, run_id desc) as integer) as place from r) select * from w where place <= 200",
    "evidence_ids": "select file_id, 'source_' || substr(sha256(concat_ws('|', coalesce(repository_id, ''), '', coalesce(file_path, ''), coalesce(content_hash, ''), '1', coalesce(cast(line_count as varchar), ''))), 1, 40) as evidence_id from indexed_files",
    "repository_fingerprints": """with l as (select repository_id, file_path || ':' || sha256(file_content) as line from indexed_files where strlen(file_content) < 1048576),
      k as (select *, row_number() over (partition by repository_id order by line) as n from l)
      select repository_id, count(*) as files, sha256(string_agg(line, chr(10) order by line)) as fingerprint from k where n <= 10000 group by 1""",
    "command_identity": _R + " select executable, count(*) as runs from r group by executable, args, cwd",
    "unreported_sessions": "select session_id from agent_sessions except select session_id from run_results",
    "encoding_resolution": "select n_name, case when n_nationkey % 3 = 0 then 'wide' end as encoding, case n_nationkey % 3 when 0 then 'verified' when 1 then 'unknown' else 'unspecified' end as mapping from nation",
}
