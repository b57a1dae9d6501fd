"""Queries over records: upserts, sequence numbers, retention of packages, pages, admission, sums, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions.runtime import table
from tesserae.operators import records as R
from tesserae.operators.graph import import_issues, resolved_imports
from tesserae.operators.symbols import declared_symbols, references_of
from tesserae.plans.evidence import _snapshots


def _chunks(spark, d):
    return table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])


def _runs(spark, d):
    return table(spark, d, "run_results").dropDuplicates(["run_id"])


def index_upsert(spark, d):
    """The next version of an index after files came, changed and went, by repository."""
    old, new = _snapshots(spark, d)
    gone = old.select("repository_id", "path").exceptAll(new.select("repository_id", "path"))
    after = R.upserted(old, new, ["repository_id", "path"], gone)
    return after.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.min("hash").alias("least"), F.max("hash").alias("greatest"))


def next_numbers(spark, d):
    """The number that the next chunk of each artifact of a run gets."""
    owners = _runs(spark, d).filter("artifact_id is not null").select("artifact_id")
    return R.next_sequence(owners, _chunks(spark, d), "artifact_id", "seq")


def package_retention(spark, d):
    """Sessions as packages of their runs' artifacts, at most 50 of a repository and 120 artifacts."""
    p = _runs(spark, d).filter("session_id is not null").groupBy("repository_id", F.col("session_id").alias("package_id")).agg(F.max("created_at").alias("created_at"), F.collect_set("artifact_id").alias("evidence"))
    return R.kept_packages(p, 50, 120)


def unreferenced_artifacts(spark, d):
    """Artifacts that no failed run refers to."""
    packs = _runs(spark, d).filter("run_status = 'failure' and artifact_id is not null").groupBy("session_id").agg(F.collect_set("artifact_id").alias("refs"))
    return R.unreferenced(_chunks(spark, d).select("artifact_id").distinct(), packs, "artifact_id", "refs")


def file_pages(spark, d):
    """Lines 11 to 30 of each file; stale where the stored hash is not that of the content."""
    f = R.source_page(table(spark, d, "indexed_files"), 10, 20, F.col("content_hash"))
    return f.select("file_id", "stale", "total_lines", "next_offset", F.sha2(F.coalesce("page", F.lit("")), 256).alias("page_digest"))


def spend_admission(spark, d):
    """Deliveries of each session in order of arrival, admitted up to 200,000 tokens and 50 requests."""
    u = table(spark, d, "usage_deliveries")
    out = R.admitted(u, ["session_id"], [F.col("delivered_at").asc_nulls_first(), F.col("delivery_id")], F.coalesce("total_tokens", F.lit(0)), 200_000, 50)
    return out.select("delivery_id", "admitted")


def repeated_identifiers(spark, d):
    """Keys of run records that were stored more than once."""
    return R.duplicate_keys(table(spark, d, "run_results"), ["run_id"])


def output_sums(spark, d):
    """Known and cached input of each repository, unknown as 0, and what the cache saved."""
    u = table(spark, d, "usage_deliveries")
    a, b = F.sum(F.coalesce("input_tokens", F.lit(0))), F.sum(F.coalesce("cached_input_tokens", F.lit(0)))
    return u.groupBy("repository_id").agg(a.alias("input"), b.alias("cached"), (a - b).alias("rest"))


def session_runs(spark, d):
    """Runs of each session, none included."""
    r = _runs(spark, d).filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("ms"))
    return table(spark, d, "agent_sessions").select("session_id").join(r, "session_id", "left").select("session_id", F.coalesce("runs", F.lit(0)).alias("runs"), F.round("ms", 3).alias("ms"))


def chain_totals(spark, d):
    """Runs of each session in order, with their place and the milliseconds up to each."""
    r = _runs(spark, d).filter("session_id is not null")
    return R.running_totals(r, ["session_id"], [F.col("created_at"), F.col("run_id")], F.floor("duration_ms")).select("run_id", "nth", "upto")


def chunk_arrivals(spark, d):
    """The first four chunks of each artifact."""
    return R.first_arrivals(_chunks(spark, d), ["artifact_id"], [F.col("seq")], 4).select("artifact_id", "seq")


def index_totals(spark, d):
    """Files, symbols and lines of each language."""
    s = table(spark, d, "source_symbols").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, d, "indexed_files").join(s, "file_id", "left")
    return f.groupBy("file_language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"), F.sum("line_count").alias("lines"))


def formatted_sizes(spark, d):
    """Sizes and shares as a report shows them."""
    f = table(spark, d, "indexed_files")
    n = F.octet_length("file_content")
    return f.select("file_id", X.formatted_bytes(n).alias("size"), X.formatted_share(F.length("file_content"), n).alias("share"))


def symbol_digests(spark, d):
    """A digest of the names and bodies of each file's symbols, in the order of their names."""
    s = table(spark, d, "source_symbols").filter("body is not null")
    return X.files_digest(s, ["file_id"], F.concat_ws("#", "symbol_name", "symbol_id"), F.col("body"))


def import_reports(spark, d):
    """For each repository the imports that lead nowhere: the first twenty and how many more."""
    return import_issues(resolved_imports(table(spark, d, "indexed_files"))).select("repository_id", F.size("issues").alias("issues"), "omitted")


def symbol_declarations(spark, d):
    """Top-level declarations by their beginnings, counted by kind."""
    return declared_symbols(table(spark, d, "indexed_files")).groupBy("symbol_kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))


def module_references(spark, d):
    """Static and dynamic references of files to modules, by kind."""
    return references_of(table(spark, d, "indexed_files")).groupBy("dynamic", "confidence").agg(F.count(F.lit(1)).alias("references"))


QUERIES = {f.__name__: f for f in (index_upsert, next_numbers, package_retention, unreferenced_artifacts, file_pages, spend_admission, repeated_identifiers, output_sums, session_runs, chain_totals, chunk_arrivals, index_totals, formatted_sizes, symbol_digests, import_reports, symbol_declarations, module_references)}

_R = "with r as (select distinct on (run_id) * from run_results)"
_C = "with c as (select distinct on (artifact_id, seq) * from artifact_chunks)"
SQL = {
    "index_upsert": """with f as (select repository_id, file_id, file_path as path, sha256(coalesce(file_content, '')) as hash from indexed_files where file_id % 19 <> 5)
      select repository_id, count(*) as files, min(hash) as least, max(hash) as greatest from f group by 1""",
    "next_numbers": _C + ", o as (select distinct artifact_id from run_results where artifact_id is not null) select artifact_id, coalesce(max(cast(seq as bigint)), -1) + 1 as next_seq from o left join c using (artifact_id) group by 1",
    "unreferenced_artifacts": "select distinct artifact_id from artifact_chunks where artifact_id not in (select artifact_id from run_results where run_status = 'failure' and artifact_id is not null)",
    "file_pages": """with f as (select *, string_split(file_content, chr(10)) as l, coalesce(sha256(file_content) <> content_hash, true) as stale from indexed_files)
      select file_id, stale, cast(len(l) as bigint) as total_lines, case when not stale and len(l) > 30 then 30 end as next_offset, sha256(case when stale then '' else coalesce(array_to_string(l[11:30], chr(10)), '') end) as page_digest from f""",
    "spend_admission": """select delivery_id, sum(coalesce(total_tokens, 0)) over w <= 200000 and row_number() over w <= 50 as admitted from usage_deliveries
      window w as (partition by session_id order by delivered_at nulls first, delivery_id rows unbounded preceding)""",
    "repeated_identifiers": "select run_id, count(*) as rows from run_results group by 1 having count(*) > 1",
    "output_sums": "select repository_id, cast(sum(coalesce(input_tokens, 0)) as bigint) as input, cast(sum(coalesce(cached_input_tokens, 0)) as bigint) as cached, cast(sum(coalesce(input_tokens, 0)) - sum(coalesce(cached_input_tokens, 0)) as bigint) as rest from usage_deliveries group by 1",
    "session_runs": _R + " select s.session_id, count(run_id) as runs, round(sum(duration_ms), 3) as ms from agent_sessions s left join r using (session_id) group by 1",
    "chain_totals": _R + " select run_id, row_number() over w as nth, cast(sum(coalesce(cast(floor(duration_ms) as bigint), 0)) over w as bigint) as upto from r where session_id is not null window w as (partition by session_id order by created_at nulls first, run_id rows unbounded preceding)",
    "chunk_arrivals": _C + " select artifact_id, seq from c qualify row_number() over (partition by artifact_id order by seq) <= 4",
    "index_totals": "with s as (select file_id, count(*) as n from source_symbols group by 1) select file_language, count(*) as files, cast(sum(coalesce(n, 0)) as bigint) as symbols, cast(sum(line_count) as bigint) as lines from indexed_files left join s using (file_id) group by 1",
    "formatted_sizes": """select file_id, case when strlen(file_content) < 1024 then strlen(file_content) || ' B' when strlen(file_content) < 1048576 then printf('%.1f KiB', floor(strlen(file_content) / 1024 * 10 + 0.5) / 10) else printf('%.1f MiB', floor(strlen(file_content) / 1048576 * 10 + 0.5) / 10) end as size,
      case when strlen(file_content) > 0 then printf('%.1f%%', floor(length(file_content) / strlen(file_content) * 1000 + 0.5) / 10) end as share from indexed_files""",
    "symbol_digests": "select file_id, sha256(string_agg(concat_ws('#', symbol_name, symbol_id) || chr(1) || body, chr(2) order by concat_ws('#', symbol_name, symbol_id))) as digest from source_symbols where body is not null group by 1",
}
