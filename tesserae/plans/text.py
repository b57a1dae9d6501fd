"""Queries over files, paths, lines and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions.runtime import table
from tesserae.operators import lines as L
from tesserae.operators import search as S
from tesserae.operators.running import greedy_fill

TASKS = [("t1", "Fix the quota ledger and the sealed budget in session"), ("t2", "why does the snapshot cursor refresh the stale envelope"), ("t3", "add a test for artifact fingerprint digest")]


def _files(spark, d):
    return table(spark, d, "indexed_files")


def _tasks(spark):
    return spark.createDataFrame(TASKS, "task_id string, task string")


def file_bytes_tokens(spark, d):
    c = F.col("file_content")
    return _files(spark, d).select("file_id", X.size_bytes(c).alias("bytes"), X.estimated_tokens(c).alias("tokens3"), X.estimated_tokens(c, 2).alias("tokens2"), F.sha2(c, 256).alias("digest"))


def path_rules(spark, d):
    p = F.col("file_path")
    return _files(spark, d).select(
        "file_id", X.is_test_path(p).alias("test"), X.language_of(p).alias("language"), X.stem_of(p).alias("stem"), X.is_indexed_sensitive(p).alias("never_indexed"), X.is_runner_sensitive(p).alias("never_read"), X.normalized_path(p).alias("normal")
    )


def task_words_of_sessions(spark, d):
    return table(spark, d, "agent_sessions").select("session_id", F.array_join(X.task_words(F.col("task")), " ").alias("words"))


def file_line_counts(spark, d):
    r = L.blank_compacted(_files(spark, d), "file_id", "file_content")
    return r.select("file_id", "kept", "distinct_lines", F.sha2("compacted", 256).alias("digest"))


def document_line_runs(spark, d):
    return L.line_runs(table(spark, d, "documents"), "doc_id", "text").filter("occurrences > 1").select("doc_id", "start", "line", "occurrences")


def line_runs_roundtrip(spark, d):
    docs = table(spark, d, "documents")
    back = L.expanded_runs(L.line_runs(docs, "doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("pos").cast("string"), "line"), 256), 1, 8), 16, 10).cast("long")).alias("checksum"))
    return back.select("doc_id", "lines", "checksum")


def failure_latch(spark, d):
    c = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])
    r = L.latched_lines(c, ["artifact_id", "stream"], "seq", F.col("chunk_text"))
    return r.groupBy("artifact_id", "stream").agg(F.count_if("fails").alias("failures"), F.count_if("grouped").alias("grouped"), F.count_if("after_failure").alias("after"))


def symbol_hits_grouped(spark, d):
    s = table(spark, d, "source_symbols").join(_files(spark, d).select("file_id", "repository_id", "file_path"), "file_id")
    hits = s.select("repository_id", "symbol_id", F.concat_ws(":", "file_path", F.col("start_line").cast("string"), "symbol_name").alias("hit"))
    return L.grouped_hits(hits, "repository_id", "symbol_id", "hit").select("repository_id", "path", "first_place", F.array_join("matches", "|").alias("matches"))


def chunk_prefix_cap(spark, d):
    c = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])
    return L.capped_prefix(c, ["artifact_id"], "seq", [], F.octet_length("chunk_text"), 400).select("artifact_id", "seq", "used")


def chunk_pages(spark, d):
    c = table(spark, d, "artifact_chunks").dropDuplicates(["artifact_id", "seq"])
    return L.keyset_page(c, ["artifact_id"], "seq", 2, 3).select("artifact_id", "seq", "has_more")


def json_compaction(spark, d):
    f = _files(spark, d).filter("file_path like '%.json'")
    return f.select("file_id", X.size_bytes(X.compact_json(F.col("file_content"))).alias("bytes"), F.sha2(X.compact_json(F.col("file_content")), 256).alias("digest"))


def source_redaction(spark, d):
    r = X.redact_source(F.col("file_content"))
    return _files(spark, d).select("file_id", F.sha2(r, 256).alias("digest"), (r != F.col("file_content")).alias("changed"))


def search_matches(spark, d):
    return S.text_matches(_tasks(spark), _files(spark, d).select(F.col("file_id").alias("doc_id"), F.col("file_content").alias("content")))


def relevance_scores(spark, d):
    files = _files(spark, d)
    names = table(spark, d, "source_symbols").groupBy("file_id").agg(F.array_join(F.collect_set("symbol_name"), " ").alias("symbols"))
    named = files.select("file_id", "file_path").join(names, "file_id", "left").select("file_id", "file_path", F.concat_ws(" ", "file_path", "symbols").alias("names"))
    return S.relevance(_tasks(spark), named, search_matches(spark, d)).drop("reasons")


def relevance_reasons(spark, d):
    """Why each file has points for a task."""
    names = table(spark, d, "source_symbols").groupBy("file_id").agg(F.array_join(F.collect_set("symbol_name"), " ").alias("symbols"))
    named = _files(spark, d).select("file_id", "file_path").join(names, "file_id", "left").select("file_id", "file_path", F.concat_ws(" ", "file_path", "symbols").alias("names"))
    return S.relevance(_tasks(spark), named, search_matches(spark, d)).select("task_id", "file_id", F.array_join("reasons", "; ").alias("reasons"))


def budget_selection(spark, d):
    f = _files(spark, d).select("repository_id", "file_id", F.greatest(F.lit(1), X.estimated_tokens(F.col("file_content"), 2)).alias("cost"), F.xxhash64("file_id").alias("h"))
    f = f.withColumn("rank", F.col("file_id") % 97)
    return greedy_fill(f, ["repository_id"], [F.desc("rank")], "cost", F.lit(8000), "file_id").select("repository_id", "file_id", "cost")


def report_cells(spark, d):
    r = table(spark, d, "run_results").dropDuplicates(["run_id"])
    cols = ["run_id", "session_id", "executable", "run_status", "child_exit_code"]
    return r.select("run_id", F.concat_ws(",", *[X.csv_cell(F.col(c)) for c in cols]).alias("csv"))


QUERIES = {f.__name__: f for f in (file_bytes_tokens, path_rules, task_words_of_sessions, file_line_counts, document_line_runs, line_runs_roundtrip, failure_latch, symbol_hits_grouped, chunk_prefix_cap, chunk_pages, json_compaction, source_redaction, search_matches, relevance_scores, relevance_reasons, budget_selection, report_cells)}

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_EXT = ", ".join(f"'{w}'" for w in X.EXTENSION_WORDS)


def _words(c: str) -> str:
    apart = f"regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g')"
    return f"list_filter(list_distinct_in_order(regexp_extract_all(lower(replace({apart}, '_', ' ')), '[\\p{{L}}\\p{{N}}]{{2,}}')), lambda w: w not in ({_STOP}))"


def _in_order(sql: str) -> str:
    """DuckDB's list_distinct keeps no order; this does."""
    import re

    return re.sub(r"list_distinct_in_order\((.*?\]\{2,\}'\))\)", r"list_reduce(list_prepend(cast([] as varchar[]), list_transform(\1, lambda q: [q])), lambda acc, q: case when list_contains(acc, q[1]) then acc else list_concat(acc, q) end)", sql)


_DEDUP = "with c as (select distinct on (artifact_id, seq) * from artifact_chunks)"
_LINES = "regexp_split_to_array(coalesce({c}, ''), '\\r?\\n')"
_TASKS = "(values " + ", ".join(f"('{i}', '{t}')" for i, t in TASKS) + ") as tasks(task_id, task)"
_BM25 = f"""q as (select distinct task_id, unnest(list_filter({_in_order(_words("task"))}, lambda w: w not in ({_EXT}))[1:30]) as term from {_TASKS}),
  docs as (select file_id as doc_id, regexp_extract_all(lower(file_content), '[\\p{{L}}\\p{{N}}]+') as t from indexed_files where file_content is not null),
  size as (select count(*) as n_docs, avg(len(t)) as avg_len from docs),
  tf as (select doc_id, any_value(len) as len, term, count(*) as tf from (select doc_id, len(t) as len, unnest(t) as term from docs) where term in (select term from q) group by doc_id, term),
  df as (select term, count(*) as df from tf group by term),
  m as (select task_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as rank_score from tf join df using (term) join q using (term), size group by 1, 2),
  best as (select * from m qualify row_number() over (partition by task_id order by rank_score desc, doc_id) <= 300)"""
SQL = {
    "file_bytes_tokens": "select file_id, strlen(file_content) as bytes, cast(ceil(strlen(file_content) / 3) as bigint) as tokens3, cast(ceil(strlen(file_content) / 2) as bigint) as tokens2, sha256(file_content) as digest from indexed_files",
    "path_rules": r"""select file_id, regexp_matches(file_path, '(?i)(?:^|/)(?:__tests__|tests?)(?:/|$)|[.-](?:test|spec)\.[^.]+$') as test,
      case when regexp_matches(file_path, '(?i)\.(ts|mts|cts)$') then 'typescript' when regexp_matches(file_path, '(?i)\.tsx$') then 'tsx' when regexp_matches(file_path, '(?i)\.(js|jsx|mjs|cjs)$') then 'javascript' else 'text' end as language,
      regexp_replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]+$', ''), '\.(test|spec)$', '') as stem,
      list_bool_or(list_transform(string_split(file_path, '/'), lambda p: lower(p) in ('.git','node_modules','vendor','dist','build','coverage','.next','.nuxt','.cache','.turbo','__pycache__')
        or regexp_matches(p, '(?i)^(?:\.env(?:\..*)?|(?:id_rsa|id_ed25519|id_ecdsa|credentials|secrets?)(?:\..*)?|.*\.(?:pem|key|p12|pfx|jks|keystore|sqlite|sqlite3|db)(?:-wal|-shm)?)$'))) as never_indexed,
      regexp_matches(file_path, '(?i)(?:^|[\\/])(?:\.env(?:\..*)?|\.git|\.ssh|node_modules|vendor|dist|build|coverage|id_rsa|id_ed25519)(?:$|[\\/])|\.(?:pem|key|p12|pfx|keystore)$') as never_read,
      case when not (file_path like '/%' or list_has_any(string_split(file_path, '/'), ['', '.', '..'])) then file_path end as normal from indexed_files""",
    "task_words_of_sessions": _in_order(f"select session_id, case when task is not null then array_to_string(list_filter({_words('task')}, lambda w: w not in ({_EXT})), ' ') end as words from agent_sessions"),
    "file_line_counts": f"select file_id, coalesce(len(k), -1) as kept, coalesce(len(list_distinct(k)), -1) as distinct_lines, sha256(array_to_string(k, chr(10))) as digest from (select file_id, case when file_content is not null then list_filter({_LINES.format(c='file_content')}, lambda x: regexp_matches(x, '[^\\s\\x{{00a0}}\\x{{feff}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}]')) end as k from indexed_files)",
    "document_line_runs": f"""with l as (select doc_id, unnest(t) as line, generate_subscripts(t, 1) - 1 as pos from (select doc_id, {_LINES.format(c="text")} as t from documents where text is not null)),
      n as (select *, case when lag(line) over (partition by doc_id order by pos) is not distinct from line and pos > 0 then 0 else 1 end as new from l),
      r as (select *, sum(new) over (partition by doc_id order by pos) as run from n)
      select doc_id, min(pos) as start, first(line) as line, count(*) as occurrences from r group by doc_id, run having count(*) > 1""",
    "line_runs_roundtrip": f"""with l as (select doc_id, {_LINES.format(c='text')} as x from documents where text is not null),
      e as (select doc_id, unnest(x) as line, unnest(range(len(x))) as pos from l)
      select doc_id, count(*) as lines, cast(sum(cast('0x' || substr(sha256(pos || '|' || line), 1, 8) as bigint)) as bigint) as checksum from e group by 1""",
    "failure_latch": _DEDUP
    + r""", r as (select *, coalesce(regexp_matches(chunk_text, '^\s*(?:FAIL\b|FAILED\b|[×✕]\s|AssertionError\b|Error:|●\s)'), false) as fails from c),
      a as (select *, bool_or(fails) over (partition by artifact_id, stream order by seq) as after from r)
      select artifact_id, stream, count(*) filter (where fails) as failures,
      count(*) filter (where not after and coalesce(regexp_matches(chunk_text, '^\s*PASS\s+\S+\.[cm]?[jt]sx?(?:\s|$)|^\s*[✓√✔]\s+.+(?:\(\d+ tests?[^)]*\)|\d+(?:\.\d+)?\s?m?s)\s*$'), false)) as grouped, count(*) filter (where after) as after from a group by 1, 2""",
    "symbol_hits_grouped": "select repository_id, file_path as path, min(symbol_id) as first_place, string_agg(start_line || ':' || symbol_name, '|' order by symbol_id) as matches from source_symbols join indexed_files using (file_id) group by 1, 2",
    "chunk_prefix_cap": _DEDUP + ", s as (select artifact_id, seq, cast(sum(coalesce(strlen(chunk_text), 0)) over (partition by artifact_id order by seq) as bigint) as used from c) select * from s where used <= 400",
    "chunk_pages": _DEDUP + ", k as (select artifact_id, seq, row_number() over (partition by artifact_id order by seq) as k, count(*) over (partition by artifact_id) > 3 as has_more from c where seq >= 2) select artifact_id, seq, has_more from k where k <= 3",
    "json_compaction": r"""select file_id, strlen(x) as bytes, sha256(x) as digest from (select file_id, regexp_replace(file_content, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g') as x from indexed_files where file_path like '%.json')""",
    "source_redaction": r"""select file_id, sha256(x) as digest, x <> file_content as changed from (select file_id, file_content, regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_content,
      '-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----', '[REDACTED PRIVATE KEY]', 'g'),
      '\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16})\b', '[REDACTED]', 'g'),
      '(?i)((?:api[_-]?key|secret|password|access[_-]?token|refresh[_-]?token)\s*[=:]\s*["''`])([^"''`\r\n]{8,})(["''`])', '\1[REDACTED]\3', 'g'),
      '(?i)(Bearer\s+)[A-Za-z0-9._~+/-]{12,}', '\1[REDACTED]', 'g') as x from indexed_files)""",
    "search_matches": f"with {_BM25} select * from best",
    "relevance_scores": f"""with {_BM25}, w as (select distinct task_id, unnest(list_filter({_in_order(_words("task"))}, lambda w: w not in ({_EXT}))) as word from {_TASKS}),
      nm as (select f.file_id, f.file_path, f.file_path || coalesce(' ' || s.symbols, '') as names from indexed_files f left join (select file_id, string_agg(distinct symbol_name, ' ') as symbols from source_symbols group by 1) s using (file_id)),
      n as (select distinct file_id, unnest({_words("names").replace("list_distinct_in_order", "")}) as word from nm),
      h as (select task_id, file_id, count(*) as name_hits from n join w using (word) group by 1, 2)
      select coalesce(h.task_id, b.task_id) as task_id, coalesce(h.file_id, b.doc_id) as file_id, coalesce(name_hits, 0) as name_hits, b.doc_id is not null as text_match, false as explicit,
      cast(coalesce(name_hits, 0) * 12 + case when b.doc_id is not null then 4 else 0 end as double) as score from h full join best b on h.task_id = b.task_id and h.file_id = b.doc_id""",
    "budget_selection": """with recursive o as (select repository_id, file_id, greatest(1, cast(ceil(strlen(file_content) / 2) as bigint)) as cost, row_number() over (partition by repository_id order by file_id % 97 desc, file_id) as k from indexed_files where file_content is not null),
      p as (select repository_id, k, file_id, cost, case when cost <= 8000 then cost else 0 end as used, cost <= 8000 as got from o where k = 1
        union all select o.repository_id, o.k, o.file_id, o.cost, case when p.used + o.cost <= 8000 then p.used + o.cost else p.used end, p.used + o.cost <= 8000 from p join o on o.repository_id = p.repository_id and o.k = p.k + 1)
      select repository_id, file_id, cost from p where got""",
    "report_cells": "with r as (select distinct on (run_id) * from run_results) select run_id, "
    + " || ',' || ".join(f"""'"' || replace(case when regexp_matches(coalesce(cast({c} as varchar), ''), '^\\s*[=+@-]') then '''' else '' end || coalesce(cast({c} as varchar), ''), '"', '""') || '"'""" for c in ("run_id", "session_id", "executable", "run_status", "child_exit_code"))
    + " as csv from r",
}
SQL["relevance_reasons"] = f"select task_id, file_id, concat_ws('; ', case when name_hits > 0 then 'words in names: ' || name_hits end, case when text_match then 'text match' end) as reasons from ({SQL['relevance_scores']})"
