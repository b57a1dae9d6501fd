"""Operators over the lines of texts: runs of equal lines, failure latch, grouping of search hits, caps and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import lines_of, not_blank
from tesserae.operators.running import running_max, running_sum

FAILURE = r"^\s*(?:FAIL\b|FAILED\b|[×✕]\s|AssertionError\b|Error:|●\s)"
PASSED = r"^\s*PASS\s+\S+\.[cm]?[jt]sx?(?:\s|$)|^\s*[✓√✔]\s+.+(?:\(\d+ tests?[^)]*\)|\d+(?:\.\d+)?\s?m?s)\s*$"
SEARCH_HIT = r"^(.*?):(\d+)(?::(\d+))?:(.*)$"


def exploded_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos from 0, line) of each line of each text; a null text has no lines."""
    return df.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))


def line_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run from 1, start, line, occurrences): consecutive equal lines as one."""
    w = Window.partitionBy(key).orderBy("pos")
    new = F.coalesce(~F.lag("line").over(w).eqNullSafe(F.col("line")) | (F.col("pos") == 0), F.lit(True)).cast("int")
    rows = exploded_lines(df, key, text).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(key, "run").agg(F.min("pos").alias("start"), F.first("line").alias("line"), F.count(F.lit(1)).alias("occurrences"))


def expanded_runs(runs: DataFrame, key: str) -> DataFrame:
    """The lines of runs again, in order: the inverse of line_runs."""
    each = runs.select(key, "start", "line", F.explode(F.sequence(F.lit(0), (F.col("occurrences") - 1).cast("int"))).alias("i"))
    return each.select(key, (F.col("start") + F.col("i")).alias("pos"), "line")


def latched_lines(df: DataFrame, keys: list[str], place: str, line: Column) -> DataFrame:
    """df with `fails`, `after_failure` (a failure line at or before this one) and `grouped`: a passing line before any failure."""
    rows = df.withColumn("fails", F.coalesce(line.rlike(FAILURE), F.lit(False)))
    rows = running_max(rows, keys, place, [], F.col("fails").cast("int"), "_f").withColumn("after_failure", F.col("_f") == 1).drop("_f")
    return rows.withColumn("grouped", F.coalesce(line.rlike(PASSED), F.lit(False)) & ~F.col("after_failure"))


def grouped_hits(hits: DataFrame, key: str, place: str, line: str) -> DataFrame:
    """Search hits `path:line[:column]:text` by path: (key, path, first place, matches in order). Lines of another form are left out."""
    m = lambda g: F.regexp_extract(line, SEARCH_HIT, g)
    col = F.when(m(3) != "", F.concat(F.lit(":"), m(3))).otherwise(F.lit(""))
    rows = hits.filter(F.col(line).rlike(SEARCH_HIT)).select(key, place, m(1).alias("path"), F.concat(m(2), col, F.lit(":"), m(4)).alias("match"))
    return rows.groupBy(key, "path").agg(F.min(place).alias("first_place"), F.transform(F.array_sort(F.collect_list(F.struct(place, "match"))), lambda s: s["match"]).alias("matches"))


def capped_prefix(df: DataFrame, keys: list[str], place: str, ties: list[str], size: Column, cap: int) -> DataFrame:
    """The longest beginning of each group whose sizes stay within the cap; sizes are not negative."""
    return running_sum(df, keys, place, ties, size, "used").filter(F.col("used") <= cap)


def keyset_page(df: DataFrame, keys: list[str], place: str, offset: int, limit: int) -> DataFrame:
    """The first `limit` rows at or after `offset` in each group, with has_more."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    w = Window.partitionBy(*keys).orderBy(place)
    ahead = df.filter(F.col(place) >= offset).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit + 1)
    more = F.max("_k").over(Window.partitionBy(*keys)) > limit
    return ahead.withColumn("has_more", more).filter(F.col("_k") <= limit).drop("_k")


def blank_compacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines kept, distinct lines, text without blank lines)."""
    kept = F.filter(lines_of(F.col(text)), not_blank)
    return df.select(key, F.size(kept).cast("long").alias("kept"), F.size(F.array_distinct(kept)).cast("long").alias("distinct_lines"), F.array_join(kept, "\n").alias("compacted"))
