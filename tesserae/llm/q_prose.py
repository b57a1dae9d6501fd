"""Queries of problem 9: per-document text quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.prose import COMMON_WORDS, prose_shares, text_statistics


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return prose_shares(table(spark, sf_dir, "documents")).filter(~F.col("is_prose")).select("doc_id")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each document by kind of passage, and the verdict."""
    return prose_shares(table(spark, sf_dir, "documents"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and symbol statistics of each document."""
    return text_statistics(table(spark, sf_dir, "documents"))


_WORDS = ", ".join(f"'{w}'" for w in sorted(COMMON_WORDS))
QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages, "p9_statistics": p9_statistics}
SQL = {
    "p9_statistics": rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') as w,
         list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: length(trim(x)) > 0) as l,
         list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n(?:[ \t]*\r?\n)+'), lambda x: length(trim(x, ' ')) > 0) as p
  from documents
)
select doc_id, length(t) as characters, len(w) as words, len(l) as lines,
       case when len(w) > 0 then length(array_to_string(w, '')) / len(w) end as mean_word_length,
       case when length(t) > 0 then length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(t) end as symbol_share,
       case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;]["'')\]]*\s*$'))) / len(l) end as punctuated_line_share,
       case when len(w) > 0 then len(list_filter(w, lambda x: x in ({_WORDS}))) / len(w) end as common_word_share,
       case when len(l) > 0 then (len(l) - len(list_distinct(l))) / len(l) end as duplicate_line_share,
       case when len(p) > 0 then (len(p) - len(list_distinct(p))) / len(p) end as duplicate_paragraph_share
from d"""
}
