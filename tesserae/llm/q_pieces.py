"""Queries of problem 5: splitting oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.pieces import split_items


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized files and symbols."""
    return split_items(table(spark, sf_dir, "indexed_files"), table(spark, sf_dir, "source_symbols"), table(spark, sf_dir, "split_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that must be cut: those with a second piece."""
    return p5_pieces(spark, sf_dir).filter("piece = 2").select("item_kind", "item_id")


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind: items cut, pieces, largest piece, bytes of the items."""
    p = p5_pieces(spark, sf_dir)
    return p.groupBy("item_kind").agg(
        F.count_if(F.col("piece") == 1).alias("items"), F.count(F.lit(1)).alias("pieces"), F.max("bytes").cast("long").alias("largest"), F.sum(F.col("bytes") - F.col("overlap_bytes")).alias("item_bytes")
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_summary": p5_summary}
SQL = {
    "p5_found": r"""
select 'file' as item_kind, file_id as item_id from indexed_files
where strlen(file_content) > (select max_bytes from split_limits where item_kind = 'file')
union all
select 'symbol', symbol_id from source_symbols s left join indexed_files f on s.file_id = f.file_id
where strlen(coalesce(body, regexp_replace(array_to_string(list_slice(string_split(file_content, chr(10)), start_line, end_line), chr(10)), '\r$', '')))
      > (select max_bytes from split_limits where item_kind = 'symbol')"""
}
