"""Queries of problem 7: evaluation texts in training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.leaks import leaked_items


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that leaked into it."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item the number of documents it leaked into, 0 if none."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "split_name")
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(found, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))


QUERIES = {"p7_found": p7_found, "p7_by_item": p7_by_item}
SQL: dict[str, str] = {}
