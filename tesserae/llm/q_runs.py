"""Queries of problem 3: repeated consecutive events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.runs import chunk_runs, command_runs


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of both kinds of sequence, each run as one event with its count and duration."""
    a = chunk_runs(table(spark, sf_dir, "artifact_chunks")).select(F.lit("chunk").alias("seq_kind"), F.col("entity").alias("seq_key"), "first_key", "last_key", "events", "seconds")
    b = command_runs(table(spark, sf_dir, "run_results")).select(F.lit("run").alias("seq_kind"), F.col("entity").alias("seq_key"), "first_key", "last_key", "events", "seconds")
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more same events."""
    return p3_collapsed(spark, sf_dir).filter("events > 1").select("seq_kind", "seq_key", "first_key", "last_key")


QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}
SQL: dict[str, str] = {}
