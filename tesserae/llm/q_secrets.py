"""Queries of problem 4: credentials in files and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.secrets import redact_chunks, redact_texts, secret_places


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "indexed_files").select(F.col("file_id").cast("string").alias("row_key"), F.lit(None).cast("long").alias("pos"), F.col("file_content").alias("text"))


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of credentials with the detector that saw them."""
    files = secret_places(_files(spark, sf_dir)).withColumn("found_in", F.lit("file"))
    chunks = table(spark, sf_dir, "artifact_chunks").select(F.col("artifact_id").alias("row_key"), F.col("seq").alias("pos"), F.col("chunk_text").alias("text"))
    return files.unionByName(secret_places(chunks).withColumn("found_in", F.lit("chunk"))).select("found_in", "row_key", "pos", "detector")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of credentials in files (line) and chunks (seq)."""
    return p4_places(spark, sf_dir).select("found_in", "row_key", "pos").distinct()


def p4_redacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's content with its credentials masked."""
    return redact_texts(_files(spark, sf_dir)).select(F.col("row_key").cast("long").alias("file_id"), "credentials", "redacted_text")


def p4_redacted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output chunk with its credentials masked, also over chunk borders."""
    return redact_chunks(table(spark, sf_dir, "artifact_chunks"))


QUERIES = {"p4_found": p4_found, "p4_places": p4_places, "p4_redacted_files": p4_redacted_files, "p4_redacted_chunks": p4_redacted_chunks}
SQL: dict[str, str] = {}
