"""Queries of problem 6: generated, minified, vendored and data files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.llm.authorship import classify_files


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand here."""
    return classify_files(table(spark, sf_dir, "indexed_files")).filter("is_case").select("file_id")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice, score and verdict of every file."""
    return classify_files(table(spark, sf_dir, "indexed_files"))


def p6_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written files alone."""
    files = table(spark, sf_dir, "indexed_files").select("file_id", "repository_id", "file_path", "file_language")
    return files.join(classify_files(table(spark, sf_dir, "indexed_files")).filter(~F.col("is_case")).select("file_id"), "file_id")


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores, "p6_handwritten": p6_handwritten}
SQL: dict[str, str] = {}
