"""Queries of problem 2: source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.functions.runtime import table
from tesserae.llm.syntax import defect_rates, parse_defects, unparsable


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content is not valid in the language of their path."""
    return unparsable(table(spark, sf_dir, "indexed_files"))


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file of a checked language the least edits that repair it, and what they look like."""
    return parse_defects(table(spark, sf_dir, "indexed_files"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that do not parse for each repository and language."""
    return defect_rates(table(spark, sf_dir, "indexed_files"))


QUERIES = {"p2_found": p2_found, "p2_defects": p2_defects, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
