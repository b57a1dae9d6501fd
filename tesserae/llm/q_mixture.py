"""Queries of problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.functions.runtime import table
from tesserae.llm.mixture import mixture, reached_shares


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with the largest total that every source can serve."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in that mixture."""
    return reached_shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
