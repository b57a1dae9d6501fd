"""Queries of problem 1: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import table
from tesserae.operators.redelivery import delivery_changes, redundant_deliveries, unique_deliveries


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to drop."""
    return redundant_deliveries(table(spark, sf_dir, "usage_deliveries"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries that stay."""
    return unique_deliveries(table(spark, sf_dir, "usage_deliveries")).select("delivery_id", "repository_id", "delivered_at", "total_tokens")


def p1_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries, events and known tokens by source after repeated deliveries are dropped."""
    kept = unique_deliveries(table(spark, sf_dir, "usage_deliveries"))
    return kept.groupBy("usage_source").agg(
        F.count(F.lit(1)).alias("events"), F.count("total_tokens").alias("events_with_total"), F.sum("total_tokens").alias("known_tokens")
    )


def p1_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What brings a store of the deliveries with even numbers up to date with those of odd numbers."""
    rows = table(spark, sf_dir, "usage_deliveries")
    return delivery_changes(rows.filter("delivery_id % 2 <> 0"), rows.filter("delivery_id % 2 = 0"))


_DROPPED = r"""
with recursive ids as (
  select delivery_id, delivered_at, repository_id as r,
         nullif(regexp_extract(lower(event_id), '[0-9a-f]{64}'), '') as e,
         case when regexp_matches(lower(correlation_id), '[0-9a-f]{64}')
              then regexp_replace(lower(correlation_id), '\s+', '', 'g') end as c
  from usage_deliveries
), edges as (
  select distinct a.delivery_id as x, b.delivery_id as y from ids a join ids b on a.r = b.r and a.e = b.e
  union
  select distinct a.delivery_id, b.delivery_id from ids a join ids b on a.r = b.r and a.c = b.c
), reach as (
  select delivery_id as x, delivery_id as y from ids
  union
  select r.x, e.y from reach r join edges e on r.y = e.x
), best as (
  select x, arg_min(y, (delivered_at, y)) as kept from reach join ids on ids.delivery_id = reach.y group by x
), dropped as (select x as delivery_id from best where kept <> x)
"""

QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p1_by_source": p1_by_source, "p1_stored": p1_stored}
SQL = {
    "p1_stored": _DROPPED
    + """select delivery_id, case when delivery_id % 2 = 0 then 'retract' else 'add' end as change from usage_deliveries
where (delivery_id % 2 = 0) = (delivery_id in (select delivery_id from dropped))""",
    "p1_found": _DROPPED + "select delivery_id from dropped",
    "p1_kept": _DROPPED + "select delivery_id, repository_id, delivered_at, total_tokens from usage_deliveries where delivery_id not in (select delivery_id from dropped)",
    "p1_by_source": _DROPPED
    + """select usage_source, count(*) as events, count(total_tokens) as events_with_total, cast(sum(total_tokens) as bigint) as known_tokens
from usage_deliveries where delivery_id not in (select delivery_id from dropped) group by usage_source""",
}
