"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut
from tesserae.operators.lookup import HOT_ROWS, keyed_lookup


def _star(edges: DataFrame, hot_rows: int, rows_at_most: int) -> DataFrame:
    """Link every neighbour of a node to the node's least neighbour. edges: (u, v) with u the centre."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return keyed_lookup(edges, least, "u", "n", hot_rows, rows_at_most)


def components(edges: DataFrame, hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """Component of each node of `edges` (columns u and v, any orderable type): rows (node, component), component the least node in it.

    Large-star and small-star steps alternate until the edges no longer change, which takes O(log n) rounds in practice, so long
    chains do not need one round per link. Each round is checkpointed. Null ends and loops are ignored; a node that has only a loop
    is not in the result. Nothing is collected on the driver but two numbers a round. An empty input gives an empty result.
    """
    e = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = (e.count(), None)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, hot_rows, 2 * seen[0]).select("u", "v", F.least("u", "m").alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _star(large, hot_rows, 2 * seen[0])
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = cut(nxt)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
