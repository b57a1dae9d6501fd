"""Running sums and sequential selections over ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, planned_bytes

#: A table of at most so many planned bytes goes through one window, as even a group that holds all of it is a small task. Both ways give the same rows.
PLAIN_BYTES = 256 << 20


def _running(df: DataFrame, keys: list[str], place: str, ties: list[str], value: Column, out: str, block: int, how: str) -> DataFrame:
    agg = F.sum if how == "sum" else F.max
    empty = F.lit(0 if how == "sum" else None).cast("long")
    if planned_bytes(df) <= PLAIN_BYTES:
        w = Window.partitionBy(*keys).orderBy(F.col(place).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, agg(F.coalesce(value.cast("long"), empty)).over(w))
    rows = df.withColumn("_v", F.coalesce(value.cast("long"), empty)).withColumn("_b", F.floor(F.coalesce(F.col(place).cast("long"), F.lit(-(2**62))) / block))
    sums = rows.groupBy(*keys, "_b").agg(agg("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(agg("_s").over(before), empty).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(place).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(offsets, cond).drop("_kb", *[f"_k{i}" for i in range(len(keys))])
    own = agg("_v").over(inside)
    total = F.col("_o") + own if how == "sum" else F.greatest("_o", own)
    return joined.withColumn(out, total).drop("_v", "_b", "_o")


def placed(df: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """df with `out`: the place of each row, from 0, within its group in the given order, for groups of any size and values of any spread.

    Rows are range-partitioned by group and order, which cuts large groups into blocks of bounded size; a row's place is its number in its
    block and the rows of the group's blocks before. Only the numbers of blocks are put in order together. The blocks are checkpointed, as
    borders found anew could fall elsewhere. Rows that tie in the order get places next to each other; null keys make a group.
    """
    if planned_bytes(df) <= PLAIN_BYTES:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(k) for k in keys]
    rows = cut(df.repartitionByRange(n, *columns, *order).withColumn("_b", F.spark_partition_id()))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    cond = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return rows.join(offsets, cond).withColumn(out, F.col("_o") + inside - 1).drop("_b", "_kb", "_o", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], place: str, ties: list[str], value: Column, out: str = "upto", block: int = 4096) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the group up to and with this one, by `place` (a long) and `ties`.

    Two levels: sums of blocks of `block` places, then rows within their block. A group of any length is thus spread over tasks, and
    only its block sums are put in order together. Rows with a null place come first; a null value counts as 0.
    """
    return _running(df, keys, place, ties, value, out, block, "sum")


def running_max(df: DataFrame, keys: list[str], place: str, ties: list[str], value: Column, out: str = "most", block: int = 4096) -> DataFrame:
    """The same for the greatest value so far; nulls do not count, and it is null where none came yet."""
    return _running(df, keys, place, ties, value, out, block, "max")


def greedy_fill(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: Column, item: str) -> DataFrame:
    """Rows that a first-fit pass in the given order takes within each group's budget: what does not fit is skipped, the pass goes on.

    The pass needs no sequential task: in each round the longest beginning that fits is taken by a running sum, and all that exceeds
    what is left is struck off; the item at which a beginning ends is always among the latter, so every round makes progress, and after
    the first the remaining budget is smaller than one item. A group of any size is spread over tasks: places and sums go over two
    levels. Costs are positive; null costs are never taken. `item` names rows within a group.
    """
    ordered = placed(df.withColumn("_c", F.col(cost).cast("long")).withColumn("_left", budget.cast("long")), keys, [*order, F.col(item)], "_k")
    rest = cut(ordered.select(*keys, item, "_c", "_k", "_left").filter("_c is not null and _c <= _left"))
    taken = None
    while True:
        got = cut(running_sum(rest, keys, "_k", [], F.col("_c"), "_s").withColumn("_in", F.col("_s") <= F.col("_left")))
        now = got.filter("_in")
        taken = now.select(*keys, item) if taken is None else taken.unionByName(now.select(*keys, item))
        used = now.groupBy(*keys).agg(F.max("_s").alias("_u"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_u_{k}"))
        used = used.select(*[F.col(k).alias(f"_u_{k}") for k in keys], "_u")
        rest = got.filter("not _in").join(used, same, "left").withColumn("_left", F.col("_left") - F.coalesce("_u", F.lit(0)))
        rest = rest.filter("_c <= _left").select(*keys, item, "_c", "_k", "_left")  # of what is checkpointed
        if rest.isEmpty():
            return df.join(taken, [*keys, item], "left_semi")
