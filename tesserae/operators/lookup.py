"""Equi-join of a large table with one row per key, safe for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least so many rows is hot. There are at most total / HOT_ROWS hot keys, which bounds the broadcast.
HOT_ROWS = 1_000_000


def keyed_lookup(rows: DataFrame, per_key: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS, rows_at_most: int | None = None) -> DataFrame:
    """Inner join of `rows` with `per_key` (unique `key`, `count` = its number of rows in `rows`).

    Keys of `hot_rows` rows or more are looked up in a broadcast table: at most (rows of the input / hot_rows) keys can be
    that frequent, so its size is bounded. The others are joined by a shuffle, in which no key has more than `hot_rows` rows.
    The hot rows therefore never meet in one task. Rows with a null key find nothing. `count` is not in the result.
    Where the caller knows that `rows` has at most `rows_at_most` rows, fewer than `hot_rows`, no key can be hot and one join does.
    """
    if rows_at_most is not None and rows_at_most < hot_rows:
        return rows.join(per_key.drop(count), key)
    hot = per_key.filter(F.col(count) >= hot_rows).drop(count)
    cold = per_key.filter(F.col(count) < hot_rows).drop(count)
    by_broadcast = rows.join(F.broadcast(hot), key)
    hot_keys = hot.select(key)
    by_shuffle = rows.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key)
    return by_broadcast.unionByName(by_shuffle)


def checked(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, which is counted first; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def keyed_rest(rows: DataFrame, per_key: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS, rows_at_most: int | None = None) -> DataFrame:
    """The rows that keyed_lookup finds nothing for, with the same safety for hot keys; rows with a null key are among them."""
    if rows_at_most is not None and rows_at_most < hot_rows:
        return rows.join(per_key.select(key), key, "left_anti")
    hot, cold = per_key.filter(F.col(count) >= hot_rows).select(key), per_key.filter(F.col(count) < hot_rows).select(key)
    return rows.join(F.broadcast(hot), key, "left_anti").join(cold, key, "left_anti")


def salted_join(rows: DataFrame, others: DataFrame, key: str, salt_by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on `key` where both sides may hold a key many times.

    A key with n rows in `rows` is split into ceil(n / hot_rows) parts by a hash of `salt_by`, and the rows of `others` with such a key are
    repeated for each part, so that no task meets more than about `hot_rows` rows of one key from `rows`. At most (rows / hot_rows) keys
    are split, which bounds the broadcast of their counts. Null keys find nothing. `rows` is read twice and should be checkpointed.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows).select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), parts).cast("int")).drop("_parts")
    right = others.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")
