"""Comparison of two snapshots (key, path, hash), with renames inferred by equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.running import placed


def diff(old: DataFrame, new: DataFrame, key: str = "repository_id") -> DataFrame:
    """Changes (key, change, path, previous_path, hash): added, modified, renamed, deleted.

    A path only in the new snapshot is a rename if a vanished path has its hash; pairs are made one to one in the order of paths, as a
    sequential pass would. Null hashes match nothing. An empty old snapshot makes everything added.
    """
    o = old.select(F.col(key).alias("ok"), F.col("path").alias("op"), F.col("hash").alias("oh"))
    n = new.select(F.col(key).alias("nk"), F.col("path").alias("np"), F.col("hash").alias("nh"))
    both = n.join(o, (F.col("ok") == F.col("nk")) & (F.col("op") == F.col("np")), "full_outer")
    modified = both.filter("np is not null and op is not null and not (oh <=> nh)").select(F.col("nk").alias(key), F.lit("modified").alias("change"), F.col("np").alias("path"), F.lit(None).cast("string").alias("previous_path"), F.col("nh").alias("hash"))
    # one content may stand under a third of all paths
    added = placed(both.filter("op is null").select("nk", "np", "nh"), ["nk", "nh"], [F.col("np")], "r")
    gone = placed(both.filter("np is null").select("ok", "op", "oh"), ["ok", "oh"], [F.col("op")], "q")
    pairs = added.join(gone, (F.col("nk") == F.col("ok")) & (F.col("nh") == F.col("oh")) & (F.col("r") == F.col("q")), "full_outer")
    change = F.when(F.col("np").isNull(), "deleted").when(F.col("op").isNull(), "added").otherwise("renamed")
    rest = pairs.select(F.coalesce("nk", "ok").alias(key), change.alias("change"), F.coalesce("np", "op").alias("path"), F.when(F.col("np").isNotNull(), F.col("op")).alias("previous_path"), F.col("nh").alias("hash"))
    return modified.unionByName(rest)


def stale(indexed: DataFrame, current: DataFrame, key: str = "repository_id") -> DataFrame:
    """Indexed paths that changed or vanished: (key, path, state)."""
    c = current.select(F.col(key).alias("ck"), F.col("path").alias("cp"), F.col("hash").alias("ch"))
    rows = indexed.join(c, (F.col(key) == F.col("ck")) & (F.col("path") == F.col("cp")), "left")
    return rows.filter("cp is null or not (hash <=> ch)").select(key, "path", F.when(F.col("cp").isNull(), "vanished").otherwise("changed").alias("state"))


def index_plan(stored: DataFrame, scan: DataFrame, key: str = "repository_id", same_policy: bool = True) -> DataFrame:
    """What an incremental run does with each path: unchanged, index (new), reindex (changed) or delete. If the policy by which texts are redacted
    is another one, or has no version to compare, same_policy is false and nothing counts as unchanged."""
    s = scan.select(F.col(key).alias("sk"), F.col("path").alias("sp"), F.col("hash").alias("sh"))
    rows = stored.select(key, "path", "hash").join(s, (F.col(key) == F.col("sk")) & (F.col("path") == F.col("sp")), "full_outer")
    action = F.when(F.col("sp").isNull(), "delete").when(F.col("path").isNull(), "index").when(F.col("hash").eqNullSafe(F.col("sh")) & F.lit(same_policy), "unchanged").otherwise("reindex")
    return rows.select(F.coalesce(key, "sk").alias(key), F.coalesce("path", "sp").alias("path"), action.alias("action"))
