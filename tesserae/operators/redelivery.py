"""Messages delivered more than once: keep one delivery of each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, digest
from tesserae.operators.components import components
from tesserae.operators.lookup import HOT_ROWS, keyed_lookup, keyed_rest

HEX64 = "(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])"


def canonical_event_id(c: Column) -> Column:
    """The 64-digit hex digest in an event id, in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(c), HEX64, 0), F.lit(""))


def _plain_correlation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s ​﻿]+", ""), r"sha-?256[:=-]", "")


def canonical_correlation_id(c: Column) -> Column:
    """A correlation id without white space and in lower case, its digest without an algorithm's name; null if it holds no digest."""
    plain = _plain_correlation(c)
    return F.when(plain.rlike(HEX64), plain)


_HALF = 2**58  # more microseconds than any timestamp is from 1970


def _rank(at: Column, delivery_id: Column) -> Column:
    """Earliest delivered_at first (null last), then the smallest id, as one number: aggregates over it need no sorting."""
    micros = F.coalesce(F.unix_micros(at), F.lit(_HALF - 1)) + F.lit(_HALF)
    return (micros.cast("decimal(18,0)") * F.expr("18446744073709551616BD") + (delivery_id.cast("decimal(20,0)") + F.expr("9223372036854775808BD"))).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    return (rank % F.expr("18446744073709551616BD") - F.expr("9223372036854775808BD")).cast("long")


def _identifiers(df: DataFrame, *others: Column | str) -> DataFrame:
    """`others` with e and c (16-byte keys of both identifiers within the repository, or null) and p (that of the pair).

    No filter here: it would be pushed below and have the identifiers worked out twice for each row. Rows without identifiers share one p.
    """
    # one projection for each step, as an expression that is used twice in one is worked out twice
    plain = df.select(*others, F.col("repository_id").alias("_r"), F.regexp_extract(F.lower("event_id"), HEX64, 0).alias("_e"), _plain_correlation(F.col("correlation_id")).alias("_c"))
    kept = [c for c in plain.columns if c not in ("_r", "_e", "_c")]
    e = F.when(F.col("_r").isNotNull() & (F.col("_e") != ""), F.unhex(digest(F.col("_r"), F.lit("e"), F.col("_e"))))
    c = F.when(F.col("_r").isNotNull() & F.col("_c").rlike(HEX64), F.unhex(digest(F.col("_r"), F.lit("c"), F.col("_c"))))
    return plain.select(*kept, e.alias("e"), c.alias("c")).withColumn("p", _pair(F.col("e"), F.col("c")))


def _pair(e: Column, c: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(e, F.lit(b"e")), F.coalesce(c, F.lit(b"c")))))


def repeated_groups(df: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(identified deliveries (delivery_id, p), for each repeated pair of identifiers p: n and kept, the delivery kept of its event; rows)."""
    # a checkpoint, so that the table is read and its identifiers are worked out once
    rows = cut(_identifiers(df, "delivery_id", _rank(F.col("delivered_at"), F.col("delivery_id")).alias("rank")))
    # copies with the same pair of identifiers fall together map-side, however many there are (read by three branches)
    pairs = rows.filter("e is not null or c is not null").groupBy("e", "c").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    pairs = cut(pairs.withColumn("p", _pair(F.col("e"), F.col("c"))))
    distinct_pairs = pairs.count()
    marks = pairs.select("p", "n", F.explode(F.array_compact(F.array("e", "c"))).alias("k"))
    # frequency of each identifier over all pairs; a single one passes, a repeated one is ranked
    freq = marks.groupBy("k").agg(F.count(F.lit(1)).alias("pairs"))
    linked_keys = freq.filter("pairs > 1").select("k", "pairs")
    linked = keyed_lookup(marks.select("p", "k"), linked_keys, "k", "pairs", hot_rows, 2 * distinct_pairs).select("p").distinct()
    linked = cut(pairs.join(linked, "p"))
    alone = pairs.filter("n > 1").join(linked.select("p"), "p", "left_anti").select("p", "n", _ranked_id(F.col("rank")).alias("kept"))
    # events whose deliveries hang together through several pairs
    comp = components(linked.filter("e is not null and c is not null").select(F.col("e").alias("u"), F.col("c").alias("v")), hot_rows)
    own = linked.select("p", "n", "rank", F.coalesce("e", "c").alias("node")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = own.groupBy("component").agg(F.min("rank").alias("best"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    joined = keyed_lookup(own, best, "component", "size", hot_rows, distinct_pairs).filter("total > 1").select("p", "n", _ranked_id(F.col("best")).alias("kept"))
    return rows.select("delivery_id", "p"), cut(alone.unionByName(joined)), rows.count()


_NEED = ["delivery_id", "repository_id", "event_id", "correlation_id", "delivered_at"]


def redundant_deliveries(df: DataFrame, stored: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """delivery_id of every delivery to drop, so that exactly one delivery of each event stays.

    Two deliveries are the same event if repository_id agrees and event_id or correlation_id agrees, directly or through other
    deliveries. An identifier is compared in canonical form; one without a 64-digit hex digest counts as missing. The delivery kept
    has the earliest delivered_at (null last), then the smallest delivery_id. `stored` deliveries are judged together with the new ones,
    so the result may name stored ones; see delivery_changes.

    Identifiers are split by their aggregated frequency: those that occur once pass without any join, only repeated ones are ranked.
    A null repository_id equals nothing, so such rows are never dropped; a delivery without identifiers neither. Rows that share a
    delivery_id are one delivery. An empty table gives an empty result; other columns are ignored.
    """
    every = df.select(*_NEED) if stored is None else df.select(*_NEED).unionByName(stored.select(*_NEED))
    rows, groups, n = repeated_groups(every, hot_rows)
    return keyed_lookup(rows, groups, "p", "n", hot_rows, n).filter("delivery_id <> kept").select("delivery_id").distinct()


def unique_deliveries(df: DataFrame, stored: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of `df` that stay, with all their columns: those of no repeated identifier as they are, united with the best of each
    repeated group. If a stored delivery is the better one, no row of its event stays; if not, delivery_changes says what to retract."""
    every = df.select(*_NEED) if stored is None else df.select(*_NEED).unionByName(stored.select(*_NEED))
    _, groups, n = repeated_groups(every, hot_rows)
    whole = _identifiers(df.select(F.struct(*df.columns).alias("_row"), *_NEED), "_row", F.col("delivery_id").alias("_id")).select("_row", "_id", "p")
    passed = keyed_rest(whole, groups, "p", "n", hot_rows, n)
    ranked = keyed_lookup(whole, groups, "p", "n", hot_rows, n).filter("_id = kept")
    return passed.select("_row.*").unionByName(ranked.select("_row.*"))


def delivery_changes(new: DataFrame, stored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (delivery_id, change) that bring a store up to date with new deliveries, so that it has exactly one delivery of each event:
    'add' for a new delivery that stays, 'retract' for a stored one of whose event an earlier copy came or stands there already."""
    marked = new.select(*_NEED, F.lit(True).alias("_new")).unionByName(stored.select(*_NEED, F.lit(False).alias("_new")))
    gone = redundant_deliveries(new, stored, hot_rows).withColumn("_gone", F.lit(True))
    rows = marked.select("delivery_id", "_new").distinct().join(gone, "delivery_id", "left")
    return rows.filter(F.col("_new") == F.col("_gone").isNull()).select("delivery_id", F.when(F.col("_new"), "add").otherwise("retract").alias("change"))
