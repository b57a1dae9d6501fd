"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets, in a shuffled order, a virtual finish time: the tokens of its source up to and with it, divided by
the source's target share. Sorted by that time the sources come out interleaved in proportion to their shares, so that a cut at any
total budget holds the shares to within one document of each source. Repeats of a source follow its first pass in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, spread
from tesserae.functions.tokens import encoding, ship
from tesserae.operators.lookup import checked

#: Documents of a slice on average.
SLICE_ROWS = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, source, tokens): `text` measured by a public byte-level tokenizer; strings of special tokens are plain text. A null text has 0."""
    ship(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, tokens long")


def mixture(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, slices: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, source, copy, tokens, finish): the documents of a mixture, each with the number of its use from 1.

    targets: source, target_share, max_repeats. Without `budget`, the total is the largest at which every source can reach its share
    within its repeats. With a budget beyond that, sources that run out give what they have. Sources without a target, null sources and
    documents without tokens are left out; a target whose source has no document is dropped and the shares of the others are scaled up
    to 1, as are shares that do not sum to 1. Targets with a null or non-positive share or repeats count as missing.

    The order within a source is by a hash of seed and doc_id (ties: equal rows, by tokens), so a run can be repeated. Running sums go
    over two levels, slices of the hash range within a source and rows within a slice: no task holds a whole source, however large.
    `slices` follows from the number of documents, so that a slice has about SLICE_ROWS of them at every size.
    """
    goal = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats")).dropDuplicates(["source"])
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = cut(
        count_tokens(docs.filter("source is not null and text is not null").join(checked(goal.select("source")), "source", "left_semi"), vocabulary)
        .filter("tokens > 0")
        .select("doc_id", "source", "tokens", rank.alias("r"))
    )
    if slices is None:
        slices = max(256, sized.count() // SLICE_ROWS)
    sized = sized.withColumn("slice", F.floor((F.col("r") / 2.0**64 + 0.5) * slices).cast("int"))
    # at most (sources with a target) x slices rows
    sums = sized.groupBy("source", "slice").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    totals = goal.join(sums.groupBy("source").agg(F.sum("t").alias("total")), "source")
    every = Window.partitionBy()
    totals = totals.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    totals = totals.withColumn("limit", F.min(F.col("total") * F.col("max_repeats") / F.col("share")).over(every))
    limit = F.lit(float(budget)) if budget is not None else F.col("limit")
    totals = totals.select("source", "share", "total", "max_repeats", limit.alias("budget"))
    inside = Window.partitionBy("source", "slice").orderBy("r", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    once = sized.join(offsets, ["source", "slice"]).withColumn("upto", F.col("offset") + F.sum("tokens").over(inside)).join(checked(totals), "source")
    # a copy is made only if its finish time lies within the budget
    last = F.least(F.col("max_repeats"), (F.floor((F.col("budget") * F.col("share") * (1 + 1e-12) - F.col("upto")) / F.col("total")) + 1).cast("int"))
    copies = once.withColumn("last", last).filter("last >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("last"))))
    copies = copies.select("doc_id", "source", "copy", "tokens", ((F.col("upto") + (F.col("copy") - 1) * F.col("total")) / F.col("share")).alias("finish"), "budget")
    return _truncate(cut(copies), slices).select("doc_id", "source", "copy", "tokens", "finish")


def _truncate(copies: DataFrame, slices: int) -> DataFrame:
    """The copies in the order of their finish times up to the total budget, as a range sort: time slices first, rows only in the slice of the cut."""
    timed = copies.withColumn("s", F.least(F.floor(F.col("finish") / F.col("budget") * slices), F.lit(slices - 1)).cast("int"))
    sums = timed.groupBy("s").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("start"), "t")
    placed = timed.join(checked(starts, 10_000_000), "s")
    whole = placed.filter(F.col("start") + F.col("t") <= F.col("budget"))
    inside = Window.partitionBy("s").orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.filter((F.col("start") + F.col("t") > F.col("budget")) & (F.col("start") < F.col("budget")))
    border = border.withColumn("sum", F.col("start") + F.sum("tokens").over(inside)).filter(F.col("sum") <= F.col("budget")).drop("sum")
    return whole.unionByName(border)


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: target_share, documents, copies, tokens, actual_share, most_uses; zeros where nothing was used."""
    got = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens"), F.max("copy").alias("most_uses"))
    rows = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["documents", "copies", "tokens", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
