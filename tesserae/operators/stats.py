"""Experiment statistics: roll-ups that keep unknown values unknown, paired differences, bootstrap intervals, seeded shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut
from tesserae.operators.running import running_sum


def replay_rollup(cases: DataFrame, corpus: str) -> DataFrame:
    """Per corpus: cases, bytes in and out, saved share (null for no input), whether all checks passed. cases: original, reduced, passed."""
    size_in, size_out = F.sum("original"), F.sum("reduced")
    return cases.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("cases"), size_in.alias("original_bytes"), size_out.alias("reduced_bytes"),
        F.when(size_in > 0, (size_in - size_out) / size_in).alias("saved_share"), F.bool_and("passed").alias("all_passed"),
    )


def condition_rollup(results: DataFrame, conditions: list[str]) -> DataFrame:
    """Per condition, also those without rows: runs, successes, rate, tokens (null unless all are known and of one source), tokens per success."""
    want = results.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
    tokens = F.when((F.count(F.lit(1)) == F.count("tokens")) & (F.countDistinct("token_source") == 1) & (F.count("token_source") == F.count(F.lit(1))), F.sum("tokens"))
    got = results.groupBy("condition").agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), tokens.alias("tokens"))
    rows = want.join(got, "condition", "left").fillna(0, ["runs", "successes"])
    return rows.withColumn("success_rate", F.when(F.col("runs") > 0, F.col("successes") / F.col("runs"))).withColumn("tokens_per_success", F.when(F.col("successes") > 0, F.col("tokens") / F.col("successes")))


def paired_differences(results: DataFrame, treatment: str, baseline: str) -> DataFrame:
    """Per task the mean differences of treatment and baseline over the repeats that both have; tokens null if any is unknown."""
    t = results.filter(F.col("condition") == treatment).select("task", "repeat", F.col("success").cast("int").alias("ts"), F.col("tokens").alias("tt"))
    b = results.filter(F.col("condition") == baseline).select("task", "repeat", F.col("success").cast("int").alias("bs"), F.col("tokens").alias("bt"))
    d = F.col("tt") - F.col("bt")
    return t.join(b, ["task", "repeat"]).groupBy("task").agg(
        F.count(F.lit(1)).alias("repeats"), F.avg(F.col("ts") - F.col("bs")).alias("success_difference"), F.when(F.count(d) == F.count(F.lit(1)), F.avg(d)).alias("token_difference")
    )


def lcg_states(seed: int, n: int) -> np.ndarray:
    """The next n states of the linear congruential stream modulo 2^32."""
    out, s = np.empty(n, np.uint64), seed % 2**32
    for i in range(n):
        s = (1664525 * s + 1013904223) % 2**32
        out[i] = s
    return out


def bootstrap_interval(values: list[float], seed: int = 42, resamples: int = 2000) -> tuple[float, float] | None:
    """95 % interval of the mean by resampling, by nearest ranks; None for fewer than two values."""
    n = len(values)
    if n < 2:
        return None
    draws = (lcg_states(seed, n * resamples).astype(float) / 2**32 * n).astype(int).reshape(resamples, n)
    means = np.sort(np.asarray(values, float)[draws].mean(axis=1))
    return float(means[int(resamples * 0.025)]), float(means[int(resamples * 0.975)])


def _lcg_jump(k: int) -> tuple[int, int]:
    """(a, c) of k steps of the stream at once: state -> a * state + c modulo 2^32."""
    a, c, ka, kc = 1, 0, 1664525, 1013904223
    while k:
        if k & 1:
            a, c = a * ka % 2**32, (c * ka + kc) % 2**32
        ka, kc, k = ka * ka % 2**32, (ka + 1) * kc % 2**32, k >> 1
    return a, c


def lcg_slice(seed: int, skip: int, n: int) -> np.ndarray:
    """The n states after the first `skip`, as in lcg_states(seed, skip + n)[skip:], without walking the stream."""
    out = np.empty(n, np.uint64)
    if n:
        a, c = _lcg_jump(skip + 1)
        out[0] = (a * (seed % 2**32) + c) % 2**32
    done = 1
    while done < n:  # what is there, `done` steps on
        a, c = _lcg_jump(done)
        more = min(done, n - done)
        out[done : done + more] = (out[:more] * np.uint64(a) + np.uint64(c)) & np.uint64(2**32 - 1)
        done += more
    return out


def bootstrap_by(df: DataFrame, key: str, value: str, seed: int = 42, resamples: int = 2000, block: int = 2**21) -> DataFrame:
    """(key, n, mean, low, high) per group of task means; _o (a long) is the tasks' order. The same as bootstrap_interval of each group.

    A group may be of any size: its values are numbered over two levels and packed into blocks of `block`; each task draws a range of
    resamples against one block, jumping to its place in the stream, and only the sums per resample and block go on. Memory is bounded
    by the block. A group of more than one block draws the stream once for each of them. Null values do not count.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * 2
    numbered = running_sum(df.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("_g"), F.col("_o").alias("_at"), F.col(value).cast("double").alias("_x")), ["_g"], "_at", ["_x"], F.lit(1), "_i")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("_i")["_x"].to_numpy()
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_b": [pdf["_b"].iloc[0]], "_size": [len(v)], "_sum": [v.sum()], "_v": [v]})

    blocks = cut(numbered.select("_g", "_i", "_x", F.floor((F.col("_i") - 1) / block).alias("_b")).groupBy("_g", "_b").applyInPandas(pack, "_g string, _b long, _size long, _sum double, _v array<double>"))
    in_order = lambda c: F.aggregate(F.sort_array(F.collect_list(F.struct("_b", c))), F.lit(0.0), lambda s, x: s + x[c])
    whole = blocks.groupBy("_g").agg(F.sum("_size").alias("n"), in_order("_sum").alias("_all"))
    ranges = min(resamples, max(1, -(-parts // max(1, blocks.count()))))
    step = -(-resamples // ranges)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, k, v, n, first in zip(b["_g"], b["_b"], b["_v"], b["n"], b["_from"]):
                v, at, rows = np.asarray(v, float), int(k) * block, []
                for r in range(first, min(resamples, first + step)):
                    total = 0.0
                    for done in range(0, n, 2**20):
                        i = (lcg_slice(seed, r * n + done, min(2**20, n - done)).astype(float) / 2**32 * n).astype(np.int64) - at
                        total += v[i if len(v) == n else i[(i >= 0) & (i < len(v))]].sum()
                    rows.append((g, r, k, total))
                yield pd.DataFrame(rows, columns=["_g", "_r", "_b", "_t"])

    firsts = df.sparkSession.range(0, resamples, step).select(F.col("id").alias("_from"))
    tasks = blocks.select(F.col("_g"), "_b", "_v").join(whole.filter("n > 1").select(F.col("_g").alias("_h"), "n"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    sums = tasks.crossJoin(F.broadcast(firsts)).repartition(parts).mapInPandas(draw, "_g string, _r long, _b long, _t double")  # at most `ranges` rows of numbers
    means = sums.groupBy("_g", "_r").agg(in_order("_t").alias("_t")).groupBy(F.col("_g").alias("_h")).agg(F.sort_array(F.collect_list("_t")).alias("_m"))
    rank = lambda share: F.element_at("_m", int(resamples * share) + 1) / F.col("n")
    got = whole.join(means, F.col("_g").eqNullSafe(F.col("_h")), "left")
    return got.select(F.col("_g").alias(key), "n", (F.col("_all") / F.col("n")).alias("mean"), rank(0.025).alias("low"), rank(0.975).alias("high"))


def seeded_shuffle(items: list, seed: int) -> list:
    """Fisher-Yates by the linear congruential stream, from the end; for plans, which are small."""
    out = list(items)
    states = lcg_states(seed, max(0, len(out) - 1))
    for k, i in enumerate(range(len(out) - 1, 0, -1)):
        j = int(states[k] / 2**32 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
