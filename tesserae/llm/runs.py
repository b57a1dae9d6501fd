"""Repeated consecutive events in ordered sequences: each run becomes one event with its count and duration.

Method: boundary interval lookup. Rows are range-partitioned and sorted by sequence and place, so that a sequence of any length is cut
into chunks of bounded size; in each chunk the positions where a run starts are gathered into a sorted array, every event is assigned
to its run by binary search in it, and runs are aggregated. Runs that meet at the border of two partitions are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut

# What differs between two reports of the same event, in the order of replacement (fixed values).
VOLATILE = [
    (r"\x1B\[[0-?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)|\x1B[@-_]", ""),  # terminal colours and titles
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<t>"),
    (r"(?<![\w.:/-])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])", "<t>"),
    (r"(?<![\w.:/-])1\d{9}(?:\d{3}|\d{6}|\d{9}|\.\d+)?(?![\w.:])", "<t>"),
    (r"(?<![\w.:/-])\d+(?:\.\d+)?\s?(?:ns|us|µs|μs|ms|s|secs?|seconds?|mins?|minutes?|m|h|hours?)(?![\w/-])", "<d>"),
    (r"\b0[xX][0-9a-fA-F]{4,}\b", "<p>"),
    (r"((?:/var)?/tmp/(?:[\w.]+-)*)[A-Za-z0-9_]{6,}(?![\w-])", "$1<tmp>"),
    (r"(?i)\b(attempt|retry|try|retries|attempts|iteration|step|round)([ #:=]+)\d+(?:\s?(?:/|of)\s?\d+)?", "$1$2<n>"),
    (r"([(\[])\s*\d+\s?(?:/|of)\s?\d+\s*([)\]])", "$1<n>$2"),
    (r"(?<![\w.])\d+(?:\.\d+)?\s?%", "<n>%"),
    (r"(?i)\b(pid|tid|ppid|seq|sequence|request|req|job|process|thread|worker-id|request-id|job-id)([ =:#]+)(?=[0-9a-f-]*\d)[0-9a-f-]{2,}\b", "$1$2<id>"),
    (r"(?i)\b(pid|tid|ppid|seq|sequence|request|req|job|process|thread)([ =:#]+)\d\b", "$1$2<id>"),
    (r"[\s\x00 ﻿]+", " "),
]


def same_event_text(text: Column) -> Column:
    """What a chunk of output says, without what changes from one report to the next; null stays null."""
    for pattern, to in VOLATILE:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def _fingerprint(*cols: Column) -> list[Column]:
    """128 bits of the columns as two longs; nulls are values of their own."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *marked).alias("h1"), F.xxhash64(F.lit("b"), *marked, F.lit(2)).alias("h2")]


_PARTIAL = "entity string, part int, idx long, first boolean, last boolean, h1 long, h2 long, first_key string, last_key string, n long, t0 double, t1 double"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one sorted partition, batch by batch; the last run of a batch stays open."""
    part = TaskContext.get().partitionId()
    prev = None  # the last row seen
    idx = 0
    run: dict | None = None  # the open run

    def closed(r: dict, last: bool) -> dict:
        return r | {"part": part, "first": r["idx"] == 0, "last": last}

    for b in batches:
        if not len(b):
            continue
        ent, key = b["entity"].to_numpy(object), b["key"].to_numpy(object)
        place, h1, h2 = b["place"].to_numpy(), b["h1"].to_numpy(), b["h2"].to_numpy()
        at = b["at"].to_numpy(float, na_value=np.nan)
        before = prev or (object(), None, 0, 0, 0)
        prev = (ent[-1], key[-1], place[-1], h1[-1], h2[-1])
        same = np.concatenate(([ent[0] == before[0]], ent[1:] == ent[:-1])).astype(bool)
        same &= (h1 == np.concatenate(([before[3]], h1[:-1]))) & (h2 == np.concatenate(([before[4]], h2[:-1])))
        stored_twice = same & (place == np.concatenate(([before[2]], place[:-1]))) & np.concatenate(([key[0] == before[1]], key[1:] == key[:-1])).astype(bool)
        keep = ~stored_twice
        ent, key, h1, h2, at, same = ent[keep], key[keep], h1[keep], h2[keep], at[keep], same[keep]
        m = len(ent)
        if not m:
            continue
        starts = np.flatnonzero(~same)
        of = np.searchsorted(starts, np.arange(m), side="right")  # 0: the run left open by the batch before
        counts = np.bincount(of, minlength=len(starts) + 1)
        if counts[0]:
            k = counts[0]
            run["n"] += int(k)
            run["last_key"] = key[k - 1]
            run["t0"], run["t1"] = float(np.fmin(run["t0"], np.fmin.reduce(at[:k]))), float(np.fmax(run["t1"], np.fmax.reduce(at[:k])))
        if len(starts):
            out = [closed(run, False)] if run else []
            ends = np.append(starts[1:], m) - 1
            t0, t1 = np.fmin.reduceat(at, starts), np.fmax.reduceat(at, starts)
            frame = pd.DataFrame({"entity": ent[starts], "part": part, "idx": idx + np.arange(len(starts)), "first": False, "last": False, "h1": h1[starts], "h2": h2[starts], "first_key": key[starts], "last_key": key[ends], "n": counts[1:], "t0": t0, "t1": t1})
            run = frame.iloc[-1].to_dict()
            run["n"] = int(run["n"])
            frame.loc[frame["idx"] == 0, "first"] = True
            idx += len(starts)
            if out:
                yield pd.DataFrame(out)[list(frame.columns)]
            if len(frame) > 1:
                yield frame.iloc[:-1]
    if run:
        yield pd.DataFrame([closed(run, True)])[["entity", "part", "idx", "first", "last", "h1", "h2", "first_key", "last_key", "n", "t0", "t1"]]


def collapse_runs(df: DataFrame, entity: Column, place: Column, key: Column, at: Column, same: list[Column]) -> DataFrame:
    """Rows (entity, first_key, last_key, events, seconds, started_at, ended_at): one for each maximal run of same events.

    `entity` names the sequence (rows with null are in none), `place` (a long) and then `key` (a string) order it, `same` are the columns
    in which consecutive events agree, nulls being equal. A row stored twice with the same place, key and event counts once; rows that tie
    in place with other keys stay distinct events in the order of their keys. `at` may be null or run backwards: seconds is the span from
    the least to the greatest time known in a run, null if none is. An empty table gives an empty result; other columns are ignored.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_s{i}" for i in range(len(same))]
    rows = df.select(entity.alias("entity"), place.cast("long").alias("place"), key.cast("string").alias("key"), F.unix_micros(at).cast("double").alias("at"), *[c.alias(x) for c, x in zip(same, named)])
    rows = rows.filter("entity is not null").fillna({"place": -(2**62)})
    # events are worked out once: finding range borders reads its input an extra time, and then reads only keys and fingerprints
    rows = cut(rows.select("entity", "place", "key", "at", *_fingerprint(*[F.col(x) for x in named])))
    # the border of two partitions may fall inside a long sequence, so no sequence is held by one task
    rows = rows.repartitionByRange(n, "entity", "place", "key").sortWithinPartitions("entity", "place", "key", "h1", "h2")
    parts = cut(rows.mapInPandas(_sweep, _PARTIAL))
    inner = parts.filter("not first and not last")
    # at most two runs of each partition touch its borders; only these are compared with their neighbours
    w = Window.partitionBy("entity").orderBy("part", "idx")
    edge = parts.filter("first or last").withColumn(
        "begins",
        F.coalesce(~((F.lag("h1").over(w) == F.col("h1")) & (F.lag("h2").over(w) == F.col("h2")) & (F.lag("part").over(w) < F.col("part")) & F.lag("last").over(w) & F.col("first")), F.lit(True)).cast("int"),
    )
    edge = edge.withColumn("g", F.sum("begins").over(w)).groupBy("entity", "g").agg(
        F.min_by("first_key", F.struct("part", "idx")).alias("first_key"), F.max_by("last_key", F.struct("part", "idx")).alias("last_key"),
        F.sum("n").alias("n"), F.min(F.nanvl("t0", F.lit(None))).alias("t0"), F.max(F.nanvl("t1", F.lit(None))).alias("t1"),
    )
    cols = ["entity", "first_key", "last_key", "n", "t0", "t1"]
    whole = inner.select(*cols).unionByName(edge.select(*cols)).withColumns({t: F.nanvl(t, F.lit(None)) for t in ("t0", "t1")})
    return whole.select(
        "entity", "first_key", "last_key", F.col("n").alias("events"), ((F.col("t1") - F.col("t0")) / 1e6).alias("seconds"),
        F.timestamp_micros(F.col("t0").cast("long")).alias("started_at"), F.timestamp_micros(F.col("t1").cast("long")).alias("ended_at"),
    )


def chunk_runs(chunks: DataFrame) -> DataFrame:
    """Runs of the same output in each stream of an artifact, by seq. Null stream counts as ''; null text is an event of its own."""
    c = F.col
    return collapse_runs(chunks, F.concat(c("artifact_id"), F.lit("/"), F.coalesce("stream", F.lit(""))), c("seq"), c("seq").cast("string"), c("chunk_time"), [same_event_text(c("chunk_text"))])


def command_runs(runs: DataFrame) -> DataFrame:
    """Runs of the same command with the same outcome in each session, by created_at."""
    c = F.col
    same = [F.col(x) for x in ("executable", "args", "cwd", "run_status", "child_exit_code", "timed_out", "cancelled")]
    return collapse_runs(runs, c("session_id"), F.unix_micros("created_at"), c("run_id"), c("created_at"), same)
