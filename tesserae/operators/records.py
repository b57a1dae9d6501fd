"""Records of an evidence store as versions of tables: upserts, appends with sequence numbers, quotas, retention, paging, admission, rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.redaction import redacted, split_utf8
from tesserae.operators.running import placed, running_sum


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def upserted(current: DataFrame, changed: DataFrame, keys: Sequence[str], gone: DataFrame | None = None) -> DataFrame:
    """The next version of a table: rows of `changed` replace those with the same keys, rows whose keys stand in `gone` are left out.

    `changed` has one row for each key. Null keys equal each other. Columns are those of `current`; others of `changed` are ignored.
    """
    out = current.alias("c").join(changed.alias("n"), _same("c", "n", keys), "left_anti")
    if gone is not None:
        out = out.alias("c").join(gone.alias("g"), _same("c", "g", keys), "left_anti")
    return out.unionByName(changed.select(*current.columns))


def next_sequence(owners: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, next_seq) of each owner: one more than its greatest number, 0 if it has none."""
    used = rows.groupBy(key).agg(F.max(seq).alias("_m"))
    return owners.select(key).distinct().join(used, key, "left").select(key, (F.coalesce(F.col("_m").cast("long"), F.lit(-1)) + 1).alias("next_seq"))


def appended_chunks(stored: DataFrame, new: DataFrame, quota: int) -> DataFrame:
    """(artifact_id, seq, stream, text) of chunks to add: redacted, cut into pieces of at most 64 KiB, numbered on from what is stored.

    new: artifact_id, ordinal (order of arrival within the artifact), stream, text; stored: artifact_id, seq, text. A piece is added only as
    long as all bytes of the artifact, stored and new, stay within the quota; after the first that does not fit nothing more is added.
    """
    pieces = new.select("artifact_id", "ordinal", "stream", F.posexplode(split_utf8(redacted(F.col("text")))).alias("_p", "text"))
    pieces = placed(pieces, ["artifact_id"], [F.col("ordinal"), F.col("_p")], "_at")
    have = stored.groupBy("artifact_id").agg(F.sum(F.octet_length("text")).alias("_have"))
    start = next_sequence(new, stored, "artifact_id", "seq")
    rows = running_sum(pieces, ["artifact_id"], "_at", [], F.octet_length("text"), "_upto").join(have, "artifact_id", "left").join(start, "artifact_id")
    return rows.filter(F.col("_upto") + F.coalesce("_have", F.lit(0)) <= quota).select("artifact_id", (F.col("next_seq") + F.col("_at")).alias("seq"), "stream", "text")


def raw_appended(rows: DataFrame, data: str, *budgets: Column) -> DataFrame:
    """rows with `data` (binary) cut to the least of what several budgets leave, and `complete`; a negative budget leaves nothing."""
    room = F.greatest(F.lit(0), F.least(*[b.cast("long") for b in budgets], F.octet_length(data).cast("long")))
    return rows.withColumn("complete", F.octet_length(data) <= room).withColumn(data, F.substring(F.col(data), F.lit(1), room.cast("int")))


def kept_packages(packages: DataFrame, most_packages: int = 500, most_evidence: int = 10_000) -> DataFrame:
    """(repository_id, package_id, kept): newest first, a package stays among the newest `most_packages` if all evidence of those that stay,
    its own included, does not exceed `most_evidence`; one that does not fit is passed over and the pass goes on.

    packages: repository_id, package_id, created_at, evidence (array). At most `most_packages` packages of a repository meet in one task.
    """
    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("package_id"))
    newest = packages.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most_packages)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        out = []
        for package, refs in zip(rows.sort_values("_k")["package_id"], rows.sort_values("_k")["evidence"]):
            more = held | set(refs if refs is not None else [])
            if len(more) <= most_evidence:
                held = more
                out.append(package)
        return pd.DataFrame({"repository_id": rows["repository_id"].iloc[0], "package_id": out, "kept": True})

    ids = f"repository_id {packages.schema['repository_id'].dataType.simpleString()}, package_id {packages.schema['package_id'].dataType.simpleString()}, kept boolean"
    good = newest.select("repository_id", "package_id", "evidence", "_k").groupBy("repository_id").applyInPandas(choose, ids)
    return packages.select("repository_id", "package_id").join(good, ["repository_id", "package_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def unreferenced(evidence: DataFrame, packages: DataFrame, key: str, refs: str) -> DataFrame:
    """Evidence that no package refers to."""
    used = packages.select(F.explode(refs).alias(key)).distinct()
    return evidence.join(used, key, "left_anti")


def source_page(files: DataFrame, offset: int, limit: int, expected: Column) -> DataFrame:
    """files with `stale` (the content is not the expected one), `page` (lines from `offset` on, at most `limit`, joined; null if stale), `total_lines`
    and `next_offset` (null at the end)."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("a page begins at 0 or later and has 1 to 1000 lines")
    lines, n = F.split("file_content", "\n", -1), F.size(F.split("file_content", "\n", -1))
    stale = ~F.coalesce(F.sha2("file_content", 256) == expected, F.lit(False))
    return files.withColumn("stale", stale).withColumn("total_lines", n.cast("long")).withColumn("page", F.when(~F.col("stale"), F.array_join(F.slice(lines, offset + 1, limit), "\n"))).withColumn(
        "next_offset", F.when(~F.col("stale") & (n > offset + limit), F.lit(offset + limit).cast("long"))
    )


def admitted(requests: DataFrame, keys: list[str], order: list[Column], cost: Column, limit: int, most: int | None = None) -> DataFrame:
    """requests with `admitted`: in order, as long as the sum of costs stays within the limit and not more than `most` came; after the first
    that is refused all are refused. An unknown cost refuses."""
    rows = placed(requests.withColumn("_c", cost.cast("long")), keys, order, "_at")
    rows = running_sum(rows, keys, "_at", [], F.coalesce("_c", F.lit(limit + 1)), "_upto")
    ok = F.col("_upto") <= limit
    return rows.withColumn("admitted", ok & (F.col("_at") < most) if most is not None else ok).drop("_c", "_at", "_upto")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def without_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; fails when it runs if a key occurs twice."""
    n = duplicate_keys(rows, keys).select(F.count(F.lit(1)).alias("_n"))
    bad = F.when(F.col("_n") > 0, F.raise_error(F.lit("a key occurs more than once")).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(n.filter(bad))).drop("_n")  # one row


def of_one_repository(rows: DataFrame) -> DataFrame:
    """The rows; fails when it runs if they belong to more than one repository."""
    n = rows.select(F.min("repository_id").alias("_a"), F.max("repository_id").alias("_b"))
    bad = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("records of several repositories")).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(n.filter(bad))).drop("_a", "_b")  # one row


def evidence_rules(inputs: DataFrame, refs: str, size: str, most_refs: int = 50, most_bytes: int = 1 << 20) -> DataFrame:
    """inputs with `why_not`: null for valid ones, else no_references, too_many_references, repeated_reference, too_large."""
    n = F.coalesce(F.size(refs), F.lit(0))
    why = F.when(n < 1, "no_references").when(n > most_refs, "too_many_references").when(F.size(F.array_distinct(refs)) < n, "repeated_reference").when(F.col(size) > most_bytes, "too_large")
    return inputs.withColumn("why_not", why)


def sessions_of(external: DataFrame, sessions: DataFrame) -> DataFrame:
    """(external_id, session_id, created): the active session that bears an external id, the newest of several; where there is none, a new one whose
    id is derived from the external id. sessions: session_id, external_id, session_status, created_at."""
    w = Window.partitionBy("external_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    active = sessions.filter("session_status = 'active' and external_id is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("external_id", "session_id")
    new = F.concat(F.lit("session_"), F.substring(F.sha2("external_id", 256), 1, 32))
    return external.select("external_id").distinct().join(active, "external_id", "left").select("external_id", F.coalesce("session_id", new).alias("session_id"), F.col("session_id").isNull().alias("created"))


def running_totals(rows: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """rows with `nth` (from 1) and `upto`: place in the chain and the sum of values up to it; unknown values count as 0."""
    out = placed(rows, keys, order, "_at")
    return running_sum(out, keys, "_at", [], value, "upto").withColumn("nth", F.col("_at") + 1).drop("_at")


def first_arrivals(rows: DataFrame, keys: list[str], order: list[Column], most: int = 4096) -> DataFrame:
    """The first rows of each group in the order of arrival."""
    return placed(rows, keys, order, "_at").filter(F.col("_at") < most).drop("_at")


def known_references(omitted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Omitted references with what they stand for; unknown ones are left out."""
    return omitted.join(candidates, "evidence_id")
