"""Entry points for programs: settings, discovery of a project, and the named functions over a folder of tables.

    python -m tesserae.api changes --tables DIR     and likewise: context, evidence, query
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_FILE = ".tesserae.json"


@dataclass(frozen=True)
class Settings:
    """Settings with their defaults (fixed values) and, in LIMITS, the ranges that they must keep."""

    mode: str = "observe"
    context_budget: int = 8000
    name_weight: float = 12
    text_weight: float = 4
    location_weight: float = 30
    dependency_weight: float = 6
    test_weight: float = 5
    max_depth: int = 2
    max_files: int = 64
    output_max_bytes: int = 4 << 20
    output_preview_bytes: int = 64 << 10
    disk_budget_bytes: int = 128 << 20
    artifact_retention_days: int = 14
    command_timeout_ms: int = 120_000


MODES = ("observe", "balanced", "experimental")
LIMITS = {
    "context_budget": (128, 1_000_000), "max_depth": (0, 8), "max_files": (0, 512), "output_max_bytes": (1024, 64 << 20), "output_preview_bytes": (1024, 1 << 20),
    "disk_budget_bytes": (4 << 20, 1 << 30), "artifact_retention_days": (1, 3650), "command_timeout_ms": (1, 86_400_000),
}


def bounded(name: str, value: Any, least: int, most: int) -> int:
    """value, which must be a whole number within its range."""
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return value


def read_bounded(path: str, most_bytes: int = 1 << 20) -> str:
    """The text of a regular file of at most so many bytes; links are refused."""
    with os.fdopen(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
        raw = f.read(most_bytes + 1)
    if len(raw) > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    return raw.decode()


def load_settings(root: str, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """Defaults, overruled by the file in the project's root, by TESSERAE_... variables, by overrides; unknown names and bad values are refused."""
    names = {f.name: type(f.default) for f in fields(Settings)}
    path = os.path.join(root, CONFIG_FILE)
    layers: list[dict[str, Any]] = [json.loads(read_bounded(path)) if os.path.exists(path) else {}]
    layers.append({n: kind(env[f"TESSERAE_{n.upper()}"]) for n, kind in names.items() if f"TESSERAE_{n.upper()}" in env})
    layers.append(dict(overrides or {}))
    values: dict[str, Any] = {}
    for layer in layers:
        if not isinstance(layer, dict) or set(layer) - set(names):
            raise ValueError(f"unknown settings: {sorted(set(layer) - set(names)) if isinstance(layer, dict) else layer}")
        values |= layer
    if values.get("mode", "observe") not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    for name, (least, most) in LIMITS.items():
        if name in values:
            bounded(name, values[name], least, most)
    for name, value in values.items():
        if name.endswith("_weight") and not (isinstance(value, (int, float)) and value >= 0):
            raise ValueError(f"{name} must not be negative")
    return Settings(**values)


def project_root(start: str) -> str | None:
    """The nearest folder, from `start` up, that holds a settings file."""
    at = os.path.realpath(start)
    while True:
        if os.path.isfile(os.path.join(at, CONFIG_FILE)):
            return at
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


def safe_path(root: str, path: str) -> str:
    """A path below the root, links followed; fails for what leads out of it."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} leads out of {root}")
    return full


def response(rows: DataFrame, most_bytes: int = 1 << 20) -> list[dict[str, Any]]:
    """Rows for a caller; fails before they are fetched if their JSON has more than `most_bytes`."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    size = rows.select(F.sum(F.octet_length(line) + 1)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the response has {size} bytes, {most_bytes} are allowed")
    return [json.loads(r[0]) for r in rows.select(line).collect()]


def write_records(rows: DataFrame, folder: str) -> None:
    """Result records as JSON lines; Spark's committer makes them appear at once or not at all."""
    rows.write.mode("errorifexists").json(folder)


def prepare_context(spark: SparkSession, tables: str, task: str, budget: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """One package of the repository's source for a task, within a budget of tokens."""
    from tesserae.functions.runtime import table
    from tesserae.operators.context import fragments, packages
    from tesserae.operators.search import Weights, relevance, text_matches, with_related

    budget = bounded("budget", settings.context_budget if budget is None else budget, 128, 1_000_000)
    weights = Weights(settings.name_weight, settings.text_weight, settings.location_weight, settings.dependency_weight, settings.test_weight)
    files, symbols = table(spark, tables, "indexed_files"), table(spark, tables, "source_symbols")
    tasks = spark.createDataFrame([("task", task)], "task_id string, task string")
    names = symbols.groupBy("file_id").agg(F.concat_ws(" ", F.collect_list("symbol_name")).alias("s"))
    named = files.join(names, "file_id", "left").select("file_id", "file_path", F.concat_ws(" ", "file_path", "s").alias("names"))
    found = relevance(tasks, named, text_matches(tasks, files.select(F.col("file_id").alias("doc_id"), F.col("file_content").alias("content"))), weights)
    scores = with_related(found, files, weights, settings.max_depth, settings.max_files).join(F.broadcast(tasks), "task_id")  # one task
    c = fragments(files, symbols, scores, scores.select("task_id", "file_id").filter("false"), settings.name_weight).withColumnRenamed("file_path", "path")
    c = c.withColumn("evidence_id", F.concat_ws("-", "evidence_id", "file_id", "symbol")).dropDuplicates(["task_id", "evidence_id"])
    return packages(c, tasks.withColumn("budget", F.lit(budget)))


def read_evidence(spark: SparkSession, tables: str, artifact_id: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of an artifact's chunks in their order, with has_more."""
    from tesserae.functions.runtime import table
    from tesserae.operators.lines import keyset_page

    rows = table(spark, tables, "artifact_chunks").filter(F.col("artifact_id") == artifact_id).dropDuplicates(["artifact_id", "seq"])
    return keyset_page(rows, ["artifact_id"], "seq", bounded("offset", offset, 0, 2**31 - 1), bounded("limit", limit, 1, 1000))


def get_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, modified, renamed and deleted between two snapshots (repository_id, path, hash)."""
    from tesserae.operators.snapshots import diff

    return diff(old, new)


def main(args: list[str] | None = None) -> None:
    from tesserae.functions.runtime import session

    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("what", choices=["context", "evidence", "query", "settings"])
    p.add_argument("name", nargs="?", help="the task, the artifact or the query")
    p.add_argument("--tables", default=".")
    p.add_argument("--budget", type=int)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int, default=100)
    a = p.parse_args(args)
    settings = load_settings(project_root(os.getcwd()) or os.getcwd())
    if a.what == "settings":
        print(json.dumps(asdict(settings), indent=1))
        return
    spark = session("tesserae")
    if a.what == "context":
        rows = prepare_context(spark, a.tables, a.name or "", a.budget, settings)
    elif a.what == "evidence":
        rows = read_evidence(spark, a.tables, a.name or "", a.offset, a.limit)
    else:
        import importlib

        from tesserae.plans import CATALOGS

        rows = {n: f for c in CATALOGS for n, f in importlib.import_module(c).QUERIES.items()}[a.name](spark, a.tables)
    for row in response(rows):
        print(json.dumps(row, ensure_ascii=False))


if __name__ == "__main__":
    main()
