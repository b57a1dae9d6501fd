"""Scan of a source tree, and fingerprints of trees."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, importable
from tesserae.functions.text import is_indexed_sensitive
from tesserae.operators.running import greedy_fill, placed

# Extensions of text that is indexed, and names without one (fixed values).
TEXT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".md", ".mdx", ".txt", ".yaml", ".yml", ".toml", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".css", ".scss", ".html", ".sql", ".sh", ".ps1", ".vue", ".svelte", ".rb", ".php", ".graphql", ".gql"]
TEXT_NAMES = ["Dockerfile", "Makefile"]


def ignore_rule(pattern: str, base: str = "") -> tuple[str, bool, bool] | None:
    """(regular expression over paths from the root, whether it takes back, whether it holds for folders alone) of one ignore pattern that stands in
    the folder `base`; None for blank lines and comments. A pattern with a slash before its end counts from its folder, one without for
    any name below; * stays within a name, ** does not."""
    text = pattern.strip()
    if not text or text.startswith("#"):
        return None
    back, text = text.startswith("!"), text.removeprefix("!")
    folders, anchored, text = text.endswith("/"), "/" in text.rstrip("/"), text.strip("/")
    glob = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(glob.get(x) or (x if x.startswith("[") and x.endswith("]") else re.escape(x)) for x in re.findall(r"\*\*/|/\*\*|\*\*|[*?]|\[[^\]]+\]|[^*?\[/]+|[/\[]", text))
    return (re.escape(base) + ("" if anchored else "(?:.*/)?") + body.replace("[!", "[^")), back, folders


def _ignored(rel: str, folder: bool, rules: list) -> bool:
    """Whether the last rule that holds for a path, or for a folder above it, says so."""
    verdict = False
    for pattern, back, folders in rules:
        m = re.match(f"(?:{pattern})(/|$)", rel)
        if m and (m[1] or folder or not folders):
            verdict = not back
    return verdict


_ENTRY = "rel string, kind string, bytes long, ignored boolean, rules string"


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """(rel, kind, bytes, ignored) of all that lies under a root which the workers share: kind is file, folder or link; links are never followed.

    One round for each level of folders, each folder listed by one row, so a wide tree is listed by all workers. Names that begin with a dot
    or an underscore are listed like all others. Rules of `ignore` hold from the root, those in a folder's ignore files below it; a later or
    deeper one overrules, and ! takes back.
    """
    importable(spark)
    root = os.path.abspath(root)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for folder, text in zip(b["rel"], b["rules"]):
                rules, base = json.loads(text), f"{folder}/" if folder else ""
                for name in ignore_files:
                    place = os.path.join(root, folder, name)
                    if os.path.isfile(place) and not os.path.islink(place):
                        with open(place, encoding="utf-8", errors="replace") as f:
                            rules += [r for line in f if (r := ignore_rule(line, base))]
                text = json.dumps(rules)
                for e in os.scandir(os.path.join(root, folder)):
                    rel, link = base + e.name, e.is_symlink()
                    kind = "link" if link else "folder" if e.is_dir(follow_symlinks=False) else "file"
                    out.append((rel, kind, e.stat(follow_symlinks=False).st_size, _ignored(rel, kind == "folder", rules), text if kind == "folder" else None))
            yield pd.DataFrame(out, columns=["rel", "kind", "bytes", "ignored", "rules"])

    rules = [r for x in ignore or [] if (r := ignore_rule(x))]
    level = spark.createDataFrame([("", json.dumps(rules))], "rel string, rules string")
    every = None
    while True:
        found = cut(level.mapInPandas(listed, _ENTRY))
        every = found if every is None else every.unionByName(found)
        level = found.filter("kind = 'folder'").select("rel", "rules")
        if level.isEmpty():
            return every.drop("rules")
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel")


def scan_tree(spark: SparkSession, root: str, max_file_bytes: int = 1 << 20, max_files: int = 20_000, max_total_bytes: int = 64 << 20, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """(path, bytes, hash, content, skipped) of the files under root; skipped says why a file was not taken, null for those that were.

    Reasons: sensitive, link, ignored, unsupported, too_large, binary, not_utf8, changed (gone or of another size since it was listed),
    file_limit, total_limit. Files are taken in the order of their paths up to max_files; the total is a first-fit pass, as a file that does
    not fit is skipped and the scan goes on. Ignore rules as in walk; sensitive paths cannot be taken back, links are not followed, and no
    file is read before its path, kind and size let it pass.
    """
    place = os.path.abspath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for rel, size, why in zip(b["rel"], b["bytes"], b["why"]):
                raw = None
                if why is None:
                    try:
                        handle = os.open(os.path.join(place, rel), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
                        with os.fdopen(handle, "rb") as f:
                            raw = f.read(int(size) + 1)
                    except OSError:
                        raw = None
                data.append(raw if raw is not None and len(raw) == size else None)
            yield b.assign(content=data)

    rows = walk(spark, root, ignore, ignore_files).filter("kind <> 'folder'")
    name = F.regexp_extract("rel", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    before = (
        F.when(is_indexed_sensitive(F.col("rel")), "sensitive").when(F.col("kind") == "link", "link").when(F.col("ignored"), "ignored")
        .when(~ext.isin(TEXT_EXTENSIONS) & ~name.isin(TEXT_NAMES), "unsupported").when(F.col("bytes") > max_file_bytes, "too_large")
    )
    one = rows.select("rel", "bytes", before.alias("why")).mapInPandas(read, "rel string, bytes long, why string, content binary")
    why = F.coalesce("why", F.when(F.col("content").isNull(), "changed").when(F.expr("contains(content, X'00')"), "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8"))
    judged = cut(one.select("rel", "bytes", F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content"), why.alias("why")))
    # the limits concern paths and sizes alone; contents stay where they are
    sizes = judged.filter("why is null").select(F.lit(1).alias("g"), "rel", F.greatest(F.lit(1), "bytes").cast("long").alias("bytes")).orderBy("rel").limit(max_files)
    fits = greedy_fill(sizes, ["g"], [F.col("rel")], "bytes", F.lit(max_total_bytes), "rel").select("rel", F.lit(True).alias("fits"))
    counted = sizes.select("rel", F.lit(True).alias("counted"))
    out = judged.join(counted, "rel", "left").join(fits, "rel", "left")
    skipped = F.coalesce("why", F.when(F.col("counted").isNull(), "file_limit").when(F.col("fits").isNull(), "total_limit"))
    return out.select(F.col("rel").alias("path"), "bytes", "hash", F.when(skipped.isNull(), F.col("content")).alias("content"), skipped.alias("skipped"))


def fingerprint(files: DataFrame, *keys: str, most_files: int = 10_000) -> DataFrame:
    """One digest per tree over its sorted path:hash lines, of the first `most_files` paths; `files` tells how many these are."""
    rows = placed(files.select(*keys, F.concat_ws(":", "path", "hash").alias("_line")), list(keys), [F.col("_line")], "_place").filter(F.col("_place") < most_files)
    lines = F.array_join(F.array_sort(F.collect_list("_line")), "\n")  # at most most_files
    return rows.groupBy(*keys).agg(F.sha2(lines, 256).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def write_versioned(df: DataFrame, folder: str, version: str) -> str:
    """Write a table as one immutable version; readers take the newest complete one. Spark's committer makes it appear at once or not at all."""
    target = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target
