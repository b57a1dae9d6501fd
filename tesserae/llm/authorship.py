"""Generated, minified, vendored and bulk-data files, told apart from hand-written source.

Method: a random forest over figures of the content (compression ratio, token entropy, identifier lengths, comment density, line shapes),
of the path, and of the collection (in how many repositories the same body stands), labelled by the notices that tools and third parties
leave in a file's comments, and by names where a format has no comments. The comments at both ends are cut off before any figure is taken,
so the forest never sees a notice; it finds the files that bear none. A file whose own comments bear one is what they say.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import log2, log10

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, spread
from tesserae.operators.lookup import HOT_ROWS, keyed_lookup

#: Labelled rows of the largest class that the forest is fitted on at most.
SAMPLE = 8_000
#: Parts of the files; each is scored by a forest of the others.
FOLDS = 3
CLASSES = ("hand", "tool", "third")

# Notices of tools and of third parties in comments at the ends of a file (fixed values).
_TOOL = re.compile(
    r"do not (?:edit|modify)|not (?:edit|modify) (?:this file )?by hand|@generated\b|auto-?generated|automatically generated|generated (?:automatically|by \S+)|produced automatically|code generated|(?:this file|changes|manual edits)[^\n]{0,60}(?:will be|are) (?:lost|overwritten)|\boutput, checksum\b|^\s*/\*! [\w.@/-]+ \| build \w+|eslint-disable \*/\s*$",
    re.I | re.M,
)
_THIRD = re.compile(r"^\W*upstream: \S+|copied unchanged|report problems to the upstream|\(c\) (?:\d{4} )?the \w+ authors|released under [^\n]{0,30}licen[cs]e|@license\b|SPDX-License|permission is hereby granted|vendored from", re.I | re.M)
# Names by which tools and formats announce what bears no comment: lock files, bundles, schemas, tables of data; and folders of one
# version of a third party's package (fixed values).
_PACKAGE = re.compile(r"(?:^|/)(?:node_modules|vendor|third[_-]?party|3rd[_-]?party|external|bower_components)/(?:[^/]+/)*[\w.@-]+-\d+\.\d+(?:\.\d+)?/|(?:^|/)(?:node_modules|bower_components)/")
_NAMED = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|Cargo\.lock|poetry\.lock|Pipfile\.lock|Gemfile\.lock|[\w.-]+\.lock\.json)$"
    r"|(?:^|/)(?:__generated__|gen|proto|wire|dist|assets|public/js|src/data)/|\.(?:min|prod|bundle|generated|g|pb)\.\w+$|_pb\.\w+$|-(?:icons|bundle|table|data)\.\w+$"
)
_NOT_IT = re.compile(r"inspired by|edit freely|hand-(?:tuned|written)|rewritten here", re.I)

_HEAD = re.compile(r"\A﻿?(?:\s++|//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|#[^\n]*+|['\"]use strict['\"];?|<!--(?:[^-]|-(?!->))*+-->)++")
_WRITTEN = (".md", ".mdx", ".txt")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
_COMMENT = re.compile(r"(?<![:\w'\"])//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|^[ \t]*#[^\n]*", re.M)
_SHAPE = bytes(97 if c > 127 or chr(c).isalnum() or chr(c) in "_$" else 32 if chr(c) in " \t\r\f\v" else c for c in range(256))
_CASED = re.compile(r"[A-Z][a-z]+|\d+")
_VERSION = re.compile(r"\d+\.\d+")
_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")
_DIGITS, _SPACES = b"0123456789", b" \t\n\r\f\v"
_PLAIN = bytes(c for c in range(256) if c > 127 or chr(c).isalnum() or chr(c).isspace())

FEATURES = [
    "compression", "entropy", "distinct_tokens", "ident_length", "ident_short", "ident_numbered", "comments", "log_size", "log_lines", "log_mean_line", "log_max_line",
    "line_shapes", "line_shapes_cased", "digits", "punctuation", "blanks", "quoted", "log_longest_quoted", "hex_words", "indented", "integrity", "markup", "json", "written",
    "path_depth", "path_versions", "repositories",
]


def parts_of(text: str) -> tuple[str, str, str]:
    """(comments at the beginning, body, comments at the end) of a text, whole comments only."""
    m = _HEAD.match(text)
    a, end = (m.end() if m else 0), len(text)
    while end > a:
        start = max(text.rfind("\n", a, end - 1) + 1 if end > a + 1 else a, a)
        line = text[start:end].strip()
        if not line or line.startswith(("//", "#")):
            end = start
        elif line.endswith("*/"):
            opened = text.rfind("/*", a, end)
            if opened < 0 or text[text.rfind("\n", a, opened) + 1 if text.rfind("\n", a, opened) >= 0 else a : opened].strip():
                break
            end = opened
        else:
            break
    return text[:a], text[a:end], text[end:]


def _says(comments: str) -> str | None:
    lines = "\n".join(x for x in comments.split("\n") if not _NOT_IT.search(x))
    return "third" if _THIRD.search(lines) else "tool" if _TOOL.search(lines) else None


def notice(path: str, text: str) -> str | None:
    """What a file says about itself in the comments at its ends: 'tool' or 'third'; None if nothing. Documents about such files say nothing."""
    if path.lower().endswith(_WRITTEN):
        return None
    head, _, tail = parts_of(text)
    return _says(head) or _says(tail)


def path_features(path: str) -> list[float]:
    """Depth, and folders that bear a version."""
    parts = [p for p in path.split("/")[:-1] if p]
    return [float(len(parts)), float(sum(_VERSION.search(p) is not None for p in parts))]


def content_features(path: str, body: str) -> list[float]:
    """Figures of a body without the comments around it, and of its path; see FEATURES, of which the last is of the collection."""
    n = len(body)
    if not n:
        return [0.0] * (len(FEATURES) - 1)
    raw = body.encode("utf-8", "replace")
    size = len(raw)
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    idents = [(t, c) for t, c in counts.items() if t[0] in _START]
    strings = [(len(t), c) for t, c in counts.items() if t[0] in "\"'" and len(t) > 1]
    k = max(1, sum(c for _, c in idents))
    lines = [x for x in body.split("\n") if x and not x.isspace()]
    m = max(1, len(lines))
    shapes = raw.translate(_SHAPE)
    for long, short in ((b"aaaa", b"a"), (b"aa", b"a"), (b"aa", b"a"), (b"aa", b"a"), (b"  ", b" "), (b"  ", b" "), (b"a a", b"a"), (b"a a", b"a")):
        shapes = shapes.replace(long, short)
    comments = sum(map(len, _COMMENT.findall(body))) if "//" in body or "/*" in body or "#" in body else 0
    ext = path.rsplit(".", 1)[-1].lower()
    return [
        len(zlib.compress(raw, 1)) / size,
        log2(total) - sum(k * c * log2(c) for c, k in Counter(counts.values()).items()) / total,
        len(counts) / total,
        sum(len(t) * c for t, c in idents) / k,
        sum(c for t, c in idents if len(t) <= 2) / k,
        sum(c for t, c in idents if t[-1].isdigit()) / k,
        min(1.0, comments / n),
        log10(n), log10(m), log10(n / m), log10(max(map(len, lines), default=1) + 1),
        len(set(map(bytes.strip, shapes.split(b"\n")))) / m, len(set(map(str.strip, _CASED.sub("W", body).split("\n")))) / m,
        1 - len(raw.translate(None, _DIGITS)) / size,
        len(raw.translate(None, _PLAIN)) / size,
        1 - len(raw.translate(None, _SPACES)) / size,
        min(1.0, sum(k * c for k, c in strings) / n), log10(max(strings, default=(0, 0))[0] + 1),
        sum(c for t, c in counts.items() if t.startswith("0x")) / total,
        sum(x[0] in " \t" for x in lines) / m,
        (body.count("integrity") + body.count("resolved") + body.count("sha512-")) / m,
        body.count("</") / m,
        float(ext == "json"),
        float(ext in ("md", "mdx", "txt", "yaml", "yml", "toml", "sh")),
        *path_features(path),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, r, p, t in zip(b["file_id"], b["repository_id"], b["file_path"], b["file_content"]):
            p, t = p or "", (t or "").replace("\r\n", "\n")
            head, body, tail = parts_of(t)
            said = None if p.lower().endswith(_WRITTEN) else _says(head) or _says(tail)
            body = body.strip()
            rows.append((i, r, said, "third" if _PACKAGE.search(p) else "tool" if _NAMED.search(p) else None, xxhash.xxh3_128_hexdigest(body) if body else None, np.array(content_features(p, body))))
        yield pd.DataFrame(rows, columns=["file_id", "repository_id", "notice", "named", "body", "figures"])


def measured_files(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (file_id, notice, named, copied, figures, body, filled): what a file's comments say, what its name says, what the comments of any
    copy of its body say, its FEATURES, a key of the body, and whether there is one."""
    need = ["file_id", F.col("repository_id") if "repository_id" in files.columns else F.lit(None).cast("string").alias("repository_id"), "file_path", "file_content"]
    rows = cut(spread(files.select(*need)).mapInPandas(_measure, "file_id long, repository_id string, notice string, named string, body string, figures array<double>"))
    # bodies over the whole collection; their copies within one repository fall together map-side
    by_repo = rows.filter("body is not null").groupBy("body", "repository_id").agg(F.count(F.lit(1)).alias("n"), F.max("notice").alias("copied"))
    bodies = by_repo.groupBy("body").agg(F.sum("n").alias("n"), F.count("repository_id").alias("repositories"), F.max("copied").alias("copied"))
    empty = rows.filter("body is null").withColumns({"repositories": F.lit(0).cast("long"), "copied": F.lit(None).cast("string")})
    known = keyed_lookup(rows, bodies, "body", "n", hot_rows, rows.count())
    out = known.unionByName(empty)
    return out.select("file_id", "notice", "named", "copied", F.concat("figures", F.array(F.log2(F.lit(1.0) + F.col("repositories")))).alias("figures"), "body", F.col("body").isNotNull().alias("filled"))


def classify_files(files: DataFrame, threshold: float | None = None, trees: int = 40, sample: int = SAMPLE, seed: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (file_id, notice, score, by_score, is_case) for every file.

    The forest tells three classes apart: files labelled as a tool's, as a third party's, and all others. A label comes from the notice in
    the comments of the file or of any copy of its body, and where there is none from the file's name or folder. It is fitted on a sample of at most about `sample` rows of the largest class,
    drawn by a hash of file_id with one share for all classes, so that their ratio is the table's at every size. score is the share of
    votes that a file is not hand-written, of a forest that has not seen it: one is fitted for each third of the files on the other two,
    copies of a body staying together, so that no file's missing notice pushes its own votes down. If no threshold is given, it is that of
    the hundredths at which r^2 / q is greatest: r is the share of labelled files at or above it, q that of all files (as files without a
    notice may be cases, precision is not known, but r^2 / q is greatest where recall times precision is). Both are shares of the whole
    table. by_score says whether the score reaches the threshold; is_case also where a file's own comments say so, which is exact.
    If a third leaves a class empty, one forest serves all; without labelled and unlabelled files in the sample (an empty table, say) score
    is null and only notices count. Null paths and contents count as empty; an empty content is no case. Files need no repository_id.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cut(measured_files(files, hot_rows))
    said = F.coalesce("notice", "copied", "named")
    rows = rows.withColumn("label", F.when(said == "third", 2.0).when(said == "tool", 1.0).otherwise(0.0))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    noticed = rows.select("file_id", "notice", F.lit(None).cast("double").alias("score"), F.lit(False).alias("by_score"), F.col("notice").isNotNull().alias("is_case"))
    if len(counts) < 2 or 0.0 not in counts:
        return noticed
    u = F.xxhash64(F.lit(seed), "file_id") / 2.0**64 + 0.5
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce("body", F.col("file_id").cast("string"))), F.lit(FOLDS)).cast("int")
    rows = rows.select("file_id", "notice", "label", "filled", array_to_vector("figures").alias("features"), fold.alias("fold"), u.alias("u"))
    train = cut(rows.filter(F.col("u") < min(1.0, sample / max(counts.values()))).select("features", "label", "fold").repartition(8))
    seen = {(r["fold"], r["label"]) for r in train.select("fold", "label").distinct().collect()}
    labels = {y for _, y in seen}
    if len(labels) < 2:
        return noticed
    folds = FOLDS if all(any(f != k and y == label for f, y in seen) for k in range(FOLDS) for label in labels) else 1
    forest = RandomForestClassifier(numTrees=trees, maxDepth=9, minInstancesPerNode=2, featureSubsetStrategy="sqrt", subsamplingRate=0.8, maxBins=48, seed=seed, cacheNodeIds=False)
    with ThreadPoolExecutor(folds) as pool:  # fits are many small jobs, which leave most of a cluster idle one after the other
        models = list(pool.map(lambda k: forest.fit(train.filter(F.col("fold") != k) if folds > 1 else train), range(folds)))
    score = 1 - vector_to_array("probability")[0]
    parts = [m.transform(rows.filter(F.col("fold") == k) if folds > 1 else rows) for k, m in enumerate(models)]
    scored = cut(reduce(DataFrame.unionByName, parts).select("file_id", "notice", "label", "filled", score.alias("score")))
    if threshold is None:
        bins = scored.filter("filled").groupBy(F.floor(F.col("score") * 100).alias("at")).agg(F.count_if(F.col("label") > 0).alias("r"), F.count(F.lit(1)).alias("q")).collect()  # at most 101
        above = {t: (sum(b["r"] for b in bins if b["at"] >= t), sum(b["q"] for b in bins if b["at"] >= t)) for t in range(1, 101)}
        threshold = max(above, key=lambda t: above[t][0] ** 2 / max(1, above[t][1])) / 100
    by_score = F.col("filled") & (F.col("score") >= threshold)
    return scored.select("file_id", "notice", "score", by_score.alias("by_score"), (by_score | F.col("notice").isNotNull()).alias("is_case"))
