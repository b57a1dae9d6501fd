"""Token counts: byte estimates everywhere, exact counts by a public vocabulary where its file is at hand."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Split pattern of the byte-level vocabulary (fixed value, public).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to every worker and return its path; a path that the driver does not have is left to the workers."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def located(path: str) -> str:
    """Where a worker has a file: at the same path as the driver, or where it was shipped."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a byte-level vocabulary with their ranks."""
    with open(located(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """A byte-level encoding from a file of ranks; strings of special tokens are plain text."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary_ranks(vocabulary), special_tokens={})


def exact_tokens(c: Column, vocabulary: str) -> Column:
    """Exact token count of a text by the vocabulary in a file; null stays null. See `ship` for workers without the driver's files."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(vocabulary)
        return s.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return count(c)


def resolved_encoding(model: Column, encoding_name: Column, known: dict[str, str]) -> Column:
    """struct(encoding, mapping): the encoding of a known model is verified, of another unknown, without a model unspecified. A given
    encoding that contradicts a known model fails."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = table[model]
    clash = own.isNotNull() & encoding_name.isNotNull() & (own != encoding_name)
    chosen = F.when(clash, F.raise_error(F.lit("encoding does not fit the model")).cast("string")).otherwise(F.coalesce(encoding_name, own))
    mapping = F.when(model.isNull(), "unspecified").when(own.isNotNull(), "verified").otherwise("unknown")
    return F.struct(chosen.alias("encoding"), mapping.alias("mapping"))
