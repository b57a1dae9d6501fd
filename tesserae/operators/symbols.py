"""Declarations and module references of source files, by the forms of their lines. There is no parser here: what a line begins with decides,
so nested or oddly laid out declarations are missed, and `confidence` says how sure a reference is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A declaration at the beginning of a line: export, modifiers, kind, name.
DECLARATION = r"(?m)^(export\s+(?:default\s+)?)?((?:declare\s+|abstract\s+|async\s+)*)(function\*?|class|interface|type|enum|namespace|const|let|var)\s+([A-Za-z_$][\w$]*)"
STATIC = r"(?m)^\s*(?:import|export)\b[^'\";]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]"
DYNAMIC = r"\b(?:import|require)\s*\(\s*(?:['\"]([^'\"\n]+)['\"]\s*\)|(?!['\"]))"


def declared_symbols(files: DataFrame) -> DataFrame:
    """(file_id, symbol_name, symbol_kind, exported) of the declarations that begin a line; a null content has none."""
    found = F.regexp_extract_all("file_content", F.lit(DECLARATION), 0)
    rows = files.filter("file_content is not null").select("file_id", F.explode(found).alias("d"))
    part = lambda g: F.regexp_extract("d", DECLARATION, g)
    return rows.select("file_id", part(4).alias("symbol_name"), F.regexp_replace(part(3), r"\*|^(?:let|var)$", "").alias("k"), part(1).alias("e")).select("file_id", "symbol_name", F.when(F.col("k") == "", "variable").otherwise(F.col("k")).alias("symbol_kind"), (F.col("e") != "").alias("exported"))


def references_of(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, specifier, dynamic, confidence): static imports and re-exports, and dynamic ones; a dynamic one without a literal
    has the specifier <unresolved>. Each once for each file."""
    static = F.transform(F.array_distinct(F.regexp_extract_all("file_content", F.lit(STATIC), 1)), lambda x: F.struct(x.alias("specifier"), F.lit(False).alias("dynamic"), F.lit("exact").alias("confidence")))
    named = lambda x: F.when(x == "", "<unresolved>").otherwise(x)
    dynamic = F.transform(
        F.array_distinct(F.transform(F.regexp_extract_all("file_content", F.lit(DYNAMIC), 1), named)), lambda x: F.struct(x.alias("specifier"), F.lit(True).alias("dynamic"), F.when(x == "<unresolved>", "unresolved").otherwise("literal").alias("confidence"))
    )
    return files.filter("file_content is not null").select("repository_id", "file_path", F.explode(F.concat(static, dynamic)).alias("r")).select("repository_id", "file_path", "r.*")
