"""Import graph: resolution of relative specifiers and bounded breadth-first expansion with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut

# Extensions that a specifier may leave out, and sources that a compiled name stands for (fixed values).
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
SOURCES_OF = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
STATIC_IMPORT = r"(?:import|export)[^'\";]*?from\s+['\"]([^'\"]+)['\"]|import\s+['\"]([^'\"]+)['\"]"


def imports_of(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, specifier) of static imports and re-exports, each once per file."""
    one = F.regexp_extract_all("file_content", F.lit(r"(?m)^\s*(?:import|export)\b[^'\";]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]"), 1)
    return files.select("repository_id", "file_path", F.explode(F.array_distinct(one)).alias("specifier"))


def joined_path(folder: Column, specifier: Column, climbs: int = 12) -> Column:
    """folder/specifier with . and .. worked off; what climbs out of the root begins with ../ still."""
    p = F.concat(folder, F.lit("/"), specifier)
    p = F.regexp_replace(F.regexp_replace(p, r"/(?:\./)+", "/"), r"/{2,}", "/")
    for _ in range(climbs):
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return F.regexp_replace(p, r"^/", "")


def resolved_imports(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, specifier, outcome, target) of relative imports.

    outcome: ok, ambiguous, unresolved, outside_repository, unsupported_specifier. An existing file of the very name wins; a compiled
    name may stand for its source; a name without extension for any source or an index of that folder. Other specifiers are left out.
    """
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    refs = imports_of(files).filter(F.col("specifier").rlike(r"^\.\.?/")).withColumn("base", joined_path(folder, F.col("specifier")))
    ext = F.regexp_extract(F.regexp_extract("base", r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1)
    refs = refs.withColumn("ext", ext)
    bare = F.regexp_replace("base", r"\.[^./]*$", "")
    swaps = F.array().cast("array<string>")
    for e, sources in SOURCES_OF.items():
        swaps = F.when(F.col("ext") == e, F.array(*[F.concat(bare, F.lit(s)) for s in sources])).otherwise(swaps)
    plain = F.array(*[F.concat(F.col("base"), F.lit(x + e)) for e in EXTENSIONS for x in ("", "/index")])
    bad = F.col("specifier").rlike(r"[\\\x00?#]")
    outside = F.col("base").rlike(r"^\.\.(?:/|$)")
    own = F.when(F.col("ext").isin(EXTENSIONS), F.array(F.struct(F.lit(0).alias("rank"), F.col("base").alias("path")))).otherwise(F.array().cast("array<struct<rank:int,path:string>>"))
    others = F.transform(F.when(F.col("ext") != "", swaps).otherwise(plain), lambda p: F.struct(F.lit(1).alias("rank"), p.alias("path")))
    wanted = refs.filter(~bad & ~outside).select("repository_id", "file_path", "specifier", F.explode(F.concat(own, others)).alias("c")).select("repository_id", "file_path", "specifier", "c.rank", F.col("c.path").alias("target"))
    there = files.select("repository_id", F.col("file_path").alias("target"))
    found = wanted.join(there, ["repository_id", "target"])
    best = found.groupBy("repository_id", "file_path", "specifier").agg(F.min("rank").alias("rank"), F.count_if(F.col("rank") == 1).alias("n"), F.min_by("target", F.struct("rank", "target")).alias("target"))
    rows = refs.select("repository_id", "file_path", "specifier", bad.alias("bad"), outside.alias("outside")).join(best, ["repository_id", "file_path", "specifier"], "left")
    outcome = F.when(F.col("bad"), "unsupported_specifier").when(F.col("outside"), "outside_repository").when(F.col("target").isNull(), "unresolved").when((F.col("rank") == 1) & (F.col("n") > 1), "ambiguous").otherwise("ok")
    return rows.select("repository_id", "file_path", "specifier", outcome.alias("outcome"), "target").withColumn("target", F.when(F.col("outcome") == "ok", F.col("target")))


def expand(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_files: int | None = 64) -> DataFrame:
    """(repository_id, file_path, root, depth, via) of files reached from the roots within max_depth imports, at most max_files per repository.

    The first way in breadth-first order wins: by depth, then the order of the importer, then the specifier. Roots are not in the
    result. edges: repository_id, file_path, specifier, target. One join and one window per level; each level is checkpointed.
    """
    seen = cut(roots.select("repository_id", "file_path").distinct())
    front = seen.select("repository_id", "file_path", F.col("file_path").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.col("file_path").alias("_path"))
    front = front.withColumn("_o", F.row_number().over(Window.partitionBy("repository_id").orderBy("file_path")))
    reached = None
    for depth in range(1, max_depth + 1):
        step = edges.select("repository_id", F.col("file_path").alias("_from"), "specifier", "target").join(front.select("repository_id", F.col("file_path").alias("_from"), "root", "_o"), ["repository_id", "_from"])
        best = step.groupBy("repository_id", "target").agg(F.min(F.struct("_o", "specifier", "_from", "root")).alias("b"))
        new = best.join(seen.select("repository_id", F.col("file_path").alias("target")), ["repository_id", "target"], "left_anti")
        order = Window.partitionBy("repository_id").orderBy("b._o", "b.specifier", "target")
        new = new.select("repository_id", F.col("target").alias("file_path"), F.col("b.root").alias("root"), F.lit(depth).alias("depth"), F.col("b._from").alias("via"), F.row_number().over(order).alias("_o"))
        if max_files is not None:
            used = reached.groupBy("repository_id").agg(F.count(F.lit(1)).alias("_u")) if reached is not None else None
            new = new.join(used, "repository_id", "left").filter(F.col("_o") + F.coalesce("_u", F.lit(0)) <= max_files).drop("_u") if used is not None else new.filter(F.col("_o") <= max_files)
        front = cut(new)
        reached = front if reached is None else reached.unionByName(front)
        seen = seen.unionByName(front.select("repository_id", "file_path"))
    return reached.drop("_o")


def import_issues(resolved: DataFrame, shown: int = 20) -> DataFrame:
    """(repository_id, issues, omitted): for each repository the first `shown` imports whose outcome is not ok, by importer and specifier, and the
    number of all others. A window of `shown` rows is cut before anything is gathered."""
    bad = resolved.filter("outcome <> 'ok'").select("repository_id", "file_path", "specifier", "outcome")
    w = Window.partitionBy("repository_id").orderBy("file_path", "specifier")
    first = bad.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= shown)
    issues = first.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("_k", "file_path", "specifier", "outcome"))).alias("issues"))
    total = bad.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(issues, "repository_id").select("repository_id", F.transform("issues", lambda x: F.struct(x["file_path"].alias("importer"), x["specifier"].alias("specifier"), x["outcome"].alias("issue"))).alias("issues"), (F.col("n") - F.size("issues")).alias("omitted"))
