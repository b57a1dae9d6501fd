"""Full-text match and weighted relevance of files for tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut
from tesserae.functions.text import stem_of, task_words, words
from tesserae.operators.graph import expand, resolved_imports
from tesserae.operators.lookup import checked


@dataclass(frozen=True)
class Weights:
    """Points for a word in a name, a text match, an explicit location, an import and a related test."""

    name: float = 12
    text: float = 4
    location: float = 30
    dependency: float = 6
    test: float = 5


#: Words of all tasks together up to which they are looked for within each document's words, beyond by a join.
MOST_TERMS = 5_000


def tokens(c):
    """Tokens of full text: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def text_matches(tasks: DataFrame, docs: DataFrame, limit: int = 300, terms: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(task_id, doc_id, rank_score): the best `limit` documents of each task by BM25 over its first `terms` words.

    tasks: task_id, task; docs: doc_id, content. Only the tasks' words are looked for: documents are tokenized once, and tokens that no
    task holds never leave their task. The ranked candidates are cut per task by a top-k window. Ties go by doc_id.
    """
    q = tasks.select("task_id", F.explode(F.slice(task_words(F.col("task")), 1, terms)).alias("term")).distinct()
    wanted = q.select("term").distinct()
    few = [r[0] for r in wanted.limit(MOST_TERMS + 1).collect()]  # the stated tasks' words
    tokenized = docs.filter("content is not null").select("doc_id", tokens(F.col("content")).alias("t"))
    # the corpus is read and tokenized once: of each document its length and the wanted words stay
    counted = cut(tokenized.select("doc_id", F.size("t").alias("len"), (F.filter("t", lambda x: x.isin(*few)) if len(few) <= MOST_TERMS else F.col("t")).alias("t")))
    n_docs, avg_len = counted.select(F.count(F.lit(1)), F.avg("len")).first()
    avg_len = avg_len or 1.0
    hits = counted.select("doc_id", "len", F.explode("t").alias("term"))
    if len(few) > MOST_TERMS:
        hits = hits.join(wanted, "term", "left_semi")
    tf = hits.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "term").join(q, "term")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len)))
    scored = rows.groupBy("task_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("rank_score"))
    w = Window.partitionBy("task_id").orderBy(F.desc("rank_score"), "doc_id")
    return scored.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def relevance(tasks: DataFrame, files: DataFrame, matches: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """(task_id, file_id, name_hits, text_match, explicit, score) of files with any point for a task.

    files: file_id, file_path, names (path and symbol names). A path that the task's text holds, anywhere, is explicit. Name hits are found
    by an equi-join on words; for explicit paths each file is held against the stated tasks, which go to every worker if they are few.
    `reasons` says in words what brought points.
    """
    q = tasks.select("task_id", F.explode(task_words(F.col("task"))).alias("word")).distinct()
    n = files.select("file_id", F.explode(words(F.col("names"))).alias("word"))
    name = n.join(q, "word").groupBy("task_id", "file_id").agg(F.count(F.lit(1)).alias("name_hits"))
    stated = checked(tasks.select("task_id", "task"), 1000)
    explicit = files.filter("file_path <> ''").select("file_id", "file_path").join(stated, F.contains("task", "file_path")).select("task_id", "file_id", F.lit(True).alias("explicit")).distinct()
    text = matches.select("task_id", F.col("doc_id").alias("file_id"), F.lit(True).alias("text_match"))
    rows = name.join(text, ["task_id", "file_id"], "full_outer").join(explicit, ["task_id", "file_id"], "full_outer")
    rows = rows.select("task_id", "file_id", F.coalesce("name_hits", F.lit(0)).cast("long").alias("name_hits"), F.coalesce("text_match", F.lit(False)).alias("text_match"), F.coalesce("explicit", F.lit(False)).alias("explicit"))
    score = F.col("name_hits") * weights.name + F.col("text_match").cast("int") * weights.text + F.col("explicit").cast("int") * weights.location
    why = F.array_compact(F.array(F.when(F.col("explicit"), "named in the task"), F.when(F.col("name_hits") > 0, F.concat(F.lit("words in names: "), F.col("name_hits").cast("string"))), F.when(F.col("text_match"), "text match")))
    return rows.withColumn("score", score.cast("double")).withColumn("reasons", why)


def required_files(required: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, file_path, missing): files that a task asks for, each once, and whether the repository lacks them. required: task_id, file_path."""
    have = files.select("file_path").distinct().withColumn("_here", F.lit(True))
    return required.select("task_id", "file_path").distinct().join(have, "file_path", "left").select("task_id", "file_path", F.col("_here").isNull().alias("missing"))


def with_related(scores: DataFrame, files: DataFrame, weights: Weights = Weights(), max_depth: int = 2, max_files: int | None = 64) -> DataFrame:
    """(task_id, file_id, score): the scores of relevance() and the points of imports and related tests, also of files with no other.

    Files with a name hit and explicit ones are a task's roots. A file reached from them by resolved imports gets weights.dependency /
    depth; a test gets weights.test for each other root or reached file of its repository whose stem its name holds. That is an
    equi-join on the parts of the test's name. files: repository_id, file_id, file_path, file_content, is_test.
    """
    f = files.select("repository_id", "file_id", "file_path")
    roots = scores.filter("name_hits > 0 or explicit").join(f, "file_id").select(F.struct("task_id", "repository_id").alias("repository_id"), "file_path").distinct()
    asked = roots.select("repository_id").distinct().select(F.col("repository_id").alias("key"), F.col("repository_id.repository_id").alias("repository_id"))
    edges = resolved_imports(files).filter("outcome = 'ok'").join(asked, "repository_id").select(F.col("key").alias("repository_id"), "file_path", "specifier", "target")
    reached = expand(edges, roots, max_depth, max_files).select("repository_id", "file_path", (F.lit(weights.dependency) / F.col("depth")).alias("points"))
    near = roots.unionByName(reached.select("repository_id", "file_path")).select("repository_id.task_id", "repository_id.repository_id", F.col("file_path").alias("of"), stem_of(F.col("file_path")).alias("part"))
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substr(name, i, n))))
    tests = files.filter("is_test").select("repository_id", "file_path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), parts))).alias("part"))
    related = near.join(tests, ["repository_id", "part"]).filter("of <> file_path").select("task_id", "repository_id", "file_path", F.lit(float(weights.test)).alias("points"))
    more = reached.select("repository_id.task_id", "repository_id.repository_id", "file_path", "points").unionByName(related).join(f, ["repository_id", "file_path"])
    every = scores.select("task_id", "file_id", F.col("score").alias("points")).unionByName(more.select("task_id", "file_id", "points"))
    return every.groupBy("task_id", "file_id").agg(F.sum("points").alias("score"))
