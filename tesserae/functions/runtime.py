"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tesserae", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, skew join)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster without a shared path: --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under sf_dir."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary folder only where a session without one runs on this machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
    return tempfile.mkdtemp(prefix="tesserae-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs one step and not the whole loop.

    The folder is the cluster's spark.checkpoint.dir; only a session without one (a local test) gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def planned_bytes(df: DataFrame) -> int:
    """Size of df as the optimizer estimates it from its files; very large where it cannot tell."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # an estimate that multiplied over many joins has more digits than Python reads
        return 1 << 62


def spread(df: DataFrame) -> DataFrame:
    """Partitions enough for costly per-row work. A small table with few row groups is spread over the shuffle setting's partitions; one
    whose files give every core two splits or more stays as it is, so that large contents are never shuffled for this."""
    spark = df.sparkSession
    size = planned_bytes(df)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if size // split >= 2 * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def digest(*cols: Column) -> Column:
    """A 128-bit key of several columns; a length mark before each part keeps ('a','bc') and ('ab','c') apart, null differs from ''."""
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")) for c in (x.cast("string") for x in cols))))
