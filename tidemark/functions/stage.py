"""Materialised intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a fresh temporary one for local runs without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes a table that several later steps read, and returns a scan of it.

    Later steps survive lost executors without recomputing it, the planner knows its
    real size, and only needed columns are read back. The shuffle files of the write go with it:
    nothing reads them any more, and else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a table from `stage` that no later step reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged (narrow) table when its row count, read from file footers, is small.

    Larger tables come back without a hint and take part in an ordinary shuffled join.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def global_places(df: DataFrame, order: list, label: str = "places") -> DataFrame:
    """Adds `place` (from 1) in the given total order without sorting everything in one task.

    The range-partitioned sort is written once with its row numbers per partition; the
    start of each partition comes from the few partition sizes.
    """
    from pyspark.sql import Window as W

    numbered = df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    fixed = stage(numbered, label)
    sizes = fixed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", "_first", before.alias("_before"))
    placed = fixed.join(F.broadcast(starts), "_p")  # one row per partition of the sort
    return placed.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias("place"))
