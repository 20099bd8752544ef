"""Table reads and writes: lookback scans, inserts without duplicates, upserts, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import timefn as tf
from tidemark.session import AS_OF


def scan_recent(table: DataFrame, as_of: str = AS_OF, days: int = 90, ts: str = "event_time") -> DataFrame:
    """Rows of the last `days`; on a date-partitioned table add `partition_filter` for pruning."""
    return table.filter(tf.since(ts, as_of, days=days))


def partition_filter(column: str, as_of: str = AS_OF, days: int = 90) -> Column:
    """Cutoff on a date partition column, so whole folders are skipped."""
    return F.col(column) >= F.to_date(tf.as_ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Partitioned read of a database table by ranges of a numeric key instead of row offsets."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=dict(options))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, before, n): rows of each Parquet file of a table, and rows in the files before it, by path.

    Reads no column; the running sum orders one row per file.
    """
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.select("file", before.alias("before"), "n")


def scan_batches(spark: SparkSession, path: str, size: int) -> DataFrame:
    """All rows of a Parquet table with `batch`, 0-based: rows in file order are cut every `size` rows, without a sort or shuffle of them."""
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    starts = file_starts(spark, path).select(F.col("file").alias("_file"), F.col("before").alias("_before"))
    numbered = placed.join(F.broadcast(starts), "_file")  # one row per file
    return numbered.select(*rows.columns, F.floor((F.col("_before") + F.col("_at")) / size).alias("batch"))


def scan_offset(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows from `offset` to before `offset + limit` in file order; only files that hold some of them are read."""
    held = file_starts(spark, path).filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    starts = {r["file"]: r["before"] for r in held.collect()}  # the files of one page
    rows = spark.read.parquet(path)
    if not starts:
        return rows.limit(0)
    rows = spark.read.schema(rows.schema).option("basePath", path).parquet(*starts)
    before = F.try_element_at(F.create_map(*[F.lit(v) for pair in starts.items() for v in pair]), F.col("_metadata.file_path"))
    at = before + F.col("_metadata.row_index")
    return rows.filter((at >= offset) & (at < offset + limit))


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns only, cast to the table's types; NaN becomes null, absent columns are null."""
    cols = []
    for field in schema.fields:
        if field.name not in df.columns:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(field.name)
        if isinstance(df.schema[field.name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The earliest row per key. Written as an aggregate, so copies of one key are reduced
    inside each task and never meet in one place."""
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    orderable = [f for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]
    if orderable:
        best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order])).alias("row")
        return df.groupBy(F.col(key).alias("_k")).agg(best).select("row.*")
    return df.groupBy(F.col(key).alias("_k")).agg(F.min(packed).alias("p")).select("p.row.*")


def rows_to_insert(
    new: DataFrame, existing: DataFrame, key: str, order: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """Rows that an append needs: required columns present, one per key, key not in the table yet.

    Rows with a null key count as distinct rows.
    """
    present = new
    for column in required:
        present = present.filter(F.col(column).isNotNull())
    keyed = first_per_key(present.filter(F.col(key).isNotNull()), key, order)
    fresh = keyed.join(existing.select(key), key, "left_anti").select(*new.columns)
    return fresh.unionByName(present.filter(F.col(key).isNull()))


def newest_per_key(new: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the last one in the order of the columns `newest`, then of all columns; null keys are one key."""
    order = [*newest, *[c for c in new.columns if c not in newest and not isinstance(new.schema[c].dataType, (T.MapType, T.VariantType))]]
    row = F.struct(*[F.col(c) for c in new.columns])
    best = new.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("row"))
    return best.select("row.*")


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("id", "created_at"), newest: Sequence[str] = ()
) -> DataFrame:
    """New snapshot: new values replace old rows of the same key, `keep` columns stay as they were.

    Rows of `new` with one key are reduced to the last in the order of the columns `newest`; null keys meet each other.
    When `new` has only key columns, existing rows win. Full outer join by key; write the
    result to a new path, never over the one being read.
    """
    keys = list(keys)
    values = [c for c in old.columns if c not in keys]
    if not [c for c in new.columns if c not in keys]:
        extra = new.join(old.select(*keys), keys, "left_anti").distinct()
        return old.unionByName(extra, allowMissingColumns=True)
    a = old.withColumn("_old", F.lit(True)).alias("a")
    b = newest_per_key(new, keys, newest).withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    cols = [F.when(F.col("_old"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for c in values:
        if c not in new.columns:
            cols.append(F.col(f"a.{c}").alias(c))
        elif c in keep:
            cols.append(F.when(F.col("_old"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*cols)


def append(df: DataFrame, path: str, date_of: str | None = None) -> None:
    """Appends to a parquet table, partitioned by the date of `date_of` if given."""
    if date_of is None:
        df.write.mode("append").parquet(path)
        return
    dated = df.withColumn("dt", F.to_date(date_of))
    # Rows of one day go to several writers, so a heavy day is not one task's work.
    dated.repartition("dt", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(16))).write.mode("append").partitionBy("dt").parquet(path)


# --- named snapshots and versions ---------------------------------------------------------


def save_features(df: DataFrame, root: str, name: str, version: str, fmt: str = "parquet") -> str:
    path = f"{root}/features/{name}/{version}"
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def load_features(spark: SparkSession, root: str, name: str, version: str | None = None, fmt: str = "parquet") -> DataFrame:
    version = version or list_versions(spark, f"{root}/features/{name}")[0]
    return spark.read.format(fmt).load(f"{root}/features/{name}/{version}")


def list_versions(spark: SparkSession, root: str) -> list[str]:
    """Version folders under `root`, newest (highest) name first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)


def save_model(tables: dict[str, DataFrame], root: str, name: str, version: str) -> None:
    """A model is a set of tables (weights, similarities, ...) under one version."""
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/models/{name}/{version}/{table}")


def load_model(spark: SparkSession, root: str, name: str, version: str | None = None) -> dict[str, DataFrame]:
    version = version or list_versions(spark, f"{root}/models/{name}")[0]
    base = f"{root}/models/{name}/{version}"
    return {t: spark.read.parquet(f"{base}/{t}") for t in list_versions(spark, base)}


STAGES = ("raw", "interim", "processed")


def save_stage(df: DataFrame, root: str, stage: str, name: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; use one of {STAGES}")
    path = f"{root}/{stage}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, stage: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}/{name}")
