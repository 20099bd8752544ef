"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stage import maybe_broadcast, stage_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BITMAPS = 16_384  # of 4 KB that tasks get at most; beyond, rows and bitmaps meet in a shuffled join


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch that returns one batch, several or none."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = fn(batch)
            if made is None:
                continue
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    return df.mapInArrow(run, schema)


def in_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1_000) -> DataFrame:
    """mapInArrow with a function of at most `rows` rows at a time; what it held goes back to the system when the task ends."""

    def run(batches):
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield fn(batch.slice(at, rows))
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory of this worker back, since workers stay alive beside later steps; does nothing where the C library has no way."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def unique_names(df: DataFrame, wanted: Sequence[str]) -> dict[str, str]:
    """Free column names for helper columns, so that extra columns of the input never clash."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        free = name
        while free.lower() in taken:
            free = "_" + free
        taken.add(free.lower())
        out[name] = free
    return out


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table holds."""
    return df.select(*[df[n] for n in names])


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Writes `df` to the shared folder of spark.checkpoint.dir and returns a scan of it.

    Cuts the lineage: later steps survive lost executors without computing it again. `codec` compresses other than by the session's.
    """
    path = f"{stage_dir(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Tables written meanwhile pass long texts to Python in batches of `rows`: both sides of the pipe hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from `written` that no later step reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """A written copy of `df` with a number per row, and that column's name; every scan of it has the same numbers."""
    name = unique_names(df, ["row"])["row"]
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def only_rows(rows: DataFrame, name: str, kept: DataFrame, number: str = "row") -> DataFrame:
    """The rows of a table from `numbered`, or with its numbers, that `kept` names: other columns, such as texts, are not shuffled.

    The numbers become bitmaps of 32,768 numbers each. Those of a written partition are consecutive, so a bitmap stands for many rows.
    """
    at = unique_names(rows, ["bucket", "bits", "bit"])
    bucket, bits, bit = (at[n] for n in ("bucket", "bits", "bit"))
    here = kept.select(F.bitmap_bucket_number(F.col(number) + 1).alias(bucket), F.bitmap_bit_position(F.col(number) + 1).alias(bit))
    # Dealt by bucket first: a task adds bits to its own bitmaps alone.
    made = written(here.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bits)), "row-bitmaps")
    placed = rows.withColumn(bucket, F.bitmap_bucket_number(F.col(name) + 1)).withColumn(bit, F.bitmap_bit_position(F.col(name) + 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(maybe_broadcast(made, BITMAPS), bucket).filter(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1)
    return found.select(*[found[c] for c in rows.columns])


def one_of_each(rows: DataFrame, name: str, named: DataFrame, group: str) -> DataFrame:
    """The rows of a `numbered` table that come first in their group by doc_id (null last), text_hash and row.

    named: row, doc_id, text_hash and the group of every row. A minimum, so tasks add up a large group in parts.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "row"))
    kept = named.groupBy(group).agg(first.alias("first")).select(F.col("first.row").alias(name))
    return only_rows(rows, name, kept, name)
