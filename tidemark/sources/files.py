"""File sources: json, jsonl, csv, tsv, parquet and txt."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type {ext!r}: {path}")
    return ext


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reads one file (or folder of files) by its extension; repeated columns are settled."""
    return drop_repeated(READERS[_format_of(path)](spark, path, schema))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array or a single object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; lines that do not parse are left out (see `split_jsonl`)."""
    return split_jsonl(spark, path, schema)[0]


def split_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines). Give a schema for large inputs: inferring it reads the file once more."""
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != CORRUPT])
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    good = parsed.filter(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    bad = parsed.filter(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))
    return good, bad


def _delimited(sep: str):
    def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        return df.toDF(*[c.strip() for c in df.columns])

    return read


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_txt(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines when at least one line is a JSON object, else the non-blank lines with their numbers."""
    if spark.read.text(path).filter(F.trim("value").startswith("{")).limit(1).count():
        return read_jsonl(spark, path, schema)
    return number_lines(spark, path).filter(F.trim("content") != "")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, content) of a text file, 1-based; in a folder every file is numbered for itself.

    Lines are numbered inside each split and shifted by the lines of the splits before,
    so a big file is never ordered in one task.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("m"),
    )
    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "split", "first", before.alias("before"))
    placed = lines.join(F.broadcast(starts), ["file", "split"])  # one row per split of a file
    return placed.select((F.col("m") - F.col("first") + F.col("before") + 1).alias("line_number"), F.trim("content").alias("content"))


READERS = {
    "json": read_json,
    "jsonl": read_jsonl,
    "csv": _delimited(","),
    "tsv": _delimited("\t"),
    "parquet": read_parquet,
    "txt": read_txt,
}


def drop_repeated(df: DataFrame) -> DataFrame:
    """Strips `.N` and `_mN` endings from column names; the first column of a name stays."""
    kept: dict[str, str] = {}
    for name in df.columns:
        kept.setdefault(re.sub(r"(\.\d+|_m\d+)$", "", name), name)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in kept.items()])


def combine(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """All readable files as one table with reconciled columns, and the paths that failed."""
    parts, failed = [], []
    for path in paths:
        try:
            parts.append(read_file(spark, path, schema))
        except (AnalysisException, ValueError):
            failed.append(path)
    if not parts:
        raise ValueError(f"no readable file among {list(paths)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, failed


def source_info(spark: SparkSession, path: str) -> DataFrame:
    """Format, size in MB and modification time per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path"),
        F.lit(_format_of(path)).alias("format"),
        (F.col("length") / (1024 * 1024)).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
    )


# Keys whose top-level value goes before the one inside `properties`.
PRIORITY_KEYS = ["distinct_id", "event_name", "insert_id", "device_id", "user_id", "time"]


def flatten_records(df: DataFrame) -> DataFrame:
    """Lifts the fields of the `properties` struct to columns.

    Priority keys prefer the top level, all other names prefer `properties`.
    """
    if "properties" not in df.columns:
        return df
    inner = [f.name for f in df.schema["properties"].dataType.fields]
    outer = [c for c in df.columns if c != "properties"]
    top, prop = (lambda c: F.col(f"`{c}`")), (lambda c: F.col(f"properties.`{c}`"))
    cols = []
    for name in [k for k in PRIORITY_KEYS if k in outer] + inner + outer:
        if name in [n for n, _ in cols]:
            continue
        if name in inner and name in outer:
            first, second = (top, prop) if name in PRIORITY_KEYS else (prop, top)
            cols.append((name, F.coalesce(first(name), second(name))))
        else:
            cols.append((name, top(name) if name in outer else prop(name)))
    return df.select(*[expr.alias(name) for name, expr in cols])
