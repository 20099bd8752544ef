"""Structured Streaming forms of the incremental computations; each equals its batch twin on the same data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import types as T

from tidemark.sources.tables import first_per_key


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def unique_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Idempotent ingest: one event per insert_id within the watermark delay."""
    valid = events.filter(F.col("insert_id").isNotNull() & F.col("event_time").isNotNull())
    return valid.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["insert_id"])


def active_users(events: DataFrame, width: str, slide: str, delay: str = "10 minutes", error: float = 0.01) -> DataFrame:
    """Approximate distinct users per sliding window (exact distinct counts do not exist on streams)."""
    w = F.window("event_time", width, slide)
    return (
        events.withWatermark("event_time", delay)
        .groupBy(w)
        .agg(F.approx_count_distinct("user_id", error).alias("active_users"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "active_users")
    )


def active_panes(events: DataFrame, pane: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed panes of an exact distinct count: per pane and block of user ids one bitmap, which later panes can be merged with.

    State of a pane ends with the watermark; users without id do not count.
    """
    user = F.col("user_id").cast("long")
    return (
        events.filter(F.col("user_id").isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", pane), F.bitmap_bucket_number(user).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "block", "users")
    )


def active_over(panes: DataFrame, width: str, slide: str) -> DataFrame:
    """Exact distinct users per window of `width`, from panes; both lengths are multiples of the panes'."""
    merged = panes.groupBy(F.window("start", width, slide), "block").agg(F.bitmap_or_agg("users").alias("users"))
    counts = merged.groupBy("window").agg(F.sum(F.bitmap_count("users")).alias("active_users"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "active_users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed sessions per user; a gap of exactly `gap` still belongs to the session."""
    w = F.session_window("event_time", gap)
    return (
        events.withWatermark("event_time", delay)
        .groupBy("user_id", w)
        .agg(F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), F.count(F.lit(1)).alias("events"))
        .drop("session_window")
    )


REFRESH_SCHEMA = "user_id long, at timestamp, reason string"
REFRESH_STATE = "built timestamp, clicks long"


def refresh_signals(events: DataFrame, clicks: int = 5, hours: int = 6, delay: str = "10 minutes") -> DataFrame:
    """Signals to rebuild a user's layout: at the first event, after `clicks` further events, or
    at the first event more than `hours` after the last build.

    State per user is one time and one count; it expires with the layout's age. Each batch
    streams through in Arrow chunks that are put in time order per chunk.
    """
    age = pd.Timedelta(hours=hours)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        built, count = state.get if state.exists else (None, 0)
        built = pd.Timestamp(built) if built is not None else None
        out = []
        # The group's rows of one trigger can come in several chunks; times decide, not the chunks.
        times = pd.concat([c["event_time"] for c in chunks]).sort_values()
        for at in times:
            if built is None:
                reason = "missing"
            elif at - built > age:
                reason = "old"
            else:
                count += 1
                reason = "clicks" if count >= clicks else None
            if reason:
                built, count = at, 0
                out.append((key[0], at, reason))
        state.update((built.to_pydatetime(), count))
        expiry = int((built + age).timestamp() * 1000)
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "at", "reason"])

    keyed = events.select("user_id", "event_time").withWatermark("event_time", delay).groupBy("user_id")
    return keyed.applyInPandasWithState(step, REFRESH_SCHEMA, REFRESH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ops_panel(log: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean duration per closed window, method and status."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "method", "status_code")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.avg("duration_s").alias("mean_duration_s"))
        .select(F.col("window.start").alias("window_start"), "method", "status_code", "n", "errors", "mean_duration_s")
    )


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into an in-memory table (tests, small results)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly-once file sink over what is there now; progress is kept in `checkpoint`."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def run_complete(stream: DataFrame, path: str) -> DataFrame:
    """All windows of an aggregate, open ones included, over what is there now.

    Each trigger writes the full result to its own folder; the last one is returned.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{max(done)}")


# --- ingest that may run again -------------------------------------------------------------


class IngestTable:
    """Events under `root`, one folder per batch and bucket of the key, with a log of the batches that are in.

    A batch counts from the moment its log entry exists, so readers never see half of one, and a batch that runs
    again is skipped or written over. A key that any earlier batch holds is not added, however late it comes: only the buckets
    that the batch touches are read for that.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "insert_id", order: tuple[str, ...] = ("event_time", "id"), buckets: int = 64):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        self.schema = schema

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[str]:
        """Names of the batches that are in."""
        fs, path = self._fs("log")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self) -> DataFrame:
        """All events that are in, with their bucket."""
        layout = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
        known = self.batches()
        if not known:
            return self.spark.createDataFrame([], layout).drop("batch")
        return self.spark.read.schema(layout).parquet(f"{self.root}/data").filter(F.col("batch").isin(known)).drop("batch")

    def add(self, rows: DataFrame, name: str) -> bool:
        """Adds the rows whose key is new as batch `name`, one per key, the first in `order`; False if the batch is in already.

        Rows without key are left out.
        """
        if name in self.batches():
            return False
        fields = [f.name for f in self.schema.fields]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = first_per_key(rows.select(*fields).filter(F.col(self.key).isNotNull()), self.key, list(self.order)).withColumn("bucket", bucket)
        fresh = fresh.persist(StorageLevel.DISK_ONLY)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        there = self.read().filter(F.col("bucket").isin(touched)).select("bucket", self.key)
        new = fresh.join(there, ["bucket", self.key], "left_anti").select(*fields, "bucket")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={name}")
        fresh.unpersist()
        fs, path = self._fs(f"log/{name}")
        fs.create(path, True).close()
        return True


def ingest(stream: DataFrame, table: IngestTable, checkpoint: str, source: str = "s") -> None:
    """Adds what is there now to the table, batch by batch; `source` names the stream in the batch log."""

    def write(batch: DataFrame, number: int) -> None:
        table.add(batch, f"{source}-{number:09d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
