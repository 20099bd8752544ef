"""Queries that write the sample tables in each file format or as saved tables and read them back."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import timefn as tf
from tidemark.functions.stage import stage_dir
from tidemark.inputs import interactions, raw
from tidemark.operators import cf
from tidemark.sources import files, tables


def place(spark, name):
    return f"{stage_dir(spark)}/tidemark/files-{uuid.uuid4().hex}/{name}"


def plain_events(spark, d):
    return raw(spark, d, "events").select("event_id", "user_id", "event_type", "value")


PLAIN = "SELECT event_id, user_id, event_type, value FROM events"


def _delimited(kind, sep):
    @query(f"source_{kind}", PLAIN)
    def run(spark, d):
        path = place(spark, f"events.{kind}")
        plain_events(spark, d).write.option("header", True).option("sep", sep).csv(path)
        return files.read_file(spark, path)


_delimited("csv", ",")
_delimited("tsv", "\t")


@query("source_parquet", PLAIN)
def _(spark, d):
    path = place(spark, "events.parquet")
    plain_events(spark, d).write.parquet(path)
    return files.read_file(spark, path)


def broken_lines(spark, d):
    """Events as JSON lines; every 50th line breaks off."""
    rows = plain_events(spark, d)
    line = F.to_json(F.struct(*rows.columns))
    path = place(spark, "events.jsonl")
    rows.select(F.when(F.col("event_id") % 50 == 7, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return path, rows.schema


@query("source_jsonl", f"{PLAIN} WHERE event_id % 50 <> 7")
def _(spark, d):
    path, schema = broken_lines(spark, d)
    return files.read_file(spark, path, schema)


@query("source_jsonl_rejects", "SELECT count(*) AS bad_lines FROM events WHERE event_id % 50 = 7")
def _(spark, d):
    path, schema = broken_lines(spark, d)
    return files.split_jsonl(spark, path, schema)[1].agg(F.count("line").alias("bad_lines"))


@query("source_combined", """SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type, CASE WHEN event_id % 2 = 1 THEN value END AS value,
  CAST(0 AS BIGINT) AS failed FROM events""")
def _(spark, d):
    rows = plain_events(spark, d)
    paths = [place(spark, "even.csv"), place(spark, "odd.parquet")]
    rows.filter("event_id % 2 = 0").drop("value").write.option("header", True).csv(paths[0])
    rows.filter("event_id % 2 = 1").drop("event_type").write.parquet(paths[1])
    out, failed = files.combine(spark, paths)
    return out.withColumn("failed", F.lit(len(failed)).cast("bigint"))


@query("saved_features", "SELECT user_id, item_id, count(*) * 2 AS n FROM interactions GROUP BY ALL")
def _(spark, d):
    root = place(spark, "store")
    counts = interactions(spark, d).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    tables.save_features(counts, root, "uses", "v1")
    tables.save_features(counts.withColumn("n", F.col("n") * 2), root, "uses", "v2")
    return tables.load_features(spark, root, "uses")


@query("saved_model", "SELECT user_id, item_id, count(*)::DOUBLE AS w FROM interactions WHERE item_id IS NOT NULL GROUP BY ALL")
def _(spark, d):
    root = place(spark, "store")
    weights = cf.interaction_weights(interactions(spark, d), "count")
    tables.save_model({"weights": weights, "popularity": cf.popularity(weights)}, root, "cf", "v1")
    return tables.load_model(spark, root, "cf")["weights"].select("user_id", "item_id", "w")


@query("saved_stage", PLAIN)
def _(spark, d):
    root = place(spark, "store")
    tables.save_stage(plain_events(spark, d), root, "interim", "events")
    return tables.load_stage(spark, root, "interim", "events")


ARRAY_ROWS = 1_000  # rows per JSON array or text file


@query("source_json_arrays", PLAIN)
def _(spark, d):
    rows = plain_events(spark, d)
    path = place(spark, "events.json")
    part = F.floor(F.col("event_id") / ARRAY_ROWS).alias("part")
    arrays = rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)  # a file per array
    return files.read_json(spark, path, rows.schema).select(*rows.columns)


@query("source_txt", f"""SELECT event_type AS content, row_number() OVER (PARTITION BY event_id // {ARRAY_ROWS} ORDER BY event_id) AS line_number
  FROM events QUALIFY event_id % 7 <> 3""")
def _(spark, d):
    path = place(spark, "events.txt")
    blank = F.when(F.col("event_id") % 7 == 3, F.lit(" ")).otherwise(F.col("event_type"))
    lines = plain_events(spark, d).select(F.floor(F.col("event_id") / ARRAY_ROWS).alias("part"), "event_id", blank.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return files.read_file(spark, path).select("line_number", "content")


def in_files(spark, d):
    """Events as a Parquet table of several files, in order of their ids."""
    path = place(spark, "events")
    plain_events(spark, d).repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path


@query("scan_batches", """SELECT event_id // 700 AS batch, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def _(spark, d):
    rows = tables.scan_batches(spark, in_files(spark, d), 700)
    sums = [F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 4).alias("total")]
    return rows.groupBy("batch").agg(*sums)


@query("scan_offset", f"SELECT * FROM ({PLAIN}) ORDER BY event_id LIMIT 250 OFFSET 450")
def _(spark, d):
    return tables.scan_offset(spark, in_files(spark, d), 450, 250)


@query("parsed_times", """SELECT event_id, CASE WHEN event_id % 6 IN (2, 4) THEN date_trunc('day', ts) WHEN event_id % 6 = 5 THEN NULL
  ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(spark, d):
    rows = raw(spark, d, "events").select("event_id", "ts")
    written = lambda layout: F.date_format("ts", layout)
    forms = [written("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_timestamp("ts").cast("string"), written("yyyy-MM-dd"), written("yyyy/MM/dd HH:mm:ss"), written("yyyy/MM/dd")]
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == i, form) for i, form in enumerate(forms)], F.lit("no time"))
    return rows.select("event_id", tf.parse_datetime(text).alias("parsed"))
