"""Queries that run the streaming jobs over the event files that are there now."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.activity import stamp
from tidemark.catalog.features import SESSIONS
from tidemark.catalog.registry import query
from tidemark.functions.stage import stage_dir
from tidemark.inputs import INTERACTION_COLUMNS, VIEWS
from tidemark.streaming import jobs


def source(spark, d):
    """The events file as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def events(spark, d):
    return source(spark, d).selectExpr(*_columns(INTERACTION_COLUMNS))


def _columns(text):
    """Splits a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def folder(spark, label):
    return f"{stage_dir(spark)}/tidemark/stream-{label}-{uuid.uuid4().hex}"


def appended(stream, spark, label):
    path = folder(spark, label)
    jobs.run_to_parquet(stream, f"{path}/out", f"{path}/progress")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_unique_events", "SELECT id, insert_id FROM interactions")
def _(spark, d):
    twice = events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return appended(jobs.unique_events(twice), spark, "unique").select("id", "insert_id")


@query("stream_sessions", f"""WITH {SESSIONS} SELECT user_id, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS events FROM ev GROUP BY user_id, session_no""")
def _(spark, d):
    out = jobs.run_complete(jobs.sessions(events(spark, d)), folder(spark, "sessions"))
    return out.withColumns({c: stamp(c) for c in ("session_start", "session_end")})


@query("stream_ops_panel", """SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS window_start, method, status_code, count(*) AS n,
  count(*) FILTER (WHERE status_code >= 500) AS errors, round(avg(duration_s), 6) AS mean_duration_s FROM oplog GROUP BY ALL""")
def _(spark, d):
    select = VIEWS["oplog"].strip().removeprefix("SELECT").rsplit("FROM", 1)[0]
    log = source(spark, d).selectExpr(*_columns(select))
    out = jobs.run_complete(jobs.ops_panel(log), folder(spark, "panel"))
    return out.withColumns({"window_start": stamp("window_start"), "mean_duration_s": F.round("mean_duration_s", 6)})


@query("stream_active_users")
def _(spark, d):
    out = jobs.run_complete(jobs.active_users(events(spark, d), "24 hours", "1 hour"), folder(spark, "active"))
    return out.withColumns({"start": stamp("start"), "end": stamp("end")})


@query("stream_refresh_signals")
def _(spark, d):
    return appended(jobs.refresh_signals(events(spark, d)), spark, "refresh").withColumn("at", stamp("at"))


CLOSED = "event_time < (SELECT time_bucket(INTERVAL 5 MINUTES, max(event_time) - INTERVAL 10 MINUTES) FROM interactions)"


def _active(name, width, slide, steps):
    # Only panes that the watermark has closed are in; every event belongs to `steps` windows.
    minutes = {"5 minutes": 5, "1 hour": 60}[slide]

    @query(f"stream_active_users_{name}", f"""WITH ev AS (SELECT user_id, time_bucket(INTERVAL {minutes} MINUTES, event_time) AS b
  FROM interactions WHERE {CLOSED} AND user_id IS NOT NULL),
w AS (SELECT user_id, b - CAST(s AS INT) * INTERVAL {minutes} MINUTES AS start FROM ev, range({steps}) AS k(s))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(start + INTERVAL {steps * minutes} MINUTES, '%Y-%m-%d %H:%M:%S') AS "end",
  count(DISTINCT user_id) AS active_users FROM w GROUP BY start""")
    def run(spark, d):
        out = jobs.active_over(appended(jobs.active_panes(events(spark, d)), spark, "panes"), width, slide)
        return out.withColumns({"start": stamp("start"), "end": stamp("end")})


_active("5m", "5 minutes", "5 minutes", 1)
_active("1h", "1 hour", "5 minutes", 12)
_active("24h", "24 hours", "1 hour", 24)


@query("stream_ingest", "SELECT id, insert_id, user_id FROM interactions WHERE insert_id IS NOT NULL")
def _(spark, d):
    rows = events(spark, d).select("id", "insert_id", "user_id", "event_time")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    path = folder(spark, "ingest")
    table = jobs.IngestTable(spark, f"{path}/table", rows.schema)
    jobs.ingest(twice, table, f"{path}/progress")
    jobs.ingest(rows, table, f"{path}/again", source="again")  # all of it comes once more, as late as can be
    return table.read().select("id", "insert_id", "user_id")
