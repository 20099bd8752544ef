"""Streams against their batch twins on the same rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.inputs import interactions, load
from tidemark.operators import sessions as batch_sessions
from tidemark.streaming import jobs

LATE = "2030-01-01 00:00:00"


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Events in time order over several files, then one far later event that closes all windows."""
    path = str(tmp_path_factory.mktemp("events") / "data")
    ev = interactions(spark, sf).select("id", "user_id", "event_time", "insert_id")
    for start in (1, 9, 17, 25):
        day = F.dayofmonth("event_time")
        ev.filter((day >= start) & (day < start + 8)).coalesce(1).write.mode("append").parquet(path)
    end = spark.createDataFrame([(-1, -1, LATE, "end")], "id long, user_id long, t string, insert_id string")
    end.select("id", "user_id", F.to_timestamp("t").alias("event_time"), "insert_id").coalesce(1).write.mode("append").parquet(path)
    return path, ev.schema


def stream(spark, folder):
    return jobs.read_events(spark, folder[0], folder[1], files_per_batch=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ingest_drops_repeats(spark, folder, tmp_path):
    twice = stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got = jobs.run_once(jobs.unique_events(twice, "30 days"), "t_unique", checkpoint=str(tmp_path / "c"))
    want = spark.read.parquet(folder[0])
    assert rows(got.select("insert_id")) == rows(want.select("insert_id").distinct())


def test_sessions_equal_the_lag_rule(spark, folder, sf):
    got = jobs.run_once(jobs.sessions(stream(spark, folder)), "t_sessions").filter("user_id >= 0")
    ev = interactions(spark, sf).select("user_id", "id", "event_time")
    want = batch_sessions.sessionise(ev).groupBy("user_id", "session_no").agg(
        F.min("event_time"), F.max("event_time"), F.count(F.lit(1))
    ).drop("session_no")
    assert rows(got) == rows(want)


def test_active_users_are_close(spark, folder):
    got = {r["start"]: r["active_users"] for r in jobs.run_once(jobs.active_users(stream(spark, folder), "1 day", "12 hours"), "t_active").collect()}
    w = F.window("event_time", "1 day", "12 hours")
    want = spark.read.parquet(folder[0]).filter("user_id >= 0").groupBy(w).agg(F.count_distinct("user_id").alias("n")).collect()
    for r in want:
        assert abs(got[r["window"]["start"]] - r["n"]) <= max(1, 0.05 * r["n"])


def test_panel_equals_batch(spark, sf, tmp_path):
    log = load(spark, sf, "oplog").select("ts", "method", "status_code", "duration_s")
    path = str(tmp_path / "log")
    log.orderBy("ts").coalesce(1).write.parquet(path)
    late = spark.createDataFrame([(LATE, "END", 0, 0.0)], "t string, method string, status_code int, duration_s double")
    late.select(F.to_timestamp("t").alias("ts"), "method", "status_code", "duration_s").coalesce(1).write.mode("append").parquet(path)
    got = jobs.run_once(jobs.ops_panel(jobs.read_events(spark, path, log.schema, 1)), "t_panel").filter("method <> 'END'")
    want = log.groupBy(F.window("ts", "5 minutes")["start"], "method", "status_code").agg(
        F.count(F.lit(1)), F.count_if(F.col("status_code") >= 500), F.avg("duration_s")
    )
    assert rows(got) == rows(want)


def test_refresh_signals(spark, folder):
    got = jobs.run_once(jobs.refresh_signals(stream(spark, folder), clicks=2, hours=48), "t_refresh").filter("user_id >= 0")
    want = []
    for user, part in spark.read.parquet(folder[0]).filter("user_id >= 0").toPandas().groupby("user_id"):
        built, count = None, 0
        for at in part["event_time"].sort_values():
            if built is None:
                reason = "missing"
            elif at - built > pd.Timedelta(hours=48):
                reason = "old"
            else:
                count += 1
                reason = "clicks" if count >= 2 else None
            if reason:
                built, count = at, 0
                want.append((user, at, reason))
    # An expired layout reads as missing, a layout that is merely old as old: both ask for a rebuild.
    plain = lambda items: sorted((u, pd.Timestamp(t), "clicks" if r == "clicks" else "rebuild") for u, t, r in items)
    assert plain(rows(got)) == plain(want)


def test_file_sink_resumes(spark, folder, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for _ in range(2):
        jobs.run_to_parquet(jobs.unique_events(stream(spark, folder), "30 days"), out, ckpt)
    assert spark.read.parquet(out).count() == spark.read.parquet(folder[0]).count()


@pytest.mark.parametrize("width,slide", [("5 minutes", "5 minutes"), ("1 hour", "5 minutes"), ("24 hours", "1 hour")])
def test_panes_merge_to_exact_counts(spark, folder, tmp_path, width, slide):
    jobs.run_to_parquet(jobs.active_panes(stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "c"))
    panes = spark.read.parquet(str(tmp_path / "out"))
    got = rows(jobs.active_over(panes.filter("end < '2029-01-01'"), width, slide))
    w = F.window("event_time", width, slide)
    want = spark.read.parquet(folder[0]).filter("user_id >= 0").groupBy(w).agg(F.count_distinct("user_id").alias("n"))
    assert got == rows(want.select("window.start", "window.end", "n"))


def test_ingest_twice_adds_nothing(spark, folder, tmp_path):
    schema = folder[1]
    table = jobs.IngestTable(spark, str(tmp_path / "table"), schema, buckets=8)
    jobs.ingest(stream(spark, folder), table, str(tmp_path / "c"))
    whole = rows(table.read().drop("bucket").select("insert_id"))
    assert whole == rows(spark.read.parquet(folder[0]).select("insert_id").filter("insert_id is not null").distinct())
    batches = table.batches()
    assert len(batches) > 1
    jobs.ingest(stream(spark, folder), table, str(tmp_path / "c2"))  # lost progress: the same batches again
    assert table.batches() == batches and rows(table.read().select("insert_id")) == whole
    late = spark.read.parquet(folder[0]).limit(50)
    assert table.add(late, "late") and rows(table.read().select("insert_id")) == whole


def test_half_a_batch_is_never_seen(spark, folder, tmp_path):
    rows_now = spark.read.parquet(folder[0]).filter("insert_id is not null")
    table = jobs.IngestTable(spark, str(tmp_path / "table"), folder[1], buckets=4)
    # What a writer that died has left: data without a log entry.
    rows_now.limit(30).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/table/data/batch=a")
    assert table.read().count() == 0
    assert table.add(rows_now, "a") and not table.add(rows_now, "a")
    assert rows(table.read().select("insert_id")) == rows(rows_now.select("insert_id").distinct())
