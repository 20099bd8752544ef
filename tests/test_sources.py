"""Files, snapshots, upserts and whole file-to-table runs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import etl
from tidemark.sources import files, tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "p"}, {"x": 2, "y": "q"}]))
    (tmp_path / "one.json").write_text(json.dumps({"x": 3, "y": "r"}))
    (tmp_path / "b.jsonl").write_text('{"x": 1, "z": true}\n\nnot json\n{"x": 2, "z": false}\n')
    (tmp_path / "c.csv").write_text(" x ,y\n1,a\n2,b\n")
    (tmp_path / "d.tsv").write_text("x\ty\n5\tc\n")
    (tmp_path / "e.txt").write_text("first\n\nthird\n")
    (tmp_path / "f.txt").write_text('{"x": 9}\n')
    return tmp_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_readers(spark, folder):
    read = lambda n: files.read_file(spark, str(folder / n))
    assert rows(read("a.json")) == [(1, "p"), (2, "q")]
    assert rows(read("one.json")) == [(3, "r")]
    assert rows(read("b.jsonl")) == [(1, True), (2, False)]
    assert rows(files.split_jsonl(spark, str(folder / "b.jsonl"))[1]) == [("not json",)]
    assert read("c.csv").columns == ["x", "y"] and rows(read("c.csv")) == [(1, "a"), (2, "b")]
    assert rows(read("d.tsv")) == [(5, "c")]
    assert rows(read("e.txt")) == [(1, "first"), (3, "third")]
    assert rows(read("f.txt")) == [(9,)]
    read("c.csv").write.parquet(str(folder / "g.parquet"))
    assert rows(read("g.parquet")) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        read("x.exe")


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        numbered = files.number_lines(spark, str(path))
        assert numbered.filter(F.col("content") != F.concat(F.lit("line "), F.col("line_number").cast("string"))).count() == 0
        assert numbered.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_combine_skips_bad_files(spark, folder):
    df, failed = files.combine(spark, [str(folder / n) for n in ("a.json", "c.csv", "none.csv", "x.exe")])
    assert df.count() == 4 and len(failed) == 2
    assert files.source_info(spark, str(folder / "c.csv")).select("format").first()[0] == "csv"


def test_flatten_prefers_top_level_keys(spark):
    df = spark.createDataFrame([("a", "t", ("b", "tone", "in"), "out")], "distinct_id string, time string, properties struct<distinct_id: string, tone: string, extra: string>, extra string")
    assert files.flatten_records(df).first().asDict() == {"distinct_id": "a", "time": "t", "tone": "tone", "extra": "in"}


def test_repeated_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["x", "x.1", "y_m7"])
    assert files.drop_repeated(df).first().asDict() == {"x": 1, "y": 3}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, id int, v string")
    new = spark.createDataFrame([(2, 99, "B"), (3, 30, "c")], "k int, id int, v string")
    assert rows(tables.upsert(old, new, ["k"])) == [(1, 10, "a"), (2, 20, "B"), (3, 30, "c")]
    assert rows(tables.upsert(old, new.select("k"), ["k"])) == [(1, 10, "a"), (2, 20, "b"), (3, None, None)]


def test_repeats_keep_the_earliest(spark):
    df = spark.createDataFrame([("i", 2, "late"), ("i", 1, "early"), ("j", 3, "x")], "insert_id string, t int, v string")
    none = df.filter("false")
    assert rows(tables.rows_to_insert(df, none, "insert_id", ["t"]).select("insert_id", "v")) == [("i", "early"), ("j", "x")]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    for v in ("v1", "v2"):
        tables.save_features(spark.range(3 if v == "v1" else 5), root, "users", v)
        tables.save_model({"weights": spark.range(2), "popularity": spark.range(7)}, root, "cf", v)
    assert tables.list_versions(spark, f"{root}/features/users") == ["v2", "v1"]
    assert tables.load_features(spark, root, "users").count() == 5
    assert tables.load_features(spark, root, "users", "v1").count() == 3
    assert tables.load_model(spark, root, "cf")["popularity"].count() == 7
    tables.save_stage(spark.range(4), root, "raw", "events")
    assert tables.load_stage(spark, root, "raw", "events").count() == 4
    with pytest.raises(ValueError):
        tables.save_stage(spark.range(1), root, "other", "x")


def test_append_by_date(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, "2024-01-02 05:00:00")], "id int, t string").withColumn("event_time", F.to_timestamp("t"))
    tables.append(df, str(tmp_path / "t"), "event_time")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter(tables.partition_filter("dt", "2024-01-03 00:00:00", 1)).count() == 1


def test_runs_from_files(spark, tmp_path):
    users = [{"distinct_id": f"u{i}", "is_logged_in": "true"} for i in range(3)]
    events = [{"event_name": "run_x", "distinct_id": f"u{i % 4}", "insert_id": f"i{i % 5}", "time": 1704110400 + i, "properties": {"tone": "normal"}} for i in range(8)]
    for name, data in (("users", users), ("events", events)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, data)))
    keys = lambda df: df.select("distinct_id", F.substring("distinct_id", 2, 9).cast("long").alias("user_id"))
    no_users = spark.createDataFrame([], "distinct_id string")
    no_events = spark.createDataFrame([("i0",)], "insert_id string")
    u, e = etl.run_files(spark, [str(tmp_path / "users.jsonl")], [str(tmp_path / "events.jsonl")], keys, no_users, no_events)
    assert u.ok and u.rows.count() == 3 and u.rows.first()["is_logged_in"] is True
    # i0 exists already, i3 belongs to an unknown user.
    assert sorted(r["insert_id"] for r in e.rows.collect()) == ["i1", "i2", "i4"]
    assert [r["step"] for r in e.log(spark).collect()] == ["extract", "validate", "transform", "quality", "load"]


def test_invalid_records_stop_the_run(spark):
    raw = spark.createDataFrame([("a", "u", 1.0), (None, "u", 2.0)], "event_name string, distinct_id string, time double")
    run = etl.run_events(raw, spark.createDataFrame([], "user_id long, distinct_id string"), spark.createDataFrame([], "insert_id string"))
    assert not run.ok and run.rows is None and run.errors.count() == 1
