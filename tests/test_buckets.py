"""Bucketed upserts, scans by row offset and recommendations by a scorer of one's own."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import custom
from tidemark.sources import files, tables
from tidemark.sources.buckets import BucketTable

COLUMNS = "k bigint, id bigint, name string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folders(root):
    return {(f, b) for f in os.listdir(root / "data") for b in os.listdir(root / "data" / f) if b.startswith("bucket=")}


@pytest.fixture()
def table(spark, tmp_path):
    schema = spark.createDataFrame([], COLUMNS).schema
    return BucketTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=8)


def test_upserts_equal_a_plain_table(spark, table):
    draw = random.Random(5)
    held = {}
    assert table.read().count() == 0 and table.versions() == []
    for step in range(4):
        new = [(draw.choice([None, *range(30)]), 100 * step + i, f"n{step}", i) for i in range(25)]
        for k, (i, name, n) in {k: rest for k, *rest in new}.items():  # the last row of a key has its largest n
            held[k] = (held[k][0] if k in held else i, name, n)
        assert table.upsert(spark.createDataFrame(new, COLUMNS), newest=["n"]) == step + 1
        assert rows(table.read()) == sorted([(k, *rest) for k, rest in held.items()], key=repr)


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    table.upsert(spark.range(200).select(F.col("id").alias("k"), "id", F.lit("a").alias("name"), F.lit(1).alias("n")))
    before = folders(tmp_path / "t")
    assert len(before) == 8
    table.upsert(spark.createDataFrame([(7, "b")], "k int, name string"))
    assert len(folders(tmp_path / "t") - before) == 1
    assert rows(table.read().filter("k = 7")) == [(7, 7, "b", 1)] and table.read().count() == 200
    assert rows(table.read(1).filter("k = 7")) == [(7, 7, "a", 1)]
    assert table.upsert(spark.createDataFrame([], COLUMNS)) == 2
    assert table.expire(1) == 0  # the first folder still holds seven buckets
    assert table.versions() == [2] and table.read().count() == 200


def test_a_failed_commit_leaves_the_old_version(spark, table):
    table.upsert(spark.createDataFrame([(1, 1, "a", 1)], COLUMNS))
    broken = spark.createDataFrame([(1, 1, "x", 1)], COLUMNS).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert rows(table.read()) == [(1, 1, "a", 1)]
    kept = table.versions
    table.versions = lambda: []  # as a run sees it that began before the first version
    with pytest.raises(RuntimeError, match="another run"):
        table.upsert(spark.createDataFrame([(1, 1, "y", 1)], COLUMNS))
    table.versions = kept
    assert table.versions() == [1] and rows(table.read()) == [(1, 1, "a", 1)]


def test_pages_read_only_their_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    page = tables.scan_offset(spark, path, 130, 40)
    assert [r[0] for r in page.orderBy("id").collect()] == list(range(130, 170))
    assert len(page.inputFiles()) <= 3 < len(spark.read.parquet(path).inputFiles())
    assert tables.scan_offset(spark, path, 990, 40).count() == 10 and tables.scan_offset(spark, path, 1000, 5).count() == 0
    sizes = {r["batch"]: r["count"] for r in tables.scan_batches(spark, path, 130).groupBy("batch").count().collect()}
    assert sizes == {**dict.fromkeys(range(7), 130), 7: 90}


def test_lines_are_numbered_per_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(f"{name}1\n\n{name}3\n")
    assert rows(files.number_lines(spark, str(tmp_path)).filter("content <> ''")) == [(1, "a1"), (1, "b1"), (3, "a3"), (3, "b3")]


ITEMS = "item_id bigint, item_code string, item_name string, category string, item_type string, is_premium boolean"


def test_scorers(spark):
    weights = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 11, 1.0)], "user_id bigint, item_id bigint, w double")
    items = spark.createDataFrame([(i, f"c{i}", f"item {i}", "x", "t", False) for i in range(10, 15)], ITEMS)
    everything = [(u, i, s) for u in (1, 2, 3) for i, s in ((10, 0.9), (11, 0.8), (12, 0.5), (13, 0.7), (14, None), (99, 1.0))]

    def fixed(weights, items, context):
        found = spark.createDataFrame(everything, "user_id bigint, item_id bigint, score double")
        return found.withColumn("score", F.col("score") * context.get("factor", 1.0))

    got = custom.recommend(fixed, weights, items, {"factor": 0.5}, k=2)
    assert rows(got.select("user_id", "item_id", "score", "rank")) == [(1, 12, 0.25, 2), (1, 13, 0.35, 1), (2, 10, 0.45, 1), (2, 13, 0.35, 2)]
    assert "reason" in got.columns
    one = custom.recommend(fixed, weights, items, users=spark.createDataFrame([(2,)], "user_id bigint"), exclude=items.filter("item_id = 10"), min_score=0.6)
    assert rows(one.select("user_id", "item_id", "rank")) == [(2, 13, 1)]
    both = custom.blend_of({"a": fixed, "b": fixed}, {"a": 0.25, "b": 0.75})
    best = custom.recommend(both, weights, items, k=1)
    assert {r["user_id"]: r["item_id"] for r in best.collect()} == {1: 13, 2: 10}
    with pytest.raises(ValueError, match="score"):
        custom.recommend(lambda w, i, c: w, weights, items)
