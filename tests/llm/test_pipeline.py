import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_module
import corpus_pipeline
from check_queries import TABLES, compare
from util import least_reachable
from tidemark.llm import catalog, langid, nearcopies, pieces

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


def test_all_operators_are_registered():
    own = sorted(n for n in QUERIES if n.startswith("op") and n[2].isdigit())
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    text, ok, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert ok, text


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(-1, None, "en", "src1", None), (-2, "1234 !!", "en", "src1", 7), (-3, None, None, None, None)]
    copy = docs.filter("doc_id = 3").withColumn("doc_id", F.lit(100_003).cast("bigint"))
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(copy).cache()
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language"](spark, given, sf).cache()
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(given).collect()}
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {i for i, (lang, s) in langs.items() if lang != "und" and s >= 0.01}
    assert one.columns == docs.columns and one.filter("doc_id < 0").count() == 0
    two = steps["near_copies"](spark, one, sf).cache()
    sets = {r["doc_id"]: set(nearcopies.shingle_set((r["text"] or "").encode()).tolist()) for r in one.select("doc_id", "text").collect()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    groups = least_reachable(sorted(sets), alike)
    assert {r["doc_id"] for r in two.select("doc_id").collect()} == set(groups.values()) and groups[100_003] == groups[3]
    three = steps["secret_scan"](spark, two, sf).cache()
    assert three.count() == two.count() and three.columns == docs.columns
    assert three.filter(F.col("n_chars") != F.length("text")).count() == 0
    four = steps["mix"](spark, three, sf).cache()
    assert four.columns == docs.columns and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    five = steps["encode"](spark, four, sf)
    texts = {r["doc_id"]: r["text"] for r in four.select("doc_id", "text").collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(five).collect()}
    assert back == {i: t.replace(pieces.SPACE, " ") for i, t in texts.items()} and five.count() == four.count()


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
