"""Null names, null keys that hold many rows, repeated keys and long lists."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.operators import activity, cleaning, rerank, rulebook, sessions
from tidemark.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    """Most events have no user; some have no name, item or tone."""
    rng = np.random.default_rng(5)
    n = 900
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "user_id": [None if x < 6 else int(x) for x in rng.integers(0, 9, n)],
            "event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 900, n)), unit="s"),
            "event_name": rng.choice(["run_paraphrasing", "copy_sentence", None], n),
            "item_id": [None if x == 0 else int(x) for x in rng.integers(0, 5, n)],
            "response_time_ms": rng.integers(1, 500, n),
            **{c: rng.choice(["a", "b", None], n) for c in ["device_id", "browser", "os", "tone", "maintenance"]},
        }
    )
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else int(v) if isinstance(v, (float, int)) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in frame.astype(object).itertuples(index=False)],
        "id long, user_id long, event_time timestamp, event_name string, item_id long, response_time_ms long, device_id string, "
        "browser string, os string, tone string, maintenance string",
    )
    return df.cache()


def rounded(df):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    df = df.drop("_slice").withColumns({c: F.round(c, 6) for c in doubles})
    return rows(df.select(sorted(df.columns)))


@pytest.mark.parametrize("job", [sessions.sessionise, sessions.session_features, sessions.session_grams])
def test_events_without_user_are_sliced_like_any_hot_user(events, job):
    hot = skew.slice_hot(events, ["user_id"], "event_time", min_rows=100)
    assert hot.filter("user_id is null").select("_slice").distinct().count() > 10
    assert rounded(job(events, min_hot_rows=100)) == rounded(job(events))


def test_quantiles_of_a_hot_null_label(spark, events):
    got = skew.quantiles(events, ["tone"], "response_time_ms", {"m": 0.5, "q": 0.95}, min_rows=100)
    assert rounded(got) == rounded(skew.quantiles(events, ["tone"], "response_time_ms", {"m": 0.5, "q": 0.95}))


def test_events_without_name_count_in_totals_only(spark, events):
    items = spark.createDataFrame([(1, "one", "c"), (2, "two", "c")], "item_id long, item_name string, category string")
    features = spark.createDataFrame([(1, 1.0, 1.0)], "item_id long, popularity_score double, trending_score double")
    for r in activity.item_statistics(events, items, features, "2024-02-01 00:00:00").collect():
        mine = events.filter(F.col("item_id") == r["item_id"])
        assert r["events"] == mine.count() and sum(r["distribution"].values()) == mine.filter("event_name is not null").count()
    users = spark.createDataFrame([(7, "u-7", "KR", "x")], "user_id long, distinct_id string, country_code string, account_type string")
    assert None not in activity.user_statistics(events, users).first()["distribution"]


def test_events_without_insert_id_all_stay(spark):
    data = [("u", None, 1), ("u", None, 1), ("u", "a", 2), ("v", "a", 1), (None, "b", 3)]
    df = spark.createDataFrame(data, "distinct_id string, insert_id string, t long").withColumn("event_time", F.timestamp_seconds("t")).drop("t")
    got = sorted((r["distinct_id"], r["insert_id"]) for r in cleaning.usable_events(df).fillna("-", ["insert_id"]).collect())
    assert got == [("u", "-"), ("u", "-"), ("v", "a")]


def test_upsert_keeps_the_newest_row_of_a_key(spark):
    old = spark.createDataFrame([(1, 10, "a", 0), (None, 11, "n", 0)], "k int, id int, v string, at int")
    new = spark.createDataFrame([(1, 99, "B", 2), (1, 98, "C", 3), (1, 97, "D", 1), (None, 5, "N", 1), (2, 20, "x", 1), (2, 21, "y", 1)], old.schema)
    assert rows(tables.upsert(old, new, ["k"], newest=["at"])) == rows(
        spark.createDataFrame([(1, 10, "C", 3), (None, 11, "N", 1), (2, 21, "y", 1)], old.schema)
    )


def test_lists_are_reranked_whole(spark):
    cands = spark.range(3005).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"), (1.0 / (F.col("id") + 1)).alias("score"))
    cands = cands.withColumns({"category": F.concat(F.lit("c"), F.col("item_id") % 7), "embedding": F.lit(None).cast("array<float>")})
    packed = rerank.pack(cands, "category", "embedding")
    assert rerank.rerank(packed, "category_gap").count() == 3005
    assert rerank.rerank(packed, "category_gap", limit=10).count() == 10


def plain_score(a, b):
    def match(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        return 200.0 * table[-1][-1] / (len(x) + len(y)) if x or y else 0.0

    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both = " ".join(sorted(wa & wb))
    if both and (wa <= wb or wb <= wa):
        return 100.0
    left, right = (f"{both} {' '.join(sorted(w - (wa & wb)))}".strip() for w in (wa, wb))
    return max(match(left, right), *((match(both, left), match(both, right)) if both else (0.0, 0.0)))


def test_rule_text_score(spark):
    rng = random.Random(2)
    words = ["keep", "it", "short", "and", "clear", "text", "simple", "Keep", "formal", "tone"]
    pairs = [("keep it short and clear", "keep text short and simple"), ("a b", "b a c"), ("", "x"), ("abc", "xyz"), ("same", "same")]
    pairs += [(" ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=rng.randint(1, 6)))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", rulebook.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_score(a, b), abs=1e-9), (a, b)
    assert got[0] > 75 and got[1] == 100
