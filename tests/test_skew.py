"""Hot-key paths must give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.inputs import interactions, users
from tidemark.operators import sessions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bursts(spark):
    """User 1 holds most events in a few dense bursts, others have a handful."""
    rng = np.random.default_rng(3)
    times = np.concatenate([np.cumsum(rng.integers(1, 900, 1500)), np.cumsum(rng.integers(1, 9000, 300))])
    frame = pd.DataFrame(
        {
            "id": np.arange(1800),
            "user_id": np.concatenate([np.ones(1500, dtype=int), rng.integers(2, 30, 300)]),
            "event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(times, unit="s"),
            "event_name": rng.choice(["run_paraphrasing", "copy_sentence", "view"], 1800),
            "item_id": rng.integers(0, 9, 1800),
            "response_time_ms": rng.integers(1, 500, 1800),
            **{c: rng.choice(["a", "b", None], 1800) for c in ["device_id", "browser", "os", "tone", "maintenance"]},
        }
    )
    return spark.createDataFrame(frame).cache()


def test_hot_keys_are_bounded_and_found(bursts):
    assert skew.hot_keys(bursts, ["user_id"], min_rows=10_000) is None
    assert rows(skew.hot_keys(bursts, ["user_id"], min_rows=100)) == [(1,)]
    assert skew.hot_keys(bursts, ["user_id"], min_rows=0, max_keys=3).count() == 3


@pytest.mark.parametrize(
    "job",
    [
        lambda df, m: sessions.sessionise(df, min_hot_rows=m).drop("_slice"),
        lambda df, m: sessions.session_features(df, min_hot_rows=m).drop("_slice"),
        lambda df, m: sessions.session_grams(df, min_hot_rows=m),
        lambda df, m: sessions.frequent_sequences(df, max_length=4, min_hot_rows=m),
        lambda df, m: sessions.context_switches(df, as_of="2024-02-01 00:00:00", min_hot_rows=m),
    ],
)
def test_sliced_windows_equal_plain_windows(bursts, job):
    def rounded(df):
        doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
        df = df.withColumns({c: F.round(c, 6) for c in doubles})
        return rows(df.select(sorted(df.columns)))

    assert rounded(job(bursts, 100)) == rounded(job(bursts, None))


def test_gap_statistics_of_hot_user(bursts, spark):
    people = bursts.select("user_id").distinct()
    pick = lambda m: rows(
        sessions.gap_statistics(bursts, people, as_of="2024-02-01 00:00:00", min_hot_rows=m).select(
            "user_id", "gaps", F.round("avg_gap", 6), F.round("median_gap", 6), F.round("std_gap", 6)
        )
    )
    assert pick(100) == pick(None)


@pytest.mark.parametrize("accuracy", [20, 200])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 5000), "v": np.round(rng.lognormal(size=5000), 2)})
    probs = {"q25": 0.25, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q1": 1.0}
    df = spark.createDataFrame(frame)
    got = {r["k"]: r for r in skew.quantiles(df, ["k"], "v", probs, min_rows=1000, accuracy=accuracy).collect()}
    for k, part in frame.groupby("k"):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(part["v"], p)), (k, name)
    total = skew.quantiles(df, [], "v", {"m": 0.5}, min_rows=10).first()
    assert total["m"] == pytest.approx(np.median(frame["v"]))


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, x) for x in "aabbc"] + [(2, None), (2, "z")], "k int, v string")
    out = skew.modes(df, ["k"], {"m": F.col("v")}, distinct=["m"])
    assert rows(out.select("k", "m", "n_m")) == [(1, "a", 3), (2, "z", 1)]


def test_session_gap_rule(spark):
    times = ["00:00:00", "00:30:00", "01:00:01"]
    df = spark.createDataFrame([(i, 1, f"2024-01-01 {t}") for i, t in enumerate(times)], "id int, user_id int, t string")
    out = sessions.sessionise(df.select("id", "user_id", F.to_timestamp("t").alias("event_time")))
    assert [r["session_no"] for r in out.orderBy("id").collect()] == [0, 0, 1]


def test_null_values_count_as_changes(spark):
    tones = ["a", None, None, "b"]
    df = spark.createDataFrame(
        [(i, 1, f"2024-01-01 00:0{i}:00", t) for i, t in enumerate(tones)], "id int, user_id int, t string, tone string"
    )
    ev = df.select("id", "user_id", F.to_timestamp("t").alias("event_time"), "tone", *[F.lit("x").alias(c) for c in ("device_id", "browser", "os", "maintenance")])
    row = sessions.context_switches(ev, as_of="2024-01-02 00:00:00").first()
    assert (row["tone_switches"], row["device_switches"]) == (3, 0)


def test_sessions_partition_events(spark, sf):
    ev = interactions(spark, sf)
    feats = sessions.session_features(ev)
    assert feats.agg(F.sum("events")).first()[0] == ev.count()
    assert sessions.gap_statistics(ev, users(spark, sf)).count() >= users(spark, sf).count()
