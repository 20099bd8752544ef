"""Pairwise kernels and quotas against brute force, with hot paths forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cf, cooccurrence, oplog


@pytest.fixture(scope="module")
def weights(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"user_id": rng.integers(0, 60, 900), "item_id": rng.integers(0, 40, 900)}).drop_duplicates()
    frame["w"] = np.round(rng.uniform(0.1, 3, len(frame)), 3)
    return frame, spark.createDataFrame(frame).cache()


def dense(frame):
    return frame.pivot(index="user_id", columns="item_id", values="w").fillna(0.0)


def by_metric(metric, x, y):
    both = (x != 0) & (y != 0)
    if metric == "cosine":
        return x @ y / np.sqrt((x @ x) * (y @ y))
    if metric == "jaccard":
        return both.sum() / ((x != 0) | (y != 0)).sum()
    if metric == "euclidean":
        return np.exp(-np.linalg.norm(x - y))
    if both.sum() < 2 or np.std(x[both]) == 0 or np.std(y[both]) == 0:
        return 0.0
    return np.corrcoef(x[both], y[both])[0, 1]


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "pearson", "euclidean"])
@pytest.mark.parametrize("dense_items", [1, 1500])
def test_item_similarity(weights, metric, dense_items, monkeypatch):
    monkeypatch.setattr(cf, "DENSE_ITEMS", dense_items)
    monkeypatch.setattr(cf, "RUN_ROWS", 50)
    monkeypatch.setattr(cf, "PAIR_BUDGET", 100)
    frame, df = weights
    m = dense(frame)
    got = {(r["item_a"], r["item_b"]): r for r in cf.item_similarity(df, metric).collect()}
    for i, a in enumerate(m.columns):
        for b in m.columns[i + 1 :]:
            common = int(((m[a] != 0) & (m[b] != 0)).sum())
            assert ((a, b) in got) == (common > 0)
            if common:
                assert got[a, b]["common"] == common
                assert got[a, b]["sim"] == pytest.approx(by_metric(metric, m[a].to_numpy(), m[b].to_numpy()), abs=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "jaccard", "pearson", "euclidean"])
@pytest.mark.parametrize("tile", [7, 2048])
def test_user_neighbours(weights, metric, tile, monkeypatch):
    monkeypatch.setattr(cf, "USER_TILE", tile)
    frame, df = weights
    m = dense(frame)
    got = cf.user_neighbours(df, 5, metric=metric).toPandas()
    for u in m.index:
        sims = [(-round(by_metric(metric, m.loc[u].to_numpy(), m.loc[v].to_numpy()), 9), v) for v in m.index if v != u]
        want = [(v, -s) for s, v in sorted(sims)[:5] if -s > 0]
        mine = got[got["user_id"] == u].sort_values("rank")
        assert [round(s, 6) for s in mine["sim"]] == [round(s, 6) for _, s in want]


def test_symmetry_and_diagonal(weights):
    _, df = weights
    both = cf.mirrored(cf.item_similarity(df), df)
    flipped = both.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), F.round("sim", 9).alias("sim"))
    assert both.select("item_a", "item_b", F.round("sim", 9).alias("sim")).exceptAll(flipped).count() == 0
    assert both.filter("item_a = item_b AND sim <> 1.0").count() == 0


@pytest.mark.parametrize("hot", [None, 20])
@pytest.mark.parametrize("budget", [50, 2_000_000])
def test_cooccurrence(spark, hot, budget, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PAIR_BUDGET", budget)
    monkeypatch.setattr(cooccurrence, "RUN_ROWS", 40)
    monkeypatch.setattr(cooccurrence, "HOT_CHUNKS", 3)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(
        {
            "user_id": np.where(rng.random(300) < 0.5, 1, rng.integers(2, 9, 300)),
            "item_id": rng.integers(0, 6, 300),
            "event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 * 86400, 300) // 3600 * 3600, unit="s"),
        }
    )
    want = {}
    for _, g in frame.groupby("user_id"):
        for t, a in zip(g["event_time"], g["item_id"]):
            for s, b in zip(g["event_time"], g["item_id"]):
                if a != b and abs(s - t) <= pd.Timedelta(hours=24):
                    want[a, b] = want.get((a, b), 0) + 1
    got = cooccurrence.item_cooccurrence(spark.createDataFrame(frame), min_hot_rows=hot)
    assert {(r["item_a"], r["item_b"]): r["n"] for r in got.collect()} == want
    assert got.agg(F.max("score")).first()[0] == 1.0


def test_quota_audit_of_hot_clients(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(
        {
            "client_key": np.where(rng.random(600) < 0.6, "a", rng.choice(["b", "c"], 600)),
            "id": np.arange(600),
            "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 9000, 600), unit="s"),
        }
    )
    df = spark.createDataFrame(frame)
    rows = lambda m: sorted(map(tuple, oplog.quota_violations(df, 3, 90, min_hot_rows=m).collect()))
    assert rows(100) == rows(None)
    for _, i, minute, hour in rows(None)[:20]:
        me = frame.loc[i]
        mine = frame[(frame["client_key"] == me["client_key"]) & (frame["ts"] <= me["ts"])]
        assert minute == (mine["ts"] >= me["ts"] - pd.Timedelta(seconds=60)).sum()
        assert hour == (mine["ts"] >= me["ts"] - pd.Timedelta(hours=1)).sum()
