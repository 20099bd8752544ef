"""Time-of-day lists: items out of use count by few of them, the lists are those of all cells."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import contextual as C

MOMENT = C.Moment("2024-01-31 10:00:00", "Windows 11")
K = 4


def tables(spark):
    rng = np.random.default_rng(5)
    # Few different values, and some that differ far behind the tenth decimal: ids decide there.
    scores = np.round(rng.integers(0, 9, 400) / 20, 2) + rng.integers(0, 2, 400) * 3e-11
    catalogue = [(int(i), float(s)) for i, s in enumerate(scores)]
    shares = lambda n: [float(x) for x in rng.integers(0, 5, n) + (np.arange(n) == 3)]
    users = [(u, shares(24), shares(7), int(rng.integers(0, 24))) for u in range(6)]
    items = [(i, shares(24), shares(7), 0) for i in (3, 50, 51, 200)]
    personal = [(0, 3, 0.3), (0, 77, 0.2), (1, 50, 0.5), (6, 120, 0.4)]
    recent = [(0, 3, 1.0), (2, 51, 0.7), (7, 300, 1.0)]
    shape = "{} long, hour_shares array<double>, weekday_shares array<double>, peak_hour int"
    return (
        spark.range(9).select(F.col("id").alias("user_id")),
        spark.createDataFrame(personal, "user_id long, item_id long, score double"),
        spark.createDataFrame(catalogue, "item_id long, score double"),
        spark.createDataFrame(recent, "user_id long, item_id long, score double"),
        spark.createDataFrame(users, shape.format("user_id")),
        spark.createDataFrame(items, shape.format("item_id")),
    )


def all_cells(users, personal, catalogue, recent, up, ip):
    """The lists of users with a pattern or score, from every (user, item) cell."""
    u = users.toPandas().merge(up.toPandas(), on="user_id", how="left")
    for name, df in (("base", personal), ("recent", recent)):
        packed = df.toPandas().groupby("user_id").agg(ids=("item_id", list), values=("score", list)).reset_index()
        u = u.merge(packed.rename(columns={"ids": f"{name}_ids", "values": f"{name}_values"}), on="user_id", how="left")
    i = catalogue.toPandas().merge(ip.toPandas(), on="item_id", how="left").sort_values("item_id").reset_index(drop=True)
    base, aff, use = C._cells(u, i, MOMENT.hour)
    unit = lambda x: np.where(np.ptp(x, axis=1, keepdims=True) == 0, 1.0, (x - x.min(1, keepdims=True)) / np.maximum(np.ptp(x, axis=1, keepdims=True), 1e-300))
    score = 0.3 * unit(base) + 0.4 * unit(aff) + 0.3 * use
    gap = C._peak_distance(u, MOMENT.hour)
    score *= np.where(gap <= 2, np.maximum(1.0, C.PEAK_BOOST * (1 - gap / 3)), 1.0)[:, None]
    order = np.argsort(-np.round(score, 10), axis=1, kind="stable")[:, :K]
    return pd.DataFrame({"user_id": np.repeat(u["user_id"], K), "item_id": order.ravel(), "score": np.take_along_axis(score, order, 1).ravel()})


def test_lists_equal_those_of_all_cells(spark):
    t = tables(spark)
    got = C.temporal_scores(*t, MOMENT, K).toPandas().sort_values(["user_id", "rank"])
    want = all_cells(*t)
    assert got["item_id"].tolist() == want["item_id"].tolist()
    np.testing.assert_allclose(got["score"], want["score"], atol=1e-9)


def test_few_items_out_of_use_take_part(spark):
    _, personal, catalogue, recent, _, ip = tables(spark)
    used = ip.select("item_id").union(personal.select("item_id")).union(recent.select("item_id"))
    telling = C._telling(catalogue, used, K)
    assert telling.count() <= used.distinct().count() + 3 * K + 1


def test_all_items_in_use(spark):
    _, _, catalogue, _, _, _ = tables(spark)
    assert C._telling(catalogue, catalogue, K).count() == catalogue.count()
