"""Shares of neighbours and similar items, added up in blocks, against plain sums over all users and items."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cf, shares
from tidemark.plans import popularity_cf as P
from test_neighbours import grouped

W = P.BASE_WEIGHTS


def dense(model):
    """All users x items: user CF, item CF, popularity, and which cells are seen."""
    rows = {n: getattr(model, n).toPandas() for n in ("weights", "item_sims", "neighbours", "popularity")}
    users, items = (np.unique(rows["weights"][c]) for c in ("user_id", "item_id"))
    at = lambda names, column: np.searchsorted(names, column)
    w, s, n = np.zeros((len(users), len(items))), np.zeros((len(items), len(items))), np.zeros((len(users), len(users)))
    w[at(users, rows["weights"]["user_id"]), at(items, rows["weights"]["item_id"])] = rows["weights"]["w"]
    s[at(items, rows["item_sims"]["item_a"]), at(items, rows["item_sims"]["item_b"])] = rows["item_sims"]["sim"]
    n[at(users, rows["neighbours"]["user_id"]), at(users, rows["neighbours"]["other_id"])] = rows["neighbours"]["sim"]
    seen = w > 0
    pop = rows["popularity"].sort_values("item_id")["popularity"].to_numpy()
    return users, items, n @ w / (n.sum(1)[:, None] + 1e-10), (seen @ s) / seen.sum(1)[:, None], pop, seen


def best(users, items, user_cf, item_cf, pop, seen, k):
    score = W["user_cf"] * user_cf + W["item_cf"] * item_cf + W["popularity"] * pop
    out = set()
    for u in range(len(users)):
        order = sorted((-round(score[u, i], 10), i) for i in np.flatnonzero(~seen[u]))
        out |= {(users[u], items[i], round(user_cf[u, i], 8), round(item_cf[u, i], 8)) for _, i in order[:k]}
    return out


def model_of(weights):
    sims = cf.mirrored(cf.item_similarity(weights), weights)
    return P.Model(weights, sims.cache(), cf.user_neighbours(weights, 6, keep_self=True).cache(), cf.popularity(weights).cache())


@pytest.mark.parametrize("tile_sims", [100, 10**6])
def test_best_items_of_every_user(spark, monkeypatch, tile_sims):
    monkeypatch.setattr(shares, "TILE_SIMS", tile_sims)
    model = model_of(grouped(spark, 3, 90, 14, mixed=0.3).cache())
    all_cells = dense(model)
    found = P.component_scores(model, 4)
    score = sum(F.col(n) * w for n, w in W.items())
    rows = P.scoring.top_k(found.withColumn("score", score), 4)
    got = {(r["user_id"], r["item_id"], round(r["user_cf"], 8), round(r["item_cf"], 8)) for r in rows.collect()}
    assert got == best(*all_cells, 4)
    some = spark.createDataFrame([(0,), (7,), (1_000,)], "user_id long")
    assert {r["user_id"] for r in P.component_scores(model, 4, some).collect()} == {0, 7}
    # Every row that is returned holds the whole shares, also those that only their popularity brought in.
    users, items, user_cf, item_cf, *_ = all_cells
    for r in found.collect():
        u, i = np.searchsorted(users, r["user_id"]), np.searchsorted(items, r["item_id"])
        assert abs(r["user_cf"] - user_cf[u, i]) < 1e-9 and abs(r["item_cf"] - item_cf[u, i]) < 1e-9


def test_user_cf_writes_no_row_per_neighbour_and_item(spark):
    weights = grouped(spark, 3, 90, 14, mixed=0.3).cache()
    near = cf.user_neighbours(weights, 6).cache()
    scores = cf.user_cf_scores(near, weights)
    other = weights.select(F.col("user_id").alias("other_id"), "item_id", "w")
    total = near.groupBy("user_id").agg(F.sum("sim").alias("t"))
    plain = near.join(other, "other_id").groupBy("user_id", "item_id").agg(F.sum(F.col("sim") * F.col("w")).alias("s")).join(total, "user_id")
    want = sorted((r["user_id"], r["item_id"], round(r["s"] / r["t"], 9)) for r in plain.collect())
    assert sorted((r["user_id"], r["item_id"], round(r["score"], 9)) for r in scores.collect()) == want
    # One packed row per neighbour, instead of an aggregate of rows per neighbour and item.
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in text and not any("item_id" in line for line in text.splitlines() if "hashpartitioning(user_id" in line)


def packed(rows):
    users, sims, lists = zip(*rows)
    items = pa.array([list(x) for x in lists], pa.list_(pa.int64()))
    ws = pa.array([[float(i + 1) for i in x] for x in lists], pa.list_(pa.float64()))
    return pa.table({"user_id": pa.array(users, pa.int64()), "sim": pa.array(sims, pa.float64()), "items": items, "ws": ws})


def test_runs_end_where_a_user_ends(monkeypatch):
    monkeypatch.setattr(shares, "ENTRIES", 5)
    table = packed([(u, 0.5, range(1 + (u * i) % 4)) for u in range(9) for i in range(u % 5 + 1)])
    runs = list(shares._whole_users(iter(table.to_batches(max_chunksize=2))))
    assert len(runs) > 3 and pa.concat_tables(runs).equals(table)
    ids = [set(r.column("user_id").to_pylist()) for r in runs]
    assert sum(map(len, ids)) == 9


@pytest.mark.parametrize("matrix", [0, 10**6])
def test_cells_do_not_depend_on_blocks(monkeypatch, matrix):
    rng = np.random.default_rng(5)
    n = 40  # items 0..39; the tile holds those that are 1 of 2
    a, b = (x.ravel() for x in np.indices((n, n)))
    pick = (a != b) & (b % 2 == 1) & (rng.random(n * n) < 0.3)
    sims = {"a": a[pick], "b": b[pick], "v": np.round(rng.random(pick.sum()), 1), "item_id": [None] * int(pick.sum())}
    mine = np.arange(1, n, 2)
    rows = {"a": np.full(len(mine), -1), "b": mine, "v": np.full(len(mine), 0.1), "item_id": (1_000 - mine).tolist()}
    tile = pa.table({c: pa.array([*sims[c], *rows[c]], t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("v", pa.float64()), ("item_id", pa.int64()))})
    own = [rng.choice(n, rng.integers(1, 9), replace=False) for _ in range(50)]
    near = [rng.choice(mine, rng.integers(0, 9), replace=False) for _ in range(50)]
    people = pa.table(
        {
            "user_id": np.arange(50),
            "own": pa.array(own, pa.list_(pa.int32())),
            "items": pa.array(near, pa.list_(pa.int32())),
            "shares": pa.array([np.full(len(x), 0.5) for x in near], pa.list_(pa.float64())),
        }
    )

    def cells():
        made = shares._best_cells(people, shares._Tile(tile), W, 3)
        return [tuple(x.tolist()) for x in map(np.concatenate, zip(*made))]

    whole = cells()
    monkeypatch.setattr(shares, "MATRIX", matrix)
    monkeypatch.setattr(shares, "CELLS", 60)
    monkeypatch.setattr(shares, "PAIRS", 30)
    got = cells()
    assert got[:3] == whole[:3] and np.allclose(got[3], whole[3])


def test_similarities_travel_packed_and_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(shares, "PACKED", 50)
    rows = [(a, b, float(a + b) / 100) for a in range(1, 40) for b in range(a + 1, 40)]
    packed = shares._packed(spark.createDataFrame(rows, "a int, b int, sim double"), 7).collect()
    got = [(a, b, v) for r in packed for a, b, v in zip(r["a"], r["b"], r["v"]) if b % 7 == r["tile"]]
    assert sorted(got) == sorted(rows + [(b, a, v) for a, b, v in rows])
    assert len(packed) < len(got) / 4


@pytest.mark.parametrize("weights", [W, {"user_cf": 0.0, "item_cf": 0.0, "popularity": 1.0}, {"user_cf": 1.0, "item_cf": 0.0, "popularity": 0.0}])
def test_floors_leave_the_best_items(spark, monkeypatch, weights):
    monkeypatch.setattr(shares, "TILE_SIMS", 400)
    monkeypatch.setattr(shares, "USERS", 13)
    model = model_of(grouped(spark, 3, 90, 40, mixed=0.3).cache())
    monkeypatch.setitem(globals(), "W", weights)
    users, items, user_cf, item_cf, pop, seen = dense(model)
    found = P.component_scores(model, 4, None, weights)
    rows = P.scoring.top_k(found.withColumn("score", sum(F.col(n) * w for n, w in weights.items())), 4).collect()
    got = {(r["user_id"], r["item_id"], round(r["user_cf"], 8), round(r["item_cf"], 8)) for r in rows}
    assert got == best(users, items, user_cf, item_cf, pop, seen, 4)


def test_floor_is_what_the_kth_unseen_share_is_at_least():
    u, share, held = np.repeat([0, 1, 2], 30), np.tile(np.arange(30.0), 3), np.array([5, 28, 0])
    assert shares._floors(u, share, held, 4).tolist() == [21.0, 0.0, 26.0]  # the 9th and the 4th largest; the second user has too few


def test_cells_below_the_floor_do_not_leave_a_task():
    n = 60
    a, b = (x.ravel() for x in np.indices((n, n)))
    sims = {"a": a[a != b], "b": b[a != b], "v": np.where(b[a != b] < 50, 0.01, 0.9), "item_id": [None] * (n * n - n)}
    rows = {"a": np.full(n, -1), "b": np.arange(n), "v": np.zeros(n), "item_id": np.arange(n).tolist()}
    tile = shares._Tile(pa.table({c: pa.array([*sims[c], *rows[c]], t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("v", pa.float64()), ("item_id", pa.int64()))}))
    lists = {"own": pa.array([[0, 1]] * 5, pa.list_(pa.int32())), "items": pa.array([[2]] * 5, pa.list_(pa.int32())), "shares": pa.array([[0.4]] * 5)}
    people = pa.table({"user_id": np.arange(5), **lists})
    every, some = (
        sorted((int(x), int(y)) for r, c, *_ in shares._best_cells(t, tile, W, 30) for x, y in zip(r, c))
        for t in (people, people.append_column("floor", pa.array([0.1] * 5)))
    )
    assert {c for _, c in every} > {2, 20, 32, 55}  # all the first places, and others among the best
    assert {(u, c) for u, c in some if c > 32} == {(u, c) for u in range(5) for c in range(50, 60)}
