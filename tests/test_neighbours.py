"""Nearest users by cells and bounds against a comparison of all users."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cf, neighbours


def grouped(spark, groups, users, items, seed=1, mixed=0.0):
    """Users of some groups; each group has items of its own, and some users take items of any group."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        g = u % groups
        for i in rng.choice(items, rng.integers(3, items // 2), replace=False):
            other = rng.integers(0, groups) if rng.random() < mixed else g
            rows.append((u, int(other * items + i), float(np.round(rng.gamma(2.0), 3)) + 0.01))
    return spark.createDataFrame(sorted({(u, i): (u, i, w) for u, i, w in rows}.values()), "user_id long, item_id long, w double")


def ranked(found, k):
    order = [F.desc(F.col("user_id") == F.col("other_id")), F.desc("sim"), F.asc("other_id")]
    top = cf.skew.rank_rows(found, ["user_id"], order, k + 1).filter("user_id <> other_id and sim > 0")
    return sorted((r["user_id"], r["rank"], r["other_id"], round(r["sim"], 9), r["common"]) for r in top.collect())


@pytest.mark.parametrize("metric", neighbours.METRICS)
@pytest.mark.parametrize("mixed", [0.0, 0.4])
def test_equals_all_tiles(spark, metric, mixed):
    weights = grouped(spark, 5, 260, 12, mixed=mixed).cache()
    got = ranked(neighbours.candidates(weights, 7, metric, tile=20), 7)
    assert got == ranked(cf._all_tiles(weights, 7, metric), 7)


def test_copies_ties_and_more_neighbours_than_users(spark):
    rows = [(u, i, 1.0) for u in range(60) for i in ((1, 2, 3) if u % 3 else (3, 4))] + [(99, 500, 2.0)]
    weights = spark.createDataFrame(rows, "user_id long, item_id long, w double")
    for k in (5, 200):
        assert ranked(neighbours.candidates(weights, k, "cosine", tile=8), k) == ranked(cf._all_tiles(weights, k, "cosine"), k)


def test_vectors_travel_only_where_bounds_allow(spark):
    weights = grouped(spark, 16, 1_600, 10).cache()
    table = neighbours.vectors(weights)
    dealt, found, radii = neighbours.cells(table, "cosine", 50, pivots=64)
    assert len(radii) > 16
    first = neighbours.visits(dealt, found, radii, "cosine", 5, 50)
    # Built, dealt to parts, and copies that travel: entries of vectors that are shuffled against rows of weights.
    entries = F.coalesce(F.sum(F.size("items")), F.lit(0))
    travelled = first.filter("to_cell is not null").agg(entries).first()[0]
    assert 2 * weights.count() + travelled < 5 * weights.count()


def brute(a, b, metric, k, same):
    side = neighbours.Side(a), neighbours.Side(b)
    items = np.unique(np.concatenate([s.item for s in side]))
    for s in side:
        s.on(items)
    x, y = (s.dense(0, s.n, len(items)) for s in side)
    sums = {n: ((x**p * (x != 0)) @ (y**q * (y != 0)).T) for n, (p, q) in neighbours._products(metric).items()}
    r, c = (z.ravel() for z in np.indices((len(x), len(y))))
    sim = neighbours._values(metric, {n: v.ravel() for n, v in sums.items()}, *side, r, c).reshape(len(x), len(y))
    out = []
    for u in range(len(x)):
        order = sorted((-sim[u, v], v) for v in range(len(y)) if sim[u, v] > 0 and not (same and u == v))
        out += [(u, v, round(-s, 9)) for s, v in order[:k]]
    return sorted(out)


@pytest.mark.parametrize("metric", [*neighbours.METRICS, "pearson"])
@pytest.mark.parametrize("items, share", [(30, 0.5), (4_000, 0.005)])
@pytest.mark.parametrize("same", [True, False])
def test_kernel_keeps_the_best_in_small_steps(monkeypatch, metric, items, share, same):
    rng = np.random.default_rng(3)

    def table(n):
        lists = [np.flatnonzero(rng.random(items) < share) for _ in range(n)]
        weights = [rng.integers(1, 4, len(x)).astype(float) for x in lists]  # many ties
        return pa.table({"user_id": np.arange(n), "items": pa.array(lists, pa.list_(pa.int64())), "ws": pa.array(weights, pa.list_(pa.float64()))})

    a, b = table(150), table(210)
    b = a if same else b
    for name, value in (("SCORES", 3_000), ("CELLS", 2_000), ("PAIRS", 500)):
        monkeypatch.setattr(neighbours, name, value)
    calls = []
    for name in ("_by_blocks", "_by_entries"):
        run = getattr(neighbours, name)
        monkeypatch.setattr(neighbours, name, lambda *x, run=run, name=name: (calls.append(name), run(*x)))
    best, _, _ = neighbours.nearest(a, b, metric, 7, same=same)
    assert calls == ["_by_entries" if items > 1_000 and metric != "euclidean" else "_by_blocks"]
    got = sorted(zip(best.r.tolist(), best.c.tolist(), np.round(best.sim, 9).tolist()))
    assert got == brute(a, b, metric, 7, same)


def test_correlations_by_parts(spark):
    weights = grouped(spark, 3, 120, 12, mixed=0.5).cache()
    assert ranked(neighbours.everywhere(weights, 6, "pearson", tile=25), 6) == ranked(cf._all_tiles(weights, 6, "pearson"), 6)


def test_no_users(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, w double")
    assert cf.user_neighbours(none, 3).count() == 0


def test_guests_meet_a_part_in_bounded_runs(monkeypatch):
    rng = np.random.default_rng(4)

    def table(first, n):
        items = [np.sort(rng.choice(40, rng.integers(3, 20), replace=False)) for _ in range(n)]
        ws = [rng.random(len(x)).round(2) + 0.1 for x in items]
        return pa.table({"user_id": np.arange(first, first + n), "items": pa.array(items, pa.list_(pa.int64())), "ws": pa.array(ws, pa.list_(pa.float64()))})

    guests, hosts, sizes = table(0, 130), table(1000, 90), []
    whole = neighbours._meet("cosine", 5, "bigint")((0, 0, 0), guests, hosts)
    inner = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda g, *rest: sizes.append(g.num_rows) or inner(g, *rest))
    monkeypatch.setattr(neighbours, "GUESTS", 25, raising=False)
    parts = neighbours._meet("cosine", 5, "bigint")((0, 0, 0), guests, hosts)
    assert parts.equals(whole) or parts.combine_chunks().equals(whole.combine_chunks())
    assert max(sizes) <= 25 and sum(sizes) == 130


def few_shared(spark, users=300, items=3_000):
    rng = np.random.default_rng(6)
    rows = [(u, int(i), float(rng.integers(1, 4))) for u in range(users) for i in rng.choice(items, rng.integers(1, 30), replace=False)]
    return spark.createDataFrame(rows, "user_id long, item_id long, w double").cache()


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_users_who_share_few_items_meet_in_passes(spark, monkeypatch, metric):
    weights = few_shared(spark)
    table = neighbours.vectors(weights)
    assert neighbours.sparse(table, metric) and not neighbours.sparse(neighbours.vectors(grouped(spark, 5, 260, 12)), metric)
    monkeypatch.setattr(neighbours, "PART_ENTRIES", 400)
    assert neighbours._grid(table, None) > 2 * neighbours.PASS_COPIES // 2
    assert ranked(neighbours.candidates(weights, 7, metric), 7) == ranked(cf._all_tiles(weights, 7, metric), 7)


def test_a_pass_copies_the_vectors_a_bounded_number_of_times(spark, monkeypatch):
    weights = few_shared(spark)
    table = neighbours.vectors(weights).cache()
    sides = []
    spread = neighbours.skew.spread
    monkeypatch.setattr(neighbours.skew, "spread", lambda df, *keys: sides.append(df.count()) or spread(df, *keys))
    none = lambda group, a, b: pa.table({"n": pa.array([0], pa.int64())})
    passes = list(neighbours.in_passes(table, 30, none, "n bigint"))
    pairs = sum(meet().count() for meet in passes)
    assert pairs == 30 * 30 and len(passes) > 5
    assert max(a + b for a, b in zip(sides[::2], sides[1::2])) <= 1.2 * neighbours.PASS_COPIES * 300
    sides.clear()
    assert sum(meet().count() for meet in neighbours.in_passes(table, 30, none, "n bigint", halves=True)) == 30 * 31 / 2
    assert max(a + b for a, b in zip(sides[::2], sides[1::2])) <= 1.2 * neighbours.PASS_COPIES * 300


@pytest.mark.parametrize("metric", [*neighbours.METRICS, "pearson"])
@pytest.mark.parametrize("few", [True, False])
def test_all_pairs_are_added_up_in_parts(spark, metric, few):
    weights = few_shared(spark, 120, 900) if few else grouped(spark, 3, 120, 12, mixed=0.5).cache()
    whole = [r for r in cf._all_tiles(weights, 200, metric).collect() if r["user_id"] < r["other_id"] and r["sim"] > 0]
    for tile in (None, 25):
        s, n, m = neighbours.all_pairs(weights, metric, tile).agg(F.sum("s"), F.sum("n"), F.max("m")).first()
        assert n == len(whole) and abs(s - sum(r["sim"] for r in whole)) < 1e-8 and m == pytest.approx(max(r["sim"] for r in whole), abs=1e-12)
    row = cf.user_similarity_summary(weights, metric).first()
    assert row["mean_sim"] == pytest.approx(s / n) and row["max_sim"] == pytest.approx(m)


def test_no_pairs(spark):
    for rows in ([], [(1, 1, 1.0)], [(1, 1, 1.0), (2, 2, 1.0)]):
        row = cf.user_similarity_summary(spark.createDataFrame(rows, "user_id long, item_id long, w double")).first()
        assert tuple(row) == (0.0, 0.0)
