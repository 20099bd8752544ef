"""Interaction weights, pairwise similarities, neighbours and collaborative-filtering scores.

Weights are long-form (user_id, item_id, w), one row per pair, so even the busiest
user has at most one row per catalogue item.

Pairwise products never leave a task as raw pairs:
* item x item sums over users: `item_products` adds up bounded runs of users as small
  matrix products inside each task and emits one partial sum per item pair and run.
* user x user similarities: `user_neighbours` compares cells of users, visits other cells only
  where a bound allows it, and emits only the best k of each user per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.functions.stage import maybe_broadcast, stage
from tidemark.functions.text import literal_map
from tidemark.operators import neighbours, shares
from tidemark.session import AS_OF

# Event weights of the weighted matrix; every other event counts 1.
EVENT_WEIGHTS = {"run_paraphrasing": 1.0, "selected_paraphrasing": 1.5, "copy_sentence": 2.0}

USER_TILE = 2048
RUN_ROWS = 100_000
DENSE_ITEMS = 1500
PAIR_BUDGET = 2_000_000
OUT_ROWS = 200_000


# --- weights ---------------------------------------------------------------------------


def event_weight(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(EVENT_WEIGHTS), name), F.lit(1.0))


def interaction_weights(events: DataFrame, kind: str = "binary", as_of: str | Column = AS_OF) -> DataFrame:
    """binary: 1 per pair; count: events; weighted: sum of day decay x event weight; other kinds act as binary."""
    known = events.filter(F.col("item_id").isNotNull())
    value = {
        "count": F.count(F.lit(1)).cast("double"),
        "weighted": F.sum(tf.day_decay(F.col("event_time"), tf.as_ts(as_of)) * event_weight(F.col("event_name")))
        if "event_name" in events.columns
        else None,
    }.get(kind)
    if value is None:
        return known.select("user_id", "item_id").distinct().withColumn("w", F.lit(1.0))
    return known.groupBy("user_id", "item_id").agg(value.alias("w"))


def simple_matrix(events: DataFrame, as_of: str = AS_OF, days: int = 30, min_items: int = 3) -> DataFrame:
    """Counts per pair of the last N days, for users with enough distinct items."""
    recent = events.filter(tf.since("event_time", as_of, days=days))
    counts = interaction_weights(recent, "count")
    rich = counts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_items)
    return counts.join(rich, "user_id", "left_semi")


def enough_data(pairs: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Pairs whose user and item both have enough events.

    `pairs` has an event count `n` per (user, item); both limits look at the unfiltered
    table (one pass, not a fixed point).
    """
    per_user = pairs.groupBy("user_id").agg(F.sum("n").alias("t")).filter(F.col("t") >= min_user).select("user_id")
    per_item = pairs.groupBy("item_id").agg(F.sum("n").alias("t")).filter(F.col("t") >= min_item).select("item_id")
    return pairs.join(per_user, "user_id", "left_semi").join(per_item, "item_id", "left_semi")


def decayed_weights(events: DataFrame, min_user: int = 5, min_item: int = 3, decay_days: float = 30.0) -> DataFrame:
    """Sum of exp(-whole days before the newest kept event / decay_days) per pair."""
    known = events.filter(F.col("item_id").isNotNull())
    pairs = known.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last"))
    kept = enough_data(pairs, min_user, min_item)
    newest = kept.agg(F.max("last")).scalar()
    decayed = known.withColumn("end", newest).groupBy("user_id", "item_id").agg(
        F.sum(tf.day_decay(F.col("event_time"), F.col("end"), decay_days)).alias("w")
    )
    return decayed.join(kept.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def vector_of(weights: DataFrame, key: str, value: object) -> DataFrame:
    """One user's items or one item's users with their weights."""
    return weights.filter(F.col(key) == value).drop(key)


def normalised_rows(weights: DataFrame) -> DataFrame:
    """Weights scaled to unit length per user."""
    norm = weights.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, "user_id").select("user_id", "item_id", (F.col("w") / F.col("norm")).alias("w"))


def matrix_info(weights: DataFrame) -> DataFrame:
    row = weights.agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("nnz")
    )
    density = F.try_divide(F.col("nnz"), F.col("users") * F.col("items"))
    return row.withColumn("density", density).withColumn("sparsity", 1.0 - density)


# --- item x item products --------------------------------------------------------------


def _emit(items: np.ndarray, a: np.ndarray, b: np.ndarray, sums: list[np.ndarray], names: list[str]) -> Iterator[pd.DataFrame]:
    for start in range(0, len(a), OUT_ROWS):
        cut = slice(start, start + OUT_ROWS)
        yield pd.DataFrame({"item_a": items[a[cut]], "item_b": items[b[cut]], **{n: s[cut] for n, s in zip(names, sums)}})


def _factors(w: np.ndarray, moments: bool) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(name, left, right) entry values whose products over common users give each sum."""
    one = np.ones_like(w)
    out = [("dot", w, w), ("common", one, one)]
    if moments:
        out += [("sum_a", w, one), ("sum_b", one, w), ("sq_a", w * w, one), ("sq_b", one, w * w)]
    return out


def _dense_run(u: np.ndarray, i: np.ndarray, w: np.ndarray, items: np.ndarray, moments: bool) -> Iterator[pd.DataFrame]:
    n = len(items)
    factors = _factors(w, moments)
    totals = [np.zeros((n, n)) for _ in factors]
    step = max(1, PAIR_BUDGET // n)
    for first in range(0, int(u[-1]) + 1, step):
        lo, hi = np.searchsorted(u, [first, first + step])
        rows, cols = u[lo:hi] - first, i[lo:hi]
        size = (int(rows[-1]) + 1 if len(rows) else 0, n)
        for total, (_, left, right) in zip(totals, factors):
            x, y = np.zeros(size), np.zeros(size)
            x[rows, cols], y[rows, cols] = left[lo:hi], right[lo:hi]
            total += x.T @ y
    a, b = np.nonzero(np.triu(totals[1], 1))
    yield from _emit(items, a, b, [t[a, b] for t in totals], [f[0] for f in factors])


def _sparse_run(u: np.ndarray, i: np.ndarray, w: np.ndarray, items: np.ndarray, moments: bool) -> Iterator[pd.DataFrame]:
    n = len(items)
    factors = _factors(w, moments)
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    ends = np.r_[starts[1:], len(u)]
    last = np.repeat(ends, ends - starts)
    width = last - np.arange(len(u)) - 1  # partners after each entry within its user
    done = np.r_[0, np.cumsum(width)]
    at = 0
    while at < len(u):
        upto = max(at + 1, int(np.searchsorted(done, done[at] + PAIR_BUDGET, side="right")) - 1)
        span = width[at:upto]
        left = np.repeat(np.arange(at, upto), span)
        right = left + 1 + np.arange(len(left)) - np.repeat(done[at:upto] - done[at], span)
        code, where = np.unique(i[left] * n + i[right], return_inverse=True)
        sums = [np.bincount(where, x[left] * y[right], minlength=len(code)) for _, x, y in factors]
        yield from _emit(items, code // n, code % n, sums, [f[0] for f in factors])
        at = upto


def item_products(weights: DataFrame, moments: bool = False) -> DataFrame:
    """Per item pair a < b: dot product and number of common users (with `moments` also the
    sums and squares over the common users that a correlation needs).

    Rows arrive sorted by user. A task takes users up to about RUN_ROWS rows at a time and
    adds their products up locally: as dense blocks when few items are involved, else as
    sorted sparse products of at most PAIR_BUDGET entries at a time.
    """
    names = ["dot", "common"] + (["sum_a", "sum_b", "sq_a", "sq_b"] if moments else [])
    item_type = weights.schema["item_id"].dataType.simpleString()
    schema = f"item_a {item_type}, item_b {item_type}, " + ", ".join(f"{n} double" for n in names)

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(["user_id", "item_id"], kind="stable")
        items, i = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
        _, u = np.unique(rows["user_id"].to_numpy(), return_inverse=True)
        if len(items) < 2:
            return
        kernel = _dense_run if len(items) <= DENSE_ITEMS else _sparse_run
        yield from kernel(u, i.astype(np.int64), rows["w"].to_numpy(), items, moments)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if size >= RUN_ROWS:
                # The user at the end of the held rows may go on in this batch.
                tail = held[-1]["user_id"].iloc[-1]
                same = batch["user_id"] == tail
                held.append(batch[same])
                batch = batch[~same]
                if len(batch):
                    yield from run(pd.concat(held))
                    held, size = [], 0
            held.append(batch)
            size += len(batch)
        if size:
            yield from run(pd.concat(held))

    by_user = skew.spread(weights.select("user_id", "item_id", "w"), "user_id").sortWithinPartitions("user_id")
    partial = by_user.mapInPandas(task, schema)
    return partial.groupBy("item_a", "item_b").agg(*[F.sum(n).alias(n) for n in names])


def item_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.count(F.lit(1)).alias("n"))


# Column builders for each metric over the sums of a pair; norms come as (sq, n) of a and b.
def _cosine(p: dict[str, Column]) -> Column:
    norm = F.sqrt(p["nsq_a"] * p["nsq_b"])
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["dot"] / norm))).otherwise(0.0)


def _jaccard(p: dict[str, Column]) -> Column:
    return p["common"] / (p["n_a"] + p["n_b"] - p["common"])


def _pearson(p: dict[str, Column]) -> Column:
    n = p["common"]
    cov = p["dot"] - p["sum_a"] * p["sum_b"] / n
    var = (p["sq_a"] - p["sum_a"] * p["sum_a"] / n) * (p["sq_b"] - p["sum_b"] * p["sum_b"] / n)
    return F.when((n >= 2) & (var > 1e-18), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var)))).otherwise(0.0)


def _euclidean(p: dict[str, Column]) -> Column:
    return F.exp(-F.sqrt(F.greatest(F.lit(0.0), p["nsq_a"] + p["nsq_b"] - 2 * p["dot"])))


METRICS = {"cosine": _cosine, "jaccard": _jaccard, "pearson": _pearson, "euclidean": _euclidean}


def item_similarity(weights: DataFrame, metric: str = "cosine", min_common: int = 1) -> DataFrame:
    """Similarity of item pairs a < b with common users.

    The euclidean value of pairs without a common user is exp(-sqrt(|a|^2 + |b|^2)) and
    follows from `item_norms`; such pairs are not listed.
    """
    sums = item_products(weights, moments=metric == "pearson")
    norms = stage(item_norms(weights), "item-norms")  # one row per item: the pairs pass no shuffle to get them
    a = maybe_broadcast(norms.select(F.col("item_id").alias("item_a"), F.col("sq").alias("nsq_a"), F.col("n").alias("n_a")))
    b = maybe_broadcast(norms.select(F.col("item_id").alias("item_b"), F.col("sq").alias("nsq_b"), F.col("n").alias("n_b")))
    wide = sums.filter(F.col("common") >= min_common).join(a, "item_a").join(b, "item_b")
    value = METRICS[metric]({c: F.col(c) for c in wide.columns})
    return wide.select("item_a", "item_b", value.alias("sim"), F.col("common").cast("long").alias("common"))


def mirrored(pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Both directions of each pair, and with `weights` the diagonal of 1.0 as well."""
    both = pairs.select(
        F.explode(F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))).alias("p"),
        "sim",
        "common",
    ).select("p.item_a", "p.item_b", "sim", "common")
    if weights is None:
        return both
    own = item_norms(weights).select(
        F.col("item_id").alias("item_a"), F.col("item_id").alias("item_b"), F.lit(1.0).alias("sim"), F.col("n").alias("common")
    )
    return both.unionByName(own)


def item_neighbours(sims: DataFrame, k: int = 20, min_common: int = 1, filter_first: bool = False) -> DataFrame:
    """Top k partners per item out of mirrored pairs without the diagonal.

    The cut to k comes before the filters (sim > 0, enough common users), so fewer than k
    may remain; `filter_first=True` filters and then cuts.
    """
    good = (F.col("sim") > 0) & (F.col("common") >= min_common)
    ranked = skew.rank_rows(
        sims.filter(good) if filter_first else sims, ["item_a"], [F.desc(F.round("sim", 10)), F.asc("item_b")], k
    )
    return ranked.filter(good)


# --- user x user neighbours --------------------------------------------------------------


def user_neighbours(
    weights: DataFrame, k: int = 50, metric: str = "cosine", min_common: int = 1, keep_self: bool = False
) -> DataFrame:
    """(user_id, other_id, sim, common, rank) with the k most similar users of every user.

    Users are compared within cells around pivots and visit other cells only where a bound allows a better
    neighbour (`operators.neighbours`); the result is exact. Correlations have no such bound, so for `pearson` each part of the users
    meets every other one. The cut comes first and the filters (sim > 0, enough common items) after it.
    """
    if metric in neighbours.METRICS:
        found = neighbours.candidates(weights, k, metric)
    else:
        found = neighbours.everywhere(weights, k, metric)
    # The user itself counts towards the cut.
    order = [F.desc(F.col("user_id") == F.col("other_id")), F.desc("sim"), F.asc("other_id")]
    ranked = skew.rank_rows(found, ["user_id"], order, k if keep_self else k + 1)
    if not keep_self:
        ranked = ranked.filter(F.col("user_id") != F.col("other_id"))
    good = (F.col("sim") > 0) & (F.col("common") >= min_common)
    return ranked.filter(good).withColumn("common", F.col("common").cast("long"))


def _all_tiles(weights: DataFrame, k: int, metric: str) -> DataFrame:
    """The same by whole tiles of similarities; what `neighbours` is held against."""
    key = weights.schema["user_id"].dataType.simpleString()

    def best(ids_a, ids_b, sim, common, own: bool) -> list[pd.DataFrame]:
        frames = [_best(ids_a, ids_b, sim, common, k + 1, own)]
        return frames if own else [*frames, _best(ids_b, ids_a, sim.T, common.T, k + 1)]

    return _compare_tiles(weights, metric, best, f"user_id {key}, other_id {key}, sim double, common double")


def user_similarity_summary(weights: DataFrame, metric: str = "cosine") -> DataFrame:
    """Mean of the positive similarities of different users, and the largest; all pairs, one row per pair of parts is added up."""
    total = neighbours.all_pairs(weights, metric).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("max_sim"))
    return total.select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mean_sim"), F.coalesce("max_sim", F.lit(0.0)).alias("max_sim"))


def _compare_tiles(weights: DataFrame, metric: str, use: Callable[..., list[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs `use(ids_a, ids_b, sim, common, own)` on every pair of user tiles."""
    users = weights.select("user_id").distinct().count()
    tiles = max(1, -(-users // USER_TILE))
    tile = F.pmod(F.xxhash64("user_id"), F.lit(tiles)).cast("int")
    rows = weights.select("user_id", "item_id", "w", tile.alias("t"))
    # Both copies of a tile pair (i, j) with i <= j: each tile meets every tile once.
    spread = rows.select("user_id", "item_id", "w", "t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o")).select(
        "*", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j")
    )
    empty = pd.DataFrame({part.split()[0]: [] for part in schema.split(",")})

    def compare(pair: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = pair
        items, col = np.unique(part["item_id"].to_numpy(), return_inverse=True)
        sides = []
        for t in (i, j):
            mine = (part["t"] == t).to_numpy()
            ids, row = np.unique(part["user_id"].to_numpy()[mine], return_inverse=True)
            sides.append((ids, row, col[mine], part["w"].to_numpy()[mine]))
        (ids_a, *_), (ids_b, *_) = sides
        if not len(ids_a) or not len(ids_b):
            return empty
        acc = _tile_sums(sides, len(items), metric == "pearson")
        sq = [np.bincount(row, w * w, minlength=len(ids)) for ids, row, _, w in sides]
        cnt = [np.bincount(row, minlength=len(ids)) for ids, row, _, _ in sides]
        sim = _user_metric(metric, acc, sq, cnt)
        if i == j:
            np.fill_diagonal(sim, 1.0)
        return pd.concat(use(ids_a, ids_b, np.round(sim, 12), acc["common"], i == j))

    return spread.groupBy("i", "j").applyInPandas(compare, schema)


def _tile_sums(sides: list[tuple], n_items: int, moments: bool) -> dict[str, np.ndarray]:
    """Products of two user tiles, added up over runs of 1000 items."""
    (ids_a, *_), (ids_b, *_) = sides
    names = ["dot", "common"] + (["sum_a", "sum_b", "sq_a", "sq_b"] if moments else [])
    acc = {m: np.zeros((len(ids_a), len(ids_b))) for m in names}
    for first in range(0, n_items, 1000):
        blocks = []
        for ids, row, c, w in sides:
            hit = (c >= first) & (c < first + 1000)
            x = np.zeros((len(ids), min(1000, n_items - first)))
            x[row[hit], c[hit] - first] = w[hit]
            blocks.append(x)
        x, y = blocks
        bx, by = (x != 0).astype(float), (y != 0).astype(float)
        acc["dot"] += x @ y.T
        acc["common"] += bx @ by.T
        if moments:
            acc["sum_a"] += x @ by.T
            acc["sum_b"] += bx @ y.T
            acc["sq_a"] += (x * x) @ by.T
            acc["sq_b"] += bx @ (y * y).T
    return acc


def _user_metric(metric: str, acc: dict[str, np.ndarray], sq: list[np.ndarray], cnt: list[np.ndarray]) -> np.ndarray:
    dot, common = acc["dot"], acc["common"]
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            out = np.clip(dot / np.sqrt(np.outer(sq[0], sq[1])), -1, 1)
        elif metric == "jaccard":
            out = common / (cnt[0][:, None] + cnt[1][None, :] - common)
        elif metric == "euclidean":
            out = np.exp(-np.sqrt(np.maximum(0, sq[0][:, None] + sq[1][None, :] - 2 * dot)))
        elif metric == "pearson":
            cov = dot - acc["sum_a"] * acc["sum_b"] / common
            var = (acc["sq_a"] - acc["sum_a"] ** 2 / common) * (acc["sq_b"] - acc["sum_b"] ** 2 / common)
            out = np.where((common >= 2) & (var > 1e-18), np.clip(cov / np.sqrt(var), -1, 1), 0.0)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return np.nan_to_num(out)


def _best(rows: np.ndarray, cols: np.ndarray, sim: np.ndarray, common: np.ndarray, k: int, own: bool = False) -> pd.DataFrame:
    """The k best columns of each row; ids are sorted, so a stable sort breaks ties by id.

    With `own` rows and columns are the same users, and each user's own column comes first.
    """
    key = -sim
    if own:
        np.fill_diagonal(key, -np.inf)
    order = np.argsort(key, axis=1, kind="stable")[:, :k]
    r = np.repeat(np.arange(len(rows)), order.shape[1])
    c = order.ravel()
    return pd.DataFrame({"user_id": rows[r], "other_id": cols[c], "sim": sim[r, c], "common": common[r, c]})


# --- scores -------------------------------------------------------------------------------


def unseen(scores: DataFrame, weights: DataFrame) -> DataFrame:
    return scores.join(weights.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def user_cf_scores(near: DataFrame, weights: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Sum of sim x weight over the chosen neighbours, divided by the sum of their similarities."""
    return shares.neighbour_shares(near, neighbours.vectors(weights), epsilon)


def item_cf_scores(weights: DataFrame, sims: DataFrame, weighted: bool = True) -> DataFrame:
    """Sum of (weight x) similarity over the user's items, divided by their number.

    Weights are laid out by user first: with a small (broadcast) similarity table the sums
    per user then need no further shuffle.
    """
    by_user = skew.spread(weights, "user_id")
    held = by_user.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    part = F.col("w") * F.col("sim") if weighted else F.col("sim")
    right = sims.select(F.col("item_a").alias("item_id"), F.col("item_b"), "sim")
    sums = by_user.join(right, "item_id").groupBy("user_id", F.col("item_b").alias("item_id")).agg(F.sum(part).alias("s"))
    return sums.join(held, "user_id").select("user_id", "item_id", (F.col("s") / F.col("held")).alias("score"))


def popularity(weights: DataFrame) -> DataFrame:
    """Share of the total weight per item."""
    per_item = weights.groupBy("item_id").agg(F.sum("w").alias("w"))
    return per_item.select("item_id", (F.col("w") / per_item.agg(F.sum("w")).scalar()).alias("popularity"))


def neighbour_explanations(neighbours: DataFrame, weights: DataFrame) -> DataFrame:
    """For each (user, item): how many neighbours used the item."""
    other = weights.select(F.col("user_id").alias("other_id"), "item_id")
    return neighbours.select("user_id", "other_id").join(other, "other_id").groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("neighbours")
    )


def closest_owned(recs: DataFrame, weights: DataFrame, sims: DataFrame, first: int = 5) -> DataFrame:
    """For each recommended item the most similar of the user's first owned items (lowest ids)."""
    owned = skew.rank_rows(weights.select("user_id", "item_id"), ["user_id"], [F.asc("item_id")], first, "_r")
    owned = owned.select("user_id", F.col("item_id").alias("owned_id"))
    pairs = recs.select("user_id", "item_id").join(owned, "user_id")
    right = sims.select(F.col("item_a").alias("item_id"), F.col("item_b").alias("owned_id"), "sim")
    order = F.struct(F.round("sim", 10).alias("s"), (-F.col("owned_id")).alias("o"))
    return pairs.join(right, ["item_id", "owned_id"]).groupBy("user_id", "item_id").agg(
        F.max_by("owned_id", order).alias("owned_id"), F.max("sim").alias("sim")
    )
