"""Popularity + collaborative filtering recommendations for all users at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions.stage import global_places, maybe_broadcast, stage
from tidemark.operators import cf, neighbours, rerank, scoring
from tidemark.operators import shares as shares_of

# Source weights of the two variants and the reason thresholds.
BASE_WEIGHTS = {"user_cf": 0.25, "item_cf": 0.25, "popularity": 0.40}
REBALANCED_WEIGHTS = {"user_cf": 0.35, "item_cf": 0.35, "popularity": 0.20}
REASON_LIMITS = {"user_cf": 0.1, "item_cf": 0.1, "popularity": 0.05}
NEIGHBOURS = 50


@dataclass
class Model:
    """Fitted tables; each is a staged scan, so several recommendation jobs can share them."""

    weights: DataFrame
    item_sims: DataFrame  # both directions and the diagonal
    neighbours: DataFrame
    popularity: DataFrame
    _placed: list[DataFrame] = field(default_factory=list, repr=False)

    def by_place(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Staged once: places of the items by popularity, users' vectors over places, and similarities (a, b, sim) of different places, one direction."""
        if not self._placed:
            places = stage(global_places(self.popularity, [F.desc(F.round("popularity", 10)), F.asc("item_id")]), "popular-places")
            number = places.select("item_id", F.col("place").cast("int").alias("place"))
            coded = self.weights.join(maybe_broadcast(number), "item_id").select("user_id", F.col("place").alias("item_id"), "w")
            sims = self.item_sims.filter("item_a < item_b").select("item_a", "item_b", "sim")
            for side, name in (("item_a", "a"), ("item_b", "b")):
                sims = sims.join(maybe_broadcast(number.select(F.col("item_id").alias(side), F.col("place").alias(name))), side).drop(side)
            self._placed = [places, stage(neighbours.vectors(coded), "user-vectors"), stage(sims.select("a", "b", "sim"), "placed-sims")]
        return tuple(self._placed)


def fit(events: DataFrame, min_user: int = 5, min_item: int = 3, decay_days: float = 30.0) -> Model:
    weights = stage(cf.decayed_weights(events, min_user, min_item, decay_days), "weights")
    sims = stage(cf.mirrored(cf.item_similarity(weights), weights), "item-sims")
    neighbours = stage(cf.user_neighbours(weights, NEIGHBOURS, keep_self=True), "neighbours")
    return Model(weights, sims, neighbours, stage(cf.popularity(weights), "popularity"))


def component_scores(model: Model, k: int, users: DataFrame | None = None, weights: dict[str, float] = BASE_WEIGHTS) -> DataFrame:
    """(user_id, item_id, user_cf, item_cf, popularity) of unseen items that can make a top k by the weighted sum.

    All parts go into one union and one aggregate per (user, item): the best shares of the
    neighbours' weights and of the item similarities, the user's own items (to drop
    them), and a popular head. CF scores are never negative, so an item without any loses to
    every unseen item that is more popular: only the first k + (own items) places matter.
    """
    own, near = model.weights, model.neighbours.select("user_id", "other_id", "sim")
    if users is not None:
        own, near = (t.join(users.select("user_id"), "user_id", "left_semi") for t in (own, near))
    places, vectors, sims = model.by_place()
    mine = vectors if users is None else vectors.join(users.select("user_id"), "user_id", "left_semi")
    zero = F.lit(0.0)

    def part(df: DataFrame, user_cf: Column = zero, item_cf: Column = zero, seen: Column = zero) -> DataFrame:
        return df.select("user_id", "item_id", user_cf.alias("user_cf"), item_cf.alias("item_cf"), seen.alias("seen"))

    # Every part is laid out by user, so the aggregate per (user, item) and the ranking per
    # user that follows read it as it is.
    shares = skew.spread(shares_of.best_shares(near, vectors, mine, sims, places, weights, k), "user_id")
    held = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    upto = F.least(F.col("held") + k, F.lit(places.count()))
    head = skew.spread(held, "user_id").select("user_id", F.explode(F.sequence(F.lit(1), upto)).alias("place")).join(maybe_broadcast(places), "place")
    rows = (
        part(shares, user_cf=F.col("user_cf"), item_cf=F.col("item_cf"))
        .unionByName(part(skew.spread(own, "user_id"), seen=F.lit(1.0)))
        .unionByName(part(head))
    )
    sums = rows.groupBy("user_id", "item_id").agg(*[F.sum(c).alias(c) for c in ("user_cf", "item_cf", "seen")])
    return sums.filter("seen = 0").drop("seen").join(model.popularity, "item_id")


def recommend(
    model: Model,
    k: int = 10,
    weights: dict[str, float] = BASE_WEIGHTS,
    diversity: float = 0.3,
    users: DataFrame | None = None,
) -> DataFrame:
    """(user_id, item_id, score, rank, reasons): k unseen items per trained user, spread by item similarity.

    `users` limits the job to some of the trained users.
    """
    rows = component_scores(model, k, users, weights)
    total = sum((F.col(name) * F.lit(w) for name, w in weights.items()), F.lit(0.0))
    best = stage(scoring.top_k(rows.withColumn("score", total), k), "top")
    packed = rerank.pack(rerank.with_pair_sims(best, maybe_broadcast(model.item_sims)), "sims")
    placed = rerank.rerank(packed, "mean_gap", lam=diversity).select("user_id", "item_id", F.col("place").alias("rank"))
    words = {"user_cf": "similar_users", "item_cf": "related_items", "popularity": "popular"}
    reasons = F.concat_ws(",", *[F.when(F.col(c) > REASON_LIMITS[c], words[c]) for c in words])
    return best.drop("rank").join(placed, ["user_id", "item_id"]).select("user_id", "item_id", "score", "rank", reasons.alias("reasons"))


def cold_start(model: Model, users: DataFrame, k: int = 10) -> DataFrame:
    """The k most popular items for users the model does not know; the head is k rows."""
    head = model.popularity.orderBy(F.desc(F.round("popularity", 10)), "item_id").limit(k)
    rows = head.agg(
        F.array_sort(F.collect_list(F.struct((-F.round("popularity", 10)).alias("o"), "item_id", F.col("popularity").alias("score")))).alias("top")
    )
    unknown = users.select("user_id").join(model.weights.select("user_id").distinct(), "user_id", "left_anti")
    return unknown.withColumn("top", rows.scalar()).select("user_id", F.posexplode("top").alias("p", "e")).select(
        "user_id", "e.item_id", "e.score", (F.col("p") + 1).alias("rank"), F.lit("popular,cold_start").alias("reasons")
    )


def split_by_time(events: DataFrame, share: float = 0.8, accuracy: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Train before and test from the exact `share` quantile of the event time."""
    micros = events.select(F.unix_micros("event_time").alias("m"))
    cut = skew.quantiles(micros, [], "m", {"cut": share}, accuracy=accuracy).first()["cut"]
    at = F.unix_micros("event_time").cast("double")
    return events.filter(at < cut), events.filter(at >= cut)


# Per segment the model, list length and (reported, not applied) weights.
STRATEGIES = {
    "new": ("base", 5, {"popularity": 0.70, "user_cf": 0.10, "item_cf": 0.10, "diversity": 0.10}),
    "beginner": ("base", 8, {"popularity": 0.50, "user_cf": 0.20, "item_cf": 0.20, "diversity": 0.10}),
    "regular": ("rebalanced", 10, {"popularity": 0.20, "user_cf": 0.35, "item_cf": 0.35, "diversity": 0.10}),
    "heavy": ("rebalanced", 12, {"popularity": 0.10, "user_cf": 0.40, "item_cf": 0.35, "diversity": 0.15}),
    "inactive": ("base", 5, {"popularity": 0.60, "user_cf": 0.15, "item_cf": 0.15, "diversity": 0.10}),
}


def adaptive(model: Model, profiles: DataFrame) -> DataFrame:
    """Recommendations by segment: each segment has its own model variant and list length.

    One list per (variant, length) is computed for the users of its segments only.
    """
    plan = {}
    for segment, (variant, k, _) in STRATEGIES.items():
        plan.setdefault((variant, k), []).append(segment)
    out = None
    for (variant, k), segments in plan.items():
        members = profiles.filter(F.col("segment").isin(segments)).select("user_id", "segment")
        weights = BASE_WEIGHTS if variant == "base" else REBALANCED_WEIGHTS
        known = recommend(model, k, weights, users=members).join(members, "user_id")
        cold = cold_start(model, members, k).join(members, "user_id")
        part = known.unionByName(cold).withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out
