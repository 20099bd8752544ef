"""Context, recency and time-of-day aware recommenders, and layout slots, for all users at once.

Scores that do not depend on the user (context, recency) live in one catalogue table. A
user's ranking is their own sparse CF scores plus the head of that table; only time
patterns need (user, item) cells, for the items in use, and those are computed tile by tile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import device as dev
from tidemark.functions import skew, text, vectors
from tidemark.functions import timefn as tf
from tidemark.functions.stage import stage
from tidemark.operators import cf, rerank, scoring, temporal
from tidemark.session import AS_OF

# Source weights of the recommenders.
HYBRID_WEIGHTS = {"user_cf": 0.3, "item_cf": 0.3, "context": 0.2, "recency": 0.2}
TEMPORAL_WEIGHTS = {"base": 0.3, "affinity": 0.4, "recency": 0.3}
LAYOUT_WEIGHTS = {"base": 0.40, "fit": 0.20, "affinity": 0.15, "recency": 0.10, "embedding": 0.15}
RECENCY_MIX = {"trending": 0.6, "freshness": 0.4}
PEAK_BOOST, RECENCY_HOURS, LOOKBACK_DAYS = 1.3, 24.0, 90
SLOT_WEIGHTS = {"hero_banner": 1.2, "sidebar_quick": 0.9, "footer_suggestion": 0.7, "dashboard_widget": 1.0}
TILE = 2048
SAME_SCORE = 1e-9  # catalogue scores this close may be equal in a ranking


@dataclass(frozen=True)
class Moment:
    """The request context shared by a job: a time and an operating system."""

    timestamp: str
    os: str | None = None

    @property
    def ts(self) -> Column:
        return F.lit(self.timestamp).cast("timestamp")

    @property
    def device(self) -> Column:
        return dev.device_type(F.lit(self.os).cast("string"))

    def vector(self, spark: SparkSession, long: bool) -> Column:
        """The context vector as a literal: it is the same for every row of the job."""
        build = vectors.long_context_vector if long else vectors.short_context_vector
        return F.lit(spark.range(1).select(build(self.ts, self.device)).first()[0])

    @property
    def hour(self) -> int:
        return pd.Timestamp(self.timestamp).hour


RECENCY_LOSS_PER_DAY = 0.05  # fixed value

# --- catalogue scores -----------------------------------------------------------------------


def context_score(moment: Moment, vector: Column) -> Column:
    """Embedding match with the context vector in [0, 1], else rules from 0.5."""
    when = tf.time_of_day(F.hour(moment.ts))
    rules = (
        F.lit(0.5)
        + F.when((when == "morning") & (F.col("category") == "paraphrasing"), 0.2)
        .when((when == "evening") & (F.col("category") == "creative"), 0.1)
        .otherwise(0.0)
        + F.when(tf.is_business_hours(moment.ts) & F.col("is_premium"), 0.1).otherwise(0.0)
        + F.when((moment.device == "mobile") & (F.col("item_type") == "quick_tool"), 0.15).otherwise(0.0)
    )
    match = vectors.cosine(F.col("embedding"), vector, "unit")
    return F.coalesce(match, F.least(F.lit(1.0), F.greatest(F.lit(0.0), rules)))


def recency_score(features: DataFrame) -> DataFrame:
    mix = F.col("trending_score") * RECENCY_MIX["trending"] + F.col("freshness_score") * RECENCY_MIX["freshness"]
    return features.select("item_id", mix.alias("recency"))


def _catalogue_minmax(df: DataFrame, column: str) -> DataFrame:
    lo, hi = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.when(hi == lo, 0.5).otherwise((F.col(column) - lo) / (hi - lo)))


def catalogue_scores(items: DataFrame, features: DataFrame, moment: Moment | None) -> DataFrame:
    """(item_id, score) of the user-independent part for every active item."""
    active = items.filter("is_active")
    recency = _catalogue_minmax(recency_score(features), "recency")
    rows = active.select("item_id").join(recency, "item_id", "left").withColumn("recency", F.coalesce("recency", F.lit(0.0)))
    total = F.col("recency") * HYBRID_WEIGHTS["recency"]
    if moment is not None:
        ctx = stage(skew.spread(active, "item_id").select("item_id", context_score(moment, moment.vector(items.sparkSession, long=False)).alias("context")), "context")
        rows = rows.join(_catalogue_minmax(ctx, "context"), "item_id")
        total = total + F.col("context") * HYBRID_WEIGHTS["context"]
    return stage(rows.select("item_id", total.alias("score")), "catalogue")


def personal_scores(user_cf: DataFrame, item_cf: DataFrame, active: DataFrame) -> DataFrame:
    """(user_id, item_id, score): weighted sum of both CF scores, each min-maxed per user over active items."""
    parts = {
        name: scoring.normalise(df.join(active, "item_id", "left_semi"), "minmax")
        for name, df in (("user_cf", user_cf), ("item_cf", item_cf))
    }
    return scoring.blend(parts, HYBRID_WEIGHTS, "sum")


# --- hybrid -----------------------------------------------------------------------------------


def hybrid(users: DataFrame, personal: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """Top k per user of personal + catalogue score; missing parts count 0.

    Personal scores are never negative, so an item without one loses to every item with a
    higher catalogue score: beyond the user's own rows only the first k places matter.
    """
    own = personal.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "item_id", "score")
    head = catalogue.orderBy(F.desc(F.round("score", 10)), F.asc("item_id")).limit(k).agg(F.collect_list("item_id").alias("l"))
    fill = users.select("user_id", F.explode(head.scalar()).alias("item_id"), F.lit(0.0).alias("score"))
    sums = own.unionByName(fill).groupBy("user_id", "item_id").agg(F.sum("score").alias("p"))
    rows = sums.join(catalogue, "item_id").select("user_id", "item_id", (F.col("p") + F.col("score")).alias("score"))
    return scoring.top_k(rows, k)


def diversified(recs: DataFrame, items: DataFrame, lam: float = 0.5) -> DataFrame:
    """The list in MMR order (category or embedding similarity) instead of score order."""
    meta = items.select("item_id", "category", "embedding")
    packed = rerank.pack(recs.select("user_id", "item_id", "score").join(meta, "item_id"), "category", "embedding")
    return rerank.rerank(packed, "mmr_signed", lam=lam).withColumnRenamed("place", "rank")


def finish(recs: DataFrame, items: DataFrame, min_score: float = 0.0, limit: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Score floor, exclusions, new ranks, item names and reasons."""
    rows = recs.filter(F.col("score") >= min_score).select("user_id", "item_id", "score")
    if exclude is not None:
        rows = rows.join(exclude.select("item_id"), "item_id", "left_anti")
    ranked = scoring.top_k(rows, limit if limit is not None else 2**31 - 1)
    named = ranked.join(items.select("item_id", "item_code", "item_name", "category", "item_type", "is_premium"), "item_id")
    return named.withColumn("reason", text.score_band_reason(F.col("score"), F.col("category"))).withColumn("score", F.round("score", 4))


def with_suggestions(recs: DataFrame) -> DataFrame:
    """Suggestion type and text of every recommendation."""
    kind = text.suggestion_type(F.col("rank"), F.col("score"), F.col("user_id"), F.col("item_id"))
    typed = recs.withColumn("type", kind)
    return typed.withColumn("content", text.suggestion_text(F.col("type"), F.col("item_id")))


# --- temporal ---------------------------------------------------------------------------------


def recent_use(events: DataFrame, active: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Decayed age of the latest use per (user, item), min-maxed per user (constant: 1)."""
    seen = events.filter(F.col("item_id").isNotNull() & tf.since("event_time", as_of, days=LOOKBACK_DAYS))
    last = seen.groupBy("user_id", "item_id").agg(F.max("event_time").alias("last")).join(active, "item_id", "left_semi")
    decayed = last.select("user_id", "item_id", tf.hour_decay(F.col("last"), tf.as_ts(as_of), RECENCY_HOURS).alias("score"))
    return scoring.normalise(decayed, "minmax_one")


def _pack_scores(scores: DataFrame, name: str, item_tile: Column) -> DataFrame:
    """Per user and tile of items: the items with a score and the scores, in the same order."""
    entry = F.collect_list(F.struct("item_id", F.col("score").alias("v"))).alias("e")
    packed = scores.groupBy("user_id", item_tile.alias("ti")).agg(entry)
    return packed.select("user_id", "ti", F.col("e")["item_id"].alias(f"{name}_ids"), F.col("e")["v"].alias(f"{name}_values"))


def _cold_list(cold: DataFrame, catalogue: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """The same k items for every user without patterns and scores: only the catalogue part differs between items."""
    rounded = catalogue.select("item_id", F.round("score", 12).alias("score"))
    lo, hi = rounded.agg(F.min("score"), F.max("score")).first()
    unit = F.lit(1.0) if lo == hi else (F.col("score") - F.lit(lo)) / F.lit(hi - lo)
    scored = rounded.select("item_id", (weights["base"] * unit + weights["affinity"]).alias("score"))
    best = F.array_sort(F.collect_list(F.struct((-F.round("score", 10)).alias("o"), "item_id", "score"))).alias("l")
    head = scored.orderBy(F.desc(F.round("score", 10)), F.asc("item_id")).limit(k).agg(best)
    return cold.withColumn("l", head.scalar()).select("user_id", F.explode("l").alias("e")).select("user_id", "e.item_id", "e.score")


def _telling(catalogue: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """The items that decide a user's extremes and best k: those in `used`, and of the others the first k and the last.

    The others have the same time match and no recent use for any user, so they rank by their catalogue score, whoever
    asks. Scores that only differ behind the tenth decimal rank by id: near the k-th one every value gives its first k.
    """
    used = used.select("item_id").distinct()
    known = catalogue.join(used, "item_id", "left_semi")
    plain = stage(catalogue.join(used, "item_id", "left_anti").withColumn("_v", F.round("score", 12)), "plain-items")
    head = plain.orderBy(F.desc("_v"), "item_id").limit(k)
    last = head.agg(F.min("_v")).first()[0]
    if last is None:  # every item is in use
        return stage(known, "telling-items")
    near = skew.rank_rows(plain.filter(F.col("_v") >= last - SAME_SCORE), ["_v"], [F.asc("item_id")], k, "_r").drop("_r")
    tail = plain.orderBy("_v", "item_id").limit(1)
    few = near.unionByName(tail).dropDuplicates(["item_id"])
    return stage(known.unionByName(few.select(*catalogue.columns)), "telling-items")


def temporal_scores(
    users: DataFrame,
    personal: DataFrame,
    catalogue: DataFrame,
    recent: DataFrame,
    user_patterns: DataFrame,
    item_patterns: DataFrame,
    moment: Moment,
    k: int,
) -> DataFrame:
    """Top k of 0.3 base + 0.4 time match + 0.3 recent use, boosted near the user's peak hour.

    Base and time match are min-maxed per user over all active items. Items without pattern and score count by
    their few telling ones. Users and the other items are dealt into tiles; a first pass returns each user's extremes per tile,
    a second the best k per tile. No (user, item) row beyond those leaves a task. Users without any
    pattern or score share one list and take no part in the tiles.
    """
    pat = user_patterns.select("user_id", "hour_shares", "weekday_shares", "peak_hour")
    known = [df.select("user_id") for df in (pat, personal, recent)]
    warm = stage(users.select("user_id").join(known[0].unionByName(known[1]).unionByName(known[2]), "user_id", "left_semi"), "warm-users")
    cold = users.select("user_id").join(warm.distinct(), "user_id", "left_anti")
    used = [df.select("item_id") for df in (item_patterns, personal, recent)]
    telling = _telling(catalogue, used[0].unionByName(used[1]).unionByName(used[2]), k)
    tu, ti = (max(1, -(-df.count() // TILE)) for df in (warm, telling))
    cat = telling.join(item_patterns.select("item_id", "hour_shares", "weekday_shares"), "item_id", "left")
    user_tile, item_tile = F.pmod(F.xxhash64("user_id"), F.lit(tu)).cast("int"), F.pmod(F.xxhash64("item_id"), F.lit(ti)).cast("int")
    tiled = warm.join(pat, "user_id", "left").select("*", user_tile.alias("tu"), F.explode(F.sequence(F.lit(0), F.lit(ti - 1))).alias("ti"))
    for scores, name in ((personal, "base"), (recent, "recent")):  # a tile gets the scores of its own items only
        tiled = tiled.join(_pack_scores(scores, name, item_tile), ["user_id", "ti"], "left")
    side_u = stage(tiled, "temporal-users")
    side_i = stage(cat, "temporal-items").select("*", item_tile.alias("ti"), F.explode(F.sequence(F.lit(0), F.lit(tu - 1))).alias("tu"))
    user_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((users, "user_id"), (catalogue, "item_id")))
    hour, weights = moment.hour, TEMPORAL_WEIGHTS

    def extremes(u: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        names = ["user_id", "b0", "b1", "a0", "a1"]
        if u.empty or i.empty:
            return pd.DataFrame({c: [] for c in names})
        base, aff, _ = _cells(u, i, hour)
        cols = [u["user_id"], base.min(1), base.max(1), aff.min(1), aff.max(1)]
        return pd.DataFrame(dict(zip(names, cols)))

    groups = lambda a, b: a.groupBy("tu", "ti").cogroup(b.groupBy("tu", "ti"))
    edges = groups(side_u, side_i).applyInPandas(extremes, f"user_id {user_type}, b0 double, b1 double, a0 double, a1 double")
    edges = edges.groupBy("user_id").agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("a1").alias("a1"))

    def best(u: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if u.empty or i.empty:
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []})
        i = i.sort_values("item_id").reset_index(drop=True)
        base, aff, recent_cells = _cells(u, i, hour)
        b0, b1, a0, a1 = (u[c].to_numpy()[:, None] for c in ("b0", "b1", "a0", "a1"))
        unit = lambda x, lo, hi: np.where(hi == lo, 1.0, (x - lo) / np.where(hi == lo, 1.0, hi - lo))
        score = weights["base"] * unit(base, b0, b1) + weights["affinity"] * unit(aff, a0, a1) + weights["recency"] * recent_cells
        gap = _peak_distance(u, hour)
        score *= np.where(gap <= 2, np.maximum(1.0, PEAK_BOOST * (1 - gap / 3)), 1.0)[:, None]
        order = np.argsort(-np.round(score, 10), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(u)), order.shape[1])
        cols = order.ravel()
        return pd.DataFrame({"user_id": u["user_id"].to_numpy()[rows], "item_id": i["item_id"].to_numpy()[cols], "score": score[rows, cols]})

    ready = side_u.join(edges, "user_id")
    found = groups(ready, side_i).applyInPandas(best, f"user_id {user_type}, item_id {item_type}, score double")
    return scoring.top_k(found.unionByName(_cold_list(cold, catalogue, weights, k)), k)


def _peak_distance(u: pd.DataFrame, hour: int) -> np.ndarray:
    gap = np.abs(u["peak_hour"].to_numpy(dtype=float) - hour)
    return np.where(np.isnan(gap), 99.0, np.minimum(gap, 24 - gap))


def _stack(column: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors, and which rows have one."""
    have = column.notna().to_numpy()
    out = np.zeros((len(column), size))
    if have.any():
        out[have] = np.stack(column[have].to_numpy())
        out[have] /= np.linalg.norm(out[have], axis=1)[:, None]
    return out, have


def _cells(u: pd.DataFrame, i: pd.DataFrame, hour: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base score, time match and recent use of each user (row) for each item (column)."""
    base = np.tile(i["score"].to_numpy(), (len(u), 1))
    recent = np.zeros_like(base)
    items = i["item_id"].to_numpy()
    by_id = np.argsort(items, kind="stable")
    for cells, name in ((base, "base"), (recent, "recent")):
        have = np.flatnonzero(u[f"{name}_ids"].notna().to_numpy())
        if not len(have):
            continue
        ids = [u[f"{name}_ids"].iloc[r] for r in have]
        row, column = np.repeat(have, [len(x) for x in ids]), np.concatenate(ids)
        at = by_id[np.minimum(np.searchsorted(items, column, sorter=by_id), len(items) - 1)]
        known = items[at] == column
        values = np.concatenate([u[f"{name}_values"].iloc[r] for r in have])
        np.add.at(cells, (row[known], at[known]), values[known])
    (uh, have_u), (ih, have_i) = _stack(u["hour_shares"], 24), _stack(i["hour_shares"], 24)
    (ud, _), (idw, _) = _stack(u["weekday_shares"], 7), _stack(i["weekday_shares"], 7)
    aff = 0.7 * (uh @ ih.T + 1) / 2 + 0.3 * (ud @ idw.T + 1) / 2
    gap = _peak_distance(u, hour)
    aff *= np.where(gap <= 2, 1 - gap / 3 * 0.2, 1.0)[:, None]
    known = have_u[:, None] & have_i[None, :]
    return np.round(base, 12), np.round(np.where(known, np.clip(aff, 0, 1), 0.5), 12), recent


def temporal_reasons(recs: DataFrame, user_patterns: DataFrame, events: DataFrame, moment: Moment, lang: str = "en") -> DataFrame:
    last = events.groupBy("user_id", "item_id").agg(F.max("event_time").alias("last"))
    rows = recs.join(user_patterns.select("user_id", "peak_hour"), "user_id", "left").join(last, ["user_id", "item_id"], "left")
    gap = tf.circular_hours(F.lit(moment.hour), F.col("peak_hour"))
    recent = tf.seconds_between(F.col("last"), moment.ts) < 24 * 3600
    reason = text.temporal_reason(gap, tf.time_of_day(F.lit(moment.hour)), recent, lang)
    return rows.withColumn("reason", reason).drop("peak_hour", "last")


# --- layout slots -------------------------------------------------------------------------------


def context_fit(moment: Moment) -> Column:
    """How well an item suits the moment, from 0.5 by rules."""
    when, cat = tf.time_of_day(F.hour(moment.ts)), F.col("category")
    time_part = (
        F.when((when == "morning") & (cat == "paraphrasing"), 0.25)
        .when(when.isin("afternoon", "evening") & (cat == "creative"), 0.20)
        .when((when == "night") & (cat == "grammar"), 0.15)
        .otherwise(0.0)
    )
    premium = F.when(tf.is_business_hours(moment.ts) & F.col("is_premium"), 0.10).otherwise(0.0)
    tool = (
        F.when((moment.device == "mobile") & (F.col("item_type") == "quick_tool"), 0.15)
        .when((moment.device == "desktop") & (F.col("item_type") == "advanced_tool"), 0.15)
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + time_part + premium + tool))


def layout_scores(
    base: DataFrame, items: DataFrame, features: DataFrame, events: DataFrame, moment: Moment, slot: str, user_vectors: DataFrame | None = None
) -> DataFrame:
    """(user_id, item_id, score, uses) of the candidates for a slot."""
    uses = events.filter(F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("uses"))
    bonus = recency_score(features).withColumn("recency", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("recency"))))
    context = moment.vector(items.sparkSession, long=True)
    known = items.join(bonus, "item_id", "left").select("*", context_fit(moment).alias("fit"))
    if "created_at" in items.columns:  # an item without feature row is judged by its age
        days = F.floor((F.unix_timestamp(moment.ts) - F.unix_timestamp("created_at")) / 86_400)
        young = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - RECENCY_LOSS_PER_DAY * days))
        known = known.withColumn("recency", F.coalesce("recency", young)).drop("created_at")
    if user_vectors is None:
        # Without user vectors the match with the context is one value per item.
        known = skew.spread(known, "item_id").withColumn("match", vectors.cosine(F.col("embedding"), context, "unit")).drop("embedding")
    rows = base.select("user_id", "item_id", "score").join(known, "item_id").join(uses, ["user_id", "item_id"], "left")
    if user_vectors is not None:
        rows = rows.join(user_vectors.select("user_id", F.col("embedding").alias("user_vec")), "user_id", "left")
        rows = rows.withColumn("match", vectors.cosine(F.col("embedding"), vectors.fuse(F.col("user_vec"), context), "unit"))
    parts = {
        "base": F.col("score"),
        "fit": F.col("fit"),
        "affinity": F.least(F.coalesce("uses", F.lit(0)) / 10.0, F.lit(1.0)) * 0.5 + 0.5,
        "recency": F.coalesce("recency", F.lit(0.0)),
        "embedding": F.coalesce("match", F.lit(0.0)),
    }
    total = sum((parts[n] * w for n, w in LAYOUT_WEIGHTS.items()), F.lit(0.0)) * SLOT_WEIGHTS.get(slot, 1.0)
    return rows.select("user_id", "item_id", total.alias("score"), F.coalesce("uses", F.lit(0)).alias("uses"))


def layout(
    scored: DataFrame, items: DataFrame, features: DataFrame, moment: Moment, positions: int = 6, use_mmr: bool = True, lam: float = 0.5,
    lang: str = "en",
) -> DataFrame:
    """The slots of each user: rank, score 1 - 0.1 (rank - 1), reason."""
    meta = items.select("item_id", "category", "embedding")
    packed = rerank.pack(scored.select("user_id", "item_id", "score").join(meta, "item_id"), "category", "embedding")
    placed = rerank.rerank(packed, "mmr" if use_mmr else "category_gap", limit=positions, lam=lam)
    rows = placed.select("user_id", "item_id", F.col("place").alias("rank"), (F.lit(1.0) - (F.col("place") - 1) * 0.1).alias("score"))
    rows = rows.join(scored.select("user_id", "item_id", "uses"), ["user_id", "item_id"]).join(items.select("item_id", "category"), "item_id")
    rows = rows.join(features.select("item_id", "popularity_score"), "item_id", "left")
    reason = text.ambient_reason(
        F.col("category"), tf.time_of_day(F.hour(moment.ts)), moment.device, F.coalesce("popularity_score", F.lit(0.0)), F.col("uses"), lang
    )
    return rows.select("user_id", "item_id", "rank", "score", reason.alias("reason"))


def needs_refresh(users: DataFrame, layouts: DataFrame, events: DataFrame, as_of: str = AS_OF, hours: int = 6, clicks: int = 5) -> DataFrame:
    """Users whose layout is missing, older than `hours`, or followed by enough events.

    `layouts` has (user_id, built_at). Events join their user's one layout row, are counted
    on the map side and only then leave the task.
    """
    now = tf.as_ts(as_of)
    later = events.select("user_id", "event_time").join(layouts, "user_id").filter(
        (F.col("event_time") > F.col("built_at")) & (F.col("event_time") <= now)
    )
    since = later.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"))
    rows = users.select("user_id").join(layouts, "user_id", "left").join(since, "user_id", "left")
    n = F.coalesce("clicks", F.lit(0))
    old = tf.seconds_between(F.col("built_at"), now) > hours * 3600
    return rows.select("user_id", "built_at", n.alias("clicks"), (F.col("built_at").isNull() | old | (n >= clicks)).alias("refresh"))


def item_cf_neighbours(weights: DataFrame, k: int = 20) -> DataFrame:
    return cf.item_neighbours(cf.mirrored(cf.item_similarity(weights)), k)


def patterns(events: DataFrame, as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    known = events.filter(F.col("item_id").isNotNull())
    return temporal.temporal_patterns(events, "user_id", as_of, LOOKBACK_DAYS), temporal.temporal_patterns(known, "item_id", as_of, LOOKBACK_DAYS)
