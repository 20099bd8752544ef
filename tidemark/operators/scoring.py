"""Score algebra on (key, item_id, score) rows; the key is usually user_id.

Ranks order by score descending, then item_id ascending, everywhere in the engine.
A key holds at most one row per catalogue item, which bounds its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "user_id"


def _w(key: str) -> W:
    return W.partitionBy(key)


def _order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("item_id")]


def minmax(score: Column, w, constant: float = 0.5) -> Column:
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(constant)).otherwise((score - lo) / (hi - lo))


def zscore(score: Column, w) -> Column:
    sd = F.stddev_pop(score).over(w)
    return F.when(sd > 0, (score - F.avg(score).over(w)) / sd).otherwise(0.0)


def sigmoid(score: Column, w) -> Column:
    return 1.0 / (1.0 + F.exp(-zscore(score, w)))


def softmax(score: Column, w) -> Column:
    return F.exp(score - F.max(score).over(w))


# Registry of per-key normalisations; softmax and rank need a second step, see `normalise`.
NORMALISATIONS: dict[str, Callable[[Column, object], Column]] = {
    "minmax": minmax,
    "minmax_one": lambda s, w: minmax(s, w, 1.0),
    "zscore": zscore,
    "sigmoid": sigmoid,
}


def normalise(scores: DataFrame, method: str = "minmax", key: str = KEY, clip: tuple[float, float] | None = None) -> DataFrame:
    """Rewrites `score` per key."""
    w = _w(key)
    if method == "softmax":
        raised = scores.withColumn("score", softmax(F.col("score"), w))
        out = raised.withColumn("score", F.col("score") / F.sum("score").over(w))
    elif method == "rank":
        place = F.row_number().over(w.orderBy("score", F.desc("item_id")))
        out = scores.withColumn("score", place / F.count(F.lit(1)).over(w))
    elif method in NORMALISATIONS:
        out = scores.withColumn("score", NORMALISATIONS[method](F.col("score"), w))
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    if clip:
        out = out.withColumn("score", F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), F.col("score"))))
    return out


def normalised_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights scaled to sum to 1; an all-zero set stays as it is."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(weights)


def _tagged(sources: Mapping[str, DataFrame], weights: Mapping[str, float], key: str) -> DataFrame:
    parts = [
        df.select(key, "item_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score"), F.lit(float(weights[name])).alias("w"))
        for name, df in sources.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blend(sources: Mapping[str, DataFrame], weights: Mapping[str, float], method: str = "weighted", key: str = KEY, rrf_k: int = 60) -> DataFrame:
    """One score per (key, item) out of several sources.

    weighted: average over the sources that have the item; sum: missing counts 0;
    rrf: reciprocal rank fusion; borda: weighted places from the bottom.
    """
    rows = _tagged(sources, normalised_weights(weights) if method == "weighted" else weights, key)
    s, w = F.col("score"), F.col("w")
    if method == "weighted":
        value = F.sum(w * s) / F.sum("w")
    elif method == "sum":
        value = F.sum(w * s)
    elif method in ("rrf", "borda"):
        win = W.partitionBy(key, "source")
        rows = rows.withColumn("place", F.row_number().over(win.orderBy(*_order())))
        if method == "rrf":
            value = F.sum(w / (F.lit(rrf_k) + F.col("place")))
        else:
            rows = rows.withColumn("size", F.count(F.lit(1)).over(win))
            value = F.sum(w * (F.col("size") - F.col("place") + 1))
    else:
        raise ValueError(f"unknown blend {method!r}")
    return rows.groupBy(key, "item_id").agg(value.alias("score"))


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "exp": lambda s, scale=1.0: F.exp(s * scale),
    "log": lambda s, scale=1.0: F.log1p(s * scale),
    "power": lambda s, exponent=2.0: F.pow(s, F.lit(exponent)),
    "threshold": lambda s, threshold=0.5: F.when(s >= threshold, s).otherwise(0.0),
}


def transform(scores: DataFrame, name: str, **options: float) -> DataFrame:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transformation {name!r}")
    return scores.withColumn("score", TRANSFORMS[name](F.col("score"), **options))


def filter_scores(
    scores: DataFrame,
    min_score: float | None = None,
    max_score: float | None = None,
    top_k: int | None = None,
    min_count: int | None = None,
    key: str = KEY,
) -> DataFrame:
    """Score range and top-k per key; keys left with fewer than `min_count` rows get their
    unfiltered best `min_count` back."""
    ok = F.lit(True)
    if min_score is not None:
        ok = ok & (F.col("score") >= min_score)
    if max_score is not None:
        ok = ok & (F.col("score") <= max_score)
    w = _w(key)
    rows = scores.withColumn("_ok", ok)
    rows = rows.withColumn("_place", F.row_number().over(w.orderBy(F.desc("_ok"), *_order())))
    if top_k is not None:
        rows = rows.withColumn("_ok", F.col("_ok") & (F.col("_place") <= top_k))
    keep = F.col("_ok")
    if min_count is not None:
        rows = rows.withColumn("_left", F.count_if(F.col("_ok")).over(w)).withColumn("_best", F.row_number().over(w.orderBy(*_order())))
        keep = F.when(F.col("_left") < min_count, F.col("_best") <= min_count).otherwise(F.col("_ok"))
    return rows.filter(keep).select(*scores.columns)


def statistics(scores: DataFrame, key: str = KEY) -> DataFrame:
    q = F.percentile("score", [0.25, 0.5, 0.75])
    out = scores.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        q.alias("_q"),
    )
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(["q25", "median", "q75"])]).drop("_q")


def top_k(scores: DataFrame, k: int, key: str = KEY, out: str = "rank") -> DataFrame:
    """Best k per key with a 1-based rank; the planner cuts to k per task before the shuffle.

    Scores are compared at 10 decimals, so sums added up in another order rank alike.
    """
    order = [F.desc(F.round("score", 10)), F.asc("item_id")]
    return scores.withColumn(out, F.row_number().over(_w(key).orderBy(*order))).filter(F.col(out) <= k)
