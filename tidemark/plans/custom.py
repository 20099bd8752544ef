"""Recommendations by a scorer of one's own: the steps around it are the same for every scorer."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from tidemark.operators import scoring
from tidemark.plans import contextual

# (weights, items, context) -> rows with user_id, item_id and score
Scorer = Callable[[DataFrame, DataFrame, Mapping[str, object]], DataFrame]
SCORED = ("user_id", "item_id", "score")


def recommend(
    scorer: Scorer,
    weights: DataFrame,
    items: DataFrame,
    context: Mapping[str, object] | None = None,
    k: int = 10,
    min_score: float = 0.0,
    users: DataFrame | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Best k items per user of a scorer's rows: user_id, item_id, score, rank, the item's columns and a reason.

    Only users with weights (and in `users`, if given), items of `items` that the user has none of, and none of `exclude`
    can be recommended, whatever the scorer returns; a missing score is none. Several rows of one user and item count with
    their sum. The scorer decides how many rows there are: it should return candidates, not every user with every item.
    """
    made = scorer(weights, items, dict(context or {}))
    missing = [c for c in SCORED if c not in made.columns]
    if missing:
        raise ValueError(f"the scorer's rows lack {missing}")
    known = weights if users is None else weights.join(users.select("user_id"), "user_id", "left_semi")
    rows = made.select(*SCORED).filter("score IS NOT NULL").groupBy("user_id", "item_id").agg({"score": "sum"}).toDF(*SCORED)
    rows = rows.join(known.select("user_id"), "user_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")
    rows = rows.join(weights.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return contextual.finish(rows, items, min_score, k, exclude)


def blend_of(scorers: Mapping[str, Scorer], shares: Mapping[str, float]) -> Scorer:
    """A scorer that adds up several ones, each min-maxed per user and weighted by its share."""

    def scorer(weights: DataFrame, items: DataFrame, context: Mapping[str, object]) -> DataFrame:
        parts = {name: scoring.normalise(one(weights, items, context).select(*SCORED), "minmax") for name, one in scorers.items()}
        return scoring.blend(parts, dict(shares), "sum")

    return scorer
