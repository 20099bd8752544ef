"""Cosine variants, context vectors and embedding fusion on array columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timefn as tf

# Slots of the context vectors. Slot names follow the vocabulary that
# the context functions emit ("dawn", "mac").
TIME_SLOTS = ["dawn", "morning", "afternoon", "evening", "night"]
SHORT_DEVICES = ["mac", "desktop", "tablet"]
LONG_DEVICES = ["mac", "desktop", "tablet", "unknown"]
EMBEDDING_SIZE = 128
USER_SHARE = 0.7


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` evaluated once per row, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum_products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _cosine_rows(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of each pair of vectors over the shorter prefix; NaN where there is none."""
    out = np.full(len(a), np.nan)
    sizes = np.array([min(len(x), len(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)])
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = np.stack([np.asarray(a.iat[r][:size], dtype=float) for r in rows])
        y = np.stack([np.asarray(b.iat[r][:size], dtype=float) for r in rows])
        norm = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        ok = norm > 0
        out[rows[ok]] = np.clip(np.einsum("ij,ij->i", x, y)[ok] / norm[ok], -1.0, 1.0)
    return pd.Series(out)


def cosine(a: Column, b: Column, mode: str = "raw") -> Column:
    """Cosine over the shorter prefix; null when a vector is missing or has no length.

    mode "raw" is [-1, 1], "clip" cuts negatives to 0, "unit" maps to [0, 1]. Vectors go
    through Arrow in batches: array functions would handle every element on its own. Rows without `a` send no `b` (a literal is
    sent with every row).
    """
    values = F.pandas_udf(_cosine_rows, "double")(a, F.when(a.isNotNull(), b))
    if mode == "raw":
        return F.nanvl(values, F.lit(None).cast("double"))
    if mode == "clip":
        return F.when(values < 0, 0.0).otherwise(F.nanvl(values, F.lit(None).cast("double")))
    return F.nanvl((values + 1.0) / 2.0, F.lit(None).cast("double"))


def unit_length(vec: Column) -> Column:
    def scaled(v: Column) -> Column:
        return let(F.sqrt(_sum_products(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return let(vec, scaled)


def _hot(value: Column, slots: list[str]) -> list[Column]:
    return [F.coalesce((value == s).cast("double"), F.lit(0.0)) for s in slots]


def short_context_vector(ts: Column, device: Column) -> Column:
    """9 slots: time of day, business hours, device."""
    parts = [*_hot(tf.time_of_day(F.hour(ts)), TIME_SLOTS), tf.is_business_hours(ts).cast("double"), *_hot(device, SHORT_DEVICES)]
    return unit_length(F.array(*parts))


def long_context_vector(ts: Column, device: Column, size: int = EMBEDDING_SIZE) -> Column:
    """18 slots (time of day, weekday, business hours, device, weekend) padded to `size`."""
    parts = [
        *_hot(tf.time_of_day(F.hour(ts)), TIME_SLOTS),
        *[(F.weekday(ts) == d).cast("double") for d in range(7)],
        tf.is_business_hours(ts).cast("double"),
        *_hot(device, LONG_DEVICES),
        tf.is_weekend(ts).cast("double"),
    ]
    return unit_length(pad(F.array(*parts), size))


def pad(vec: Column, size: int) -> Column:
    """Cut or fill with zeros to `size`."""
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), size)), 1, size)


def fuse(user_vec: Column, context_vec: Column, size: int = EMBEDDING_SIZE, user_share: float = USER_SHARE) -> Column:
    """user_share * user + (1 - user_share) * context on the common prefix; the context alone without a user vector."""
    n = F.least(F.size(user_vec), F.size(context_vec), F.lit(size))
    mixed = F.zip_with(
        F.slice(user_vec, F.lit(1), n),
        F.slice(context_vec, F.lit(1), n),
        lambda u, c: u.cast("double") * user_share + c * (1 - user_share),
    )
    return F.when(user_vec.isNotNull() & (F.size(user_vec) > 0), pad(mixed, size)).otherwise(context_vec)


def item_similarity(emb_a: Column, emb_b: Column, category_a: Column, category_b: Column) -> Column:
    """Cosine cut to [0, 1]; without usable embeddings 1 for equal categories, else 0."""
    same = F.coalesce((category_a == category_b).cast("double"), F.lit(0.0))
    return F.coalesce(cosine(emb_a, emb_b, "clip"), same)


def nearest(df: DataFrame, query: list[float], k: int, exclude: list | None = None, id_column: str = "item_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to a query vector; the vector is a literal and the cut a top-n, so nothing is shuffled."""
    rows = df.filter(F.col(vector).isNotNull())
    if exclude:
        rows = rows.filter(~F.col(id_column).isin(exclude))
    scored = rows.select(id_column, cosine(F.col(vector), F.lit(query)).alias("sim")).filter("sim IS NOT NULL")
    return scored.orderBy(F.desc(F.round("sim", 10)), F.asc(id_column)).limit(k)
