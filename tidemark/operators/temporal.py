"""Hour and weekday patterns of users and items, and how well they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timefn as tf
from tidemark.session import AS_OF


def _cells(events: DataFrame, key: str) -> DataFrame:
    # At most 24 x 7 cells per key: everything below works on these counts.
    return events.groupBy(key, F.hour("event_time").alias("hour"), F.weekday("event_time").alias("dow")).agg(
        F.count(F.lit(1)).alias("n")
    )


def temporal_patterns(events: DataFrame, key: str, as_of: str = AS_OF, lookback_days: int = 90) -> DataFrame:
    """Shares per hour (24 slots) and weekday (7 slots), peaks and day-part ratios per key.

    `business_hours_ratio` is the weekday 9-18 share. `business_hours_ratio_legacy`
    keeps the other definition in use, which only looks at the weekday.
    """
    cells = _cells(events.filter(tf.since("event_time", as_of, days=lookback_days)), key)
    n, hour, dow = F.col("n"), F.col("hour"), F.col("dow")
    total = F.sum("n")
    hour_n = [F.sum(F.when(hour == h, n).otherwise(0)) for h in range(24)]
    dow_n = [F.sum(F.when(dow == d, n).otherwise(0)) for d in range(7)]

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0)) / total

    wide = cells.groupBy(key).agg(
        total.alias("total"),
        F.array(*hour_n).alias("hn"),
        F.array(*dow_n).alias("dn"),
        share((hour >= 6) & (hour < 12)).alias("morning_ratio"),
        share((hour >= 12) & (hour < 18)).alias("afternoon_ratio"),
        share((hour >= 18) & (hour < 22)).alias("evening_ratio"),
        share((hour >= 22) | (hour < 6)).alias("night_ratio"),
        share(dow < 5).alias("weekday_ratio"),
        share(dow >= 5).alias("weekend_ratio"),
        share((hour >= 9) & (hour < 18) & (dow < 5)).alias("business_hours_ratio"),
    )
    return wide.select(
        key,
        "total",
        F.transform("hn", lambda x: x / F.col("total")).alias("hour_shares"),
        F.transform("dn", lambda x: x / F.col("total")).alias("weekday_shares"),
        (F.array_position("hn", F.array_max("hn")) - 1).cast("int").alias("peak_hour"),
        (F.array_position("dn", F.array_max("dn")) - 1).cast("int").alias("peak_weekday"),
        "morning_ratio",
        "afternoon_ratio",
        "evening_ratio",
        "night_ratio",
        "weekday_ratio",
        "weekend_ratio",
        "business_hours_ratio",
        F.col("weekday_ratio").alias("business_hours_ratio_legacy"),
    )


def share_map(shares: Column) -> Column:
    """Map slot -> share with the empty slots left out."""
    slots = F.transform(shares, lambda x, i: F.struct(i.alias("slot"), x.alias("share")))
    return F.map_from_entries(F.filter(slots, lambda e: e["share"] > 0))


def _dot(a: Column, b: Column, size: int) -> Column:
    # The sizes are fixed (24 hours, 7 days), so plain arithmetic stays inside generated code.
    out = a[0] * b[0]
    for i in range(1, size):
        out = out + a[i] * b[i]
    return out


def _with_lengths(patterns: DataFrame, key: str, prefix: str) -> DataFrame:
    h, d = F.col("hour_shares"), F.col("weekday_shares")
    return patterns.select(
        key,
        h.alias(f"{prefix}h"),
        d.alias(f"{prefix}d"),
        F.sqrt(_dot(h, h, 24)).alias(f"{prefix}hn"),
        F.sqrt(_dot(d, d, 7)).alias(f"{prefix}dn"),
        F.col("peak_hour").alias(f"{prefix}_peak"),
    )


def pair_affinity(pairs: DataFrame, user_patterns: DataFrame, item_patterns: DataFrame, now_hour: int | None) -> DataFrame:
    """Affinity of given (user_id, item_id) pairs.

    0.7 hour match + 0.3 weekday match, each (cosine + 1) / 2; 0.5 when either side has no
    history. Near the user's peak hour the value is scaled by 1 - 0.2 * distance / 3, so
    that adjustment can only lower it.
    """
    u, i = _with_lengths(user_patterns, "user_id", "u"), _with_lengths(item_patterns, "item_id", "i")
    joined = pairs.join(u, "user_id", "left").join(i, "item_id", "left")
    c = F.col
    hours = (_dot(c("uh"), c("ih"), 24) / (c("uhn") * c("ihn")) + 1.0) / 2.0
    days = (_dot(c("ud"), c("id"), 7) / (c("udn") * c("idn")) + 1.0) / 2.0
    scored = joined.select(*pairs.columns, "u_peak", (0.7 * hours + 0.3 * days).alias("_base"))
    value = c("_base")
    if now_hour is not None:
        dist = tf.circular_hours(F.lit(now_hour), c("u_peak"))
        value = value * F.when(dist <= 2, 1.0 - dist / 3.0 * 0.2).otherwise(1.0)
    return scored.select(*pairs.columns, F.when(c("_base").isNull(), 0.5).otherwise(F.least(F.lit(1.0), value)).alias("affinity"))
