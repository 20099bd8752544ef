"""Per-user and per-item feature tables, computed for all entities in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.functions.stage import global_places
from tidemark.session import AS_OF

RUN, SELECT, COPY = "run", "select", "copy"


def name_has(part: str) -> Column:
    return F.contains(F.lower("event_name"), F.lit(part))


def _mix(total: Column) -> Column:
    """Weighted share of run, select and copy events."""
    weighted = F.col("runs") * 1.0 + F.col("selects") * 1.5 + F.col("copies") * 2.0
    return weighted / F.greatest(total, F.lit(1))


def user_features(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    now = tf.as_ts(as_of)
    base = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(tf.since("event_time", as_of, days=7)).alias("last_7d_count"),
        F.count_if(tf.since("event_time", as_of, days=30)).alias("last_30d_count"),
        F.count_if(name_has(RUN)).alias("runs"),
        F.count_if(name_has(SELECT)).alias("selects"),
        F.count_if(name_has(COPY)).alias("copies"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.avg("input_sentence_length").alias("avg_input_length"),
        tf.whole_days(F.min("event_time"), now).alias("days_since_first"),
        tf.whole_days(F.max("event_time"), now).alias("days_since_last"),
    )
    prefs = skew.modes(
        events,
        ["user_id"],
        {
            "preferred_tone": F.col("tone"),
            "preferred_maintenance": F.col("maintenance"),
            "preferred_language": F.col("target_language"),
            "most_active_hour": F.hour("event_time"),
            "most_active_weekday": F.weekday("event_time"),
            "primary_browser": F.col("browser"),
            "primary_os": F.col("os"),
            "primary_device": F.col("device_id"),
        },
        distinct=["preferred_tone", "preferred_maintenance"],
    )
    runs = F.greatest("runs", F.lit(1))
    return (
        base.join(prefs, "user_id")
        .withColumn("engagement_score", _mix(F.col("total_events")))
        .withColumn("exploration_score", (F.col("n_preferred_tone") + F.col("n_preferred_maintenance")) / F.lit(10.0))
        .withColumn("selections_per_run", F.col("selects") / runs)
        .withColumn("copy_rate", F.col("copies") / runs)
        .drop("runs", "selects", "copies", "n_preferred_tone", "n_preferred_maintenance")
    )


# Features that read 0 for users without events; all others stay null.
USER_DEFAULTS = {
    "total_events": 0,
    "last_7d_count": 0,
    "last_30d_count": 0,
    "engagement_score": 0.0,
    "exploration_score": 0.0,
    "selections_per_run": 0.0,
    "copy_rate": 0.0,
}


def user_feature_table(users: DataFrame, features: DataFrame) -> DataFrame:
    """A row for every user, with defaults where there are no events."""
    joined = users.select("user_id").join(features, "user_id", "left")
    return joined.fillna(USER_DEFAULTS)


def item_features(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Popularity, trend, quality, retention and peak times of every used item.

    Works on one row per (item, user), so distinct-user counts and retention need no
    further distinct aggregation and a popular item is pre-aggregated before it moves.
    """
    now = tf.as_ts(as_of)
    known = events.filter(F.col("item_id").isNotNull())
    pair = known.groupBy("item_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tf.since("event_time", as_of, days=7)).alias("n7"),
        F.count_if(tf.since("event_time", as_of, days=30)).alias("n30"),
        F.count_if(name_has(RUN)).alias("runs"),
        F.count_if(name_has(SELECT)).alias("selects"),
        F.count_if(name_has(COPY)).alias("copies"),
        F.count_if(name_has(SELECT) | name_has(COPY)).alias("wins"),
        F.sum("response_time_ms").alias("rt_sum"),
        F.count("response_time_ms").alias("rt_n"),
        F.max("event_time").alias("last"),
    )
    total = F.col("total_events")
    base = pair.groupBy("item_id").agg(
        F.sum("n").alias("total_events"),
        F.sum("runs").alias("runs"),
        F.sum("selects").alias("selects"),
        F.sum("copies").alias("copies"),
        F.sum("wins").alias("wins"),
        F.count(F.lit(1)).alias("unique_users"),
        F.count_if(F.col("n7") > 0).alias("unique_users_7d"),
        F.count_if(F.col("n30") > 0).alias("unique_users_30d"),
        F.sum("n7").alias("n7"),
        F.avg((F.col("n") > 1).cast("double")).alias("retention_rate"),
        (F.sum("rt_sum") / F.nullif(F.sum("rt_n"), F.lit(0))).alias("avg_response_time_ms"),
        F.max("last").alias("last"),
    )
    peaks = skew.modes(
        known, ["item_id"], {"peak_hour": F.hour("event_time"), "peak_weekday": F.weekday("event_time")}
    )
    success = F.col("wins") / F.greatest("runs", F.lit(1))
    avg_rt = F.col("avg_response_time_ms")
    time_score = F.when(avg_rt.isNull() | (avg_rt == 0), 0.5).otherwise(1.0 - F.least(avg_rt / 10000.0, F.lit(1.0)))
    return (
        base.join(peaks, "item_id")
        .withColumn("popularity_score", _mix(total))
        .withColumn("trending_score", F.col("n7") / F.greatest(total, F.lit(1)))
        .withColumn("freshness_score", F.lit(1.0) / (F.lit(1.0) + tf.whole_days(F.col("last"), now)))
        .withColumn("success_rate", success)
        .withColumn("quality_score", time_score * 0.3 + success * 0.7)
        .drop("n7", "last", "wins")
    )


def category_ranks(events: DataFrame, items: DataFrame) -> DataFrame:
    """Rank and percentile of active items by use within their category.

    One distributed sort by (category, use) numbers all items; a rank is the distance from
    the first place of the category, so a huge category is not ordered in one task.
    """
    uses = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("uses"))
    active = items.filter("is_active AND category IS NOT NULL").select("item_id", "category")
    counted = active.join(uses, "item_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    placed = global_places(counted, [F.asc("category"), F.desc("uses"), F.asc("item_id")], "category-places")
    firsts = placed.groupBy("category").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    rank = (F.col("place") - F.col("first") + 1).cast("int")
    return placed.join(firsts, "category").select(
        "item_id", "category", "uses", rank.alias("category_rank"), (F.lit(1.0) - (rank - 1) / F.col("size")).alias("category_percentile")
    )


def user_detail(events: DataFrame, items: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """On-demand profile: hour, weekday and category counts as maps, peaks, last-7-day count."""
    hours = _count_map(events, "user_id", F.hour("event_time"), "hour_counts", "peak_hour")
    days = _count_map(events, "user_id", F.weekday("event_time"), "weekday_counts", "peak_weekday")
    cats = category_preferences(events, items).groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts")
    )
    recent = events.groupBy("user_id").agg(F.count_if(tf.since("event_time", as_of, days=7)).alias("last_7d"))
    return recent.join(hours, "user_id").join(days, "user_id").join(cats, "user_id", "left")


def _count_map(events: DataFrame, key: str, value: Column, name: str, peak: str) -> DataFrame:
    counts = events.groupBy(key, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name),
        F.min(F.struct((-F.col("n")).alias("o"), "v")).getField("v").alias(peak),
    )


def category_preferences(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events per user and item category; counts per (user, item) are joined, not raw events."""
    pairs = events.filter(F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    known = items.filter(F.col("category").isNotNull()).select("item_id", "category")
    return pairs.join(known, "item_id").groupBy("user_id", "category").agg(F.sum("n").alias("n"))


def item_detail(events: DataFrame) -> DataFrame:
    pairs = events.filter(F.col("item_id").isNotNull()).groupBy("item_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("item_id").agg(
        F.sum("n").alias("interactions"),
        F.count(F.lit(1)).alias("unique_users"),
        F.round(F.sum("n") / F.count(F.lit(1)), 2).alias("per_user"),
    )


def cohort(users: DataFrame, features: DataFrame, max_idle_days: int, min_events: int, min_engagement: float) -> DataFrame:
    """Active users with enough events and engagement."""
    wanted = (
        (F.col("days_since_last") <= max_idle_days)
        & (F.col("total_events") >= min_events)
        & (F.col("engagement_score") >= min_engagement)
    )
    return users.select("user_id", "distinct_id").join(features.filter(wanted), "user_id")


def trending_items(items: DataFrame, features: DataFrame, k: int = 10) -> DataFrame:
    return (
        items.filter("is_active")
        .select("item_id", "item_name", "category")
        .join(features.select("item_id", "trending_score", "freshness_score"), "item_id")
        .orderBy(F.desc("trending_score"), "item_id")
        .limit(k)
    )


def adaptive_profiles(events: DataFrame, users: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Behaviour profile and segment of every user."""
    now = tf.as_ts(as_of)
    pairs = events.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    prof = pairs.groupBy("user_id").agg(
        F.sum("n").alias("events"),
        tf.whole_days(F.max("last"), now).alias("idle_days"),
        (F.count("item_id") / F.sum("n")).alias("diversity"),
        tf.whole_days(F.min("first"), now).alias("tenure_days"),
    )
    n, idle = F.col("events"), F.col("idle_days")
    segment = (
        F.when(n == 0, "new").when(idle > 30, "inactive").when(n <= 2, "new").when(n <= 9, "beginner").when(n <= 29, "regular").otherwise("heavy")
    )
    full = users.select("user_id").join(prof, "user_id", "left").fillna(
        {"events": 0, "idle_days": 999, "diversity": 0.0, "tenure_days": 0}
    )
    return full.withColumn("segment", segment)


def segment_distribution(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("segment").agg(F.count(F.lit(1)).alias("users"))


def satisfaction_segments(feedbacks: DataFrame) -> DataFrame:
    """Satisfaction per user over processed feedback."""
    good = F.avg((F.col("feedback") == "satisfied").cast("double"))
    agg = feedbacks.filter("processed").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), good.alias("satisfaction"))
    segment = F.when(F.col("n") >= 10, "power").when(F.col("satisfaction") > 0.7, "satisfied").otherwise("new")
    return agg.withColumn("segment", segment)
