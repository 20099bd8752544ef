"""Dashboard and repository style activity analytics over the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.session import AS_OF


def _recent(events: DataFrame, as_of: str, days: int | None) -> DataFrame:
    return events.filter(tf.since("event_time", as_of, days=days)) if days is not None else events


def event_distribution(
    events: DataFrame, as_of: str = AS_OF, days: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Events per event name, optionally windowed and per user (`by=["user_id"]`)."""
    return _recent(events, as_of, days).groupBy(*by, "event_name").agg(F.count(F.lit(1)).alias("n"))


def hourly_activity(events: DataFrame, as_of: str = AS_OF, days: int | None = 7) -> DataFrame:
    return (
        _recent(events, as_of, days)
        .groupBy(F.hour("event_time").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("response_time_ms").alias("avg_response"),
            F.count_distinct("user_id").alias("unique_users"),
        )
    )


def daily_rhythm(events: DataFrame, as_of: str = AS_OF, days: int | None = 30) -> DataFrame:
    return (
        _recent(events, as_of, days)
        .groupBy(F.to_date("event_time").alias("day"), "event_name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("unique_users"))
    )


def daily_summary(rhythm: DataFrame) -> DataFrame:
    """Per day: all events, and the largest per-event number of distinct users."""
    return rhythm.groupBy("day").agg(F.sum("n").alias("total"), F.max("unique_users").alias("peak_users"))


def daily_summary_totals(rhythm: DataFrame) -> DataFrame:
    return daily_summary(rhythm).agg(
        F.avg("total").alias("mean_per_day"),
        F.max("total").alias("max_per_day"),
        F.avg("peak_users").alias("mean_users"),
        F.max("peak_users").alias("max_users"),
    )


def period_distribution(events: DataFrame, as_of: str = AS_OF, days: int | None = 7) -> DataFrame:
    period = tf.panel_period(F.hour("event_time"))
    names = [name for name, _, _ in tf.PANEL_PERIODS] + ["night"]
    ordinal = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("period")).cast("int")
    return (
        _recent(events, as_of, days)
        .groupBy(period.alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ordinal", ordinal)
        .orderBy("ordinal")
    )


def average_response(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    known = events.filter(F.col("response_time_ms").isNotNull())
    return known.groupBy(*by).agg(F.avg("response_time_ms").alias("avg_response"), F.count(F.lit(1)).alias("n"))


def value_distribution(events: DataFrame, column: str, as_of: str = AS_OF, days: int | None = None) -> DataFrame:
    """Counts of the non-null values of one attribute (browser, tone, ...)."""
    return (
        _recent(events, as_of, days)
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def diversity_score(events: DataFrame, as_of: str = AS_OF, days: int | None = 7) -> DataFrame:
    """Shannon entropy of each user's event names, scaled to 0..100.

    Uses H = ln(N) - sum(n ln n) / N, so one pass over pre-aggregated counts is enough.
    """
    n = F.col("n")
    counts = event_distribution(events, as_of, days, by=["user_id"])
    agg = counts.groupBy("user_id").agg(F.sum("n").alias("events"), F.sum(n * F.log(n)).alias("s"))
    entropy = F.log("events") - F.col("s") / F.col("events")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), entropy * 100 / F.lit(1.6)))
    return agg.select("user_id", "events", entropy.alias("entropy"), score.alias("score"))


def kpi_summary(events: DataFrame, users: DataFrame, as_of: str = AS_OF, days: int | None = 30) -> DataFrame:
    # One row per user, day and name first: the distinct counts then expand that table and not the events.
    cells = _recent(events, as_of, days).groupBy("user_id", F.to_date("event_time").alias("day"), "event_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_time_ms").alias("waited"), F.count("response_time_ms").alias("timed")
    )
    window = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_distinct("day").alias("active_days"),
        F.try_divide(F.sum("waited"), F.sum("timed")).alias("avg_response"),
        F.count_distinct("event_name").alias("event_types"),
    )
    return window.withColumn("total_users", users.agg(F.count(F.lit(1))).scalar())


def growth_dashboard_totals(kpi: DataFrame) -> DataFrame:
    rate = F.when(F.col("total_users") > 0, F.col("active_users") / F.col("total_users") * 100).otherwise(0.0)
    return kpi.select("total_users", "active_users", rate.alias("activity_rate"))


def user_growth(users: DataFrame, features: DataFrame) -> DataFrame:
    """Growth panel of every user; missing feature rows read as zero activity."""
    f = lambda name, default=0: F.coalesce(F.col(name), F.lit(default))
    return users.select("user_id", "distinct_id").join(features, "user_id", "left").select(
        "user_id",
        "distinct_id",
        f("total_events").alias("total_activities"),
        f("last_30d_count").alias("monthly_activity"),
        f("last_7d_count").alias("weekly_activity"),
        (f("last_7d_count") / F.lit(7.0)).alias("avg_daily"),
        F.greatest(F.lit(0), F.lit(7) - F.coalesce("days_since_last", F.lit(7))).alias("streak_days"),
        f("avg_input_length", 0.0).alias("avg_length"),
        f("engagement_score", 0.0).alias("engagement"),
        f("days_since_first").alias("journey_days"),
        f("days_since_last").alias("days_inactive"),
    )


def _by_name() -> Column:
    # Events without a name are counted in the totals; a map has no place for them.
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("event_name").isNotNull(), F.struct("event_name", "n")))))


def item_statistics(events: DataFrame, items: DataFrame, features: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Per item: event distribution map, recent use and the feature row."""
    counts = events.groupBy("item_id", "event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tf.since("event_time", as_of, days=7)).alias("d7"),
        F.count_if(tf.since("event_time", as_of, days=30)).alias("d30"),
    )
    stats = counts.groupBy("item_id").agg(
        F.sum("n").alias("events"),
        F.sum("d7").alias("last_7d"),
        F.sum("d30").alias("last_30d"),
        _by_name().alias("distribution"),
    )
    return items.select("item_id", "item_name", "category").join(stats, "item_id", "left").join(
        features.select("item_id", "popularity_score", "trending_score"), "item_id", "left"
    )


def user_statistics(events: DataFrame, users: DataFrame) -> DataFrame:
    counts = events.groupBy("user_id", "event_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last")
    )
    stats = counts.groupBy("user_id").agg(
        F.sum("n").alias("events"),
        F.max("last").alias("last_event"),
        _by_name().alias("distribution"),
    )
    profile = F.struct("country_code", "account_type").alias("profile")
    return users.select("user_id", "distinct_id", profile).join(stats, "user_id", "left").withColumn(
        "events", F.coalesce("events", F.lit(0))
    )


def category_distribution(items: DataFrame) -> DataFrame:
    return items.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def system_totals(events: DataFrame, users: DataFrame, items: DataFrame, as_of: str = AS_OF) -> DataFrame:
    recent = tf.since("event_time", as_of, days=7)
    base = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(recent).alias("events_7d"),
        F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users_7d"),
    )
    row = base.withColumn("total_users", users.agg(F.count(F.lit(1))).scalar()).withColumn(
        "total_items", items.agg(F.count(F.lit(1))).scalar()
    )
    return row.withColumn("events_per_user", F.col("total_events") / F.greatest("total_users", F.lit(1))).withColumn(
        "events_7d_per_active", F.col("events_7d") / F.greatest("active_users_7d", F.lit(1))
    )


def active_users(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Distinct users of the last 5 minutes, hour and day, in one pass."""
    spans = {"active_5m": "5 MINUTES", "active_1h": "1 HOUR", "active_24h": "24 HOURS"}
    now = tf.as_ts(as_of)
    seen = events.filter((F.col("event_time") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("event_time") <= now))
    last = seen.groupBy("user_id").agg(F.max("event_time").alias("last"))
    return last.agg(*[F.count_if(F.col("last") >= now - F.expr(f"INTERVAL {s}")).alias(n) for n, s in spans.items()])


def user_types(events: DataFrame, users: DataFrame) -> DataFrame:
    """Lifetime-count user type and the recommendation style that goes with it."""
    n = F.col("events")
    return activity_counts(events, users).select(
        "user_id",
        "events",
        F.when(n >= 50, "power").when(n >= 15, "growth").when(n >= 1, "casual").otherwise("new").alias("user_type"),
        F.when(n >= 50, "soft_loop").when(n >= 15, "context_echo").when(n >= 1, "ghost_preview").otherwise("ambient").alias("style"),
    )


def activity_counts(events: DataFrame, users: DataFrame) -> DataFrame:
    """All users with their event count, zero included."""
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.select("user_id", "distinct_id").join(counts, "user_id", "left").select(
        "user_id", "distinct_id", F.coalesce("n", F.lit(0)).alias("events")
    )


def dashboard_segments(events: DataFrame, users: DataFrame) -> DataFrame:
    n = F.col("events")
    segment = F.when(n <= 4, "new").when(n <= 19, "exploring").when(n <= 49, "growing").otherwise("power")
    return activity_counts(events, users).groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("users"))


def top_users(events: DataFrame, users: DataFrame, k: int = 10, as_of: str = AS_OF, days: int | None = None) -> DataFrame:
    """Most active users; with `days` only events of the window count, so idle users drop out."""
    counts = _recent(events, as_of, days).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("event_time").alias("last_event")
    )
    return (
        users.select("user_id", "distinct_id")
        .join(counts, "user_id")
        .orderBy(F.desc("events"), "user_id")
        .limit(k)
    )


def new_user_flags(events: DataFrame, users: DataFrame, limit: int = 2) -> DataFrame:
    return activity_counts(events, users).select("user_id", "events", (F.col("events") <= limit).alias("is_new"))


def interaction_count_summary(events: DataFrame, key: str) -> DataFrame:
    """Mean, median, min and max number of events per user or item."""
    counts = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Few distinct counts exist even for many keys: take the median over the histogram.
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    return hist.agg(
        F.sum("keys").alias("keys"),
        (F.sum(F.col("n") * F.col("keys")) / F.sum("keys")).alias("mean_n"),
        F.percentile("n", 0.5, F.col("keys")).alias("median_n"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )


def top_items_with_share(events: DataFrame, k: int = 10) -> DataFrame:
    counts = events.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "item_id").limit(k)


def filtered_count(df: DataFrame, condition: Column) -> DataFrame:
    """Row count, matching rows and whether any row matches."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(condition).alias("matching"),
        F.coalesce(F.bool_or(condition), F.lit(False)).alias("exists"),
    )


def growth_timeline(events: DataFrame, as_of: str = AS_OF, days: int | None = 30) -> DataFrame:
    """Events per user and day with the running total; rows are per (user, day), so windows stay small."""
    daily = _recent(events, as_of, days).groupBy("user_id", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("cumulative", F.sum("n").over(w))


def recent_repetitions(
    events: DataFrame, last_n: int = 10, min_repeats: int = 1, min_hot_rows: int | None = None
) -> DataFrame:
    """Events equal to the event right before them, within the last N events of each user.

    Only the last N + 1 rows per user matter, and those come from a group limit that
    runs before the shuffle.
    """
    tail = skew.rank_rows(
        events.select("user_id", "event_time", "id", "event_name"),
        ["user_id"],
        [F.desc("event_time"), F.desc("id")],
        last_n + 1,
    )
    w = W.partitionBy("user_id").orderBy("event_time", "id")
    same = tail.withColumn("prev", F.lag("event_name").over(w)).filter(
        (F.col("rank") <= last_n) & (F.col("event_name") == F.col("prev"))
    )
    return (
        same.groupBy("user_id", "event_name").agg(F.count(F.lit(1)).alias("repetitions")).filter(F.col("repetitions") >= min_repeats)
    )


def early_runs(events: DataFrame, first_n: int = 100, min_run: int = 3) -> DataFrame:
    """Runs of one repeated event name within the first N events of each user."""
    head = skew.rank_rows(
        events.select("user_id", "event_time", "id", "event_name"), ["user_id"], [F.asc("event_time"), F.asc("id")], first_n, "pos"
    )
    same = W.partitionBy("user_id", "event_name").orderBy("pos")
    island = F.col("pos") - F.row_number().over(same)
    return (
        head.withColumn("island", island)
        .groupBy("user_id", "event_name", "island")
        .agg(F.count(F.lit(1)).alias("run_length"), F.min("event_time").alias("start"), F.max("event_time").alias("end"))
        .filter(F.col("run_length") >= min_run)
        .drop("island")
    )


def item_reach(events: DataFrame) -> DataFrame:
    """Per item: distinct users, and the earliest user."""
    first = events.filter(F.col("item_id").isNotNull()).groupBy("item_id", "user_id").agg(F.min("event_time").alias("first"))
    return first.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("unique_users"),
        F.min(F.struct("first", "user_id")).getField("user_id").alias("first_user"),
    )


def first_use(events: DataFrame) -> DataFrame:
    """The event by which a user met an item for the first time."""
    known = events.filter(F.col("item_id").isNotNull())
    first = known.groupBy("user_id", "item_id").agg(F.min(F.struct("event_time", "id")).alias("f"))
    return first.select("user_id", "item_id", F.col("f.id").alias("first_id"), F.col("f.event_time").alias("first_time"))


def last_use(events: DataFrame, as_of: str = AS_OF, hours: int = 24) -> DataFrame:
    last = events.filter(F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(F.max("event_time").alias("last_time"))
    return last.withColumn("recent", tf.seconds_between(F.col("last_time"), tf.as_ts(as_of)) < hours * 3600)


def recent_events(
    events: DataFrame, k: int = 10, hours: int | None = None, as_of: str = AS_OF, newest_first: bool = True
) -> DataFrame:
    """The last (or first) k events of every user, optionally from the last H hours only."""
    src = events.filter(tf.since("event_time", as_of, hours=hours)) if hours is not None else events
    order = [F.desc("event_time"), F.desc("id")] if newest_first else [F.asc("event_time"), F.asc("id")]
    return skew.rank_rows(src, ["user_id"], order, k)


def popular_items(events: DataFrame, items: DataFrame, k: int = 10, as_of: str = AS_OF, days: int | None = None) -> DataFrame:
    counts = _recent(events, as_of, days).groupBy("item_id").agg(F.count(F.lit(1)).alias("uses"))
    return (
        items.filter("is_active")
        .select("item_id", "item_name", "category")
        .join(counts, "item_id")
        .orderBy(F.desc("uses"), "item_id")
        .limit(k)
    )


def recently_seen_users(events: DataFrame, users: DataFrame, as_of: str = AS_OF, days: int = 30, k: int = 100) -> DataFrame:
    seen = events.groupBy("user_id").agg(F.max("event_time").alias("last_seen"))
    return (
        users.select("user_id", "distinct_id")
        .join(seen.filter(tf.since("last_seen", as_of, days=days)), "user_id")
        .orderBy(F.desc("last_seen"), "user_id")
        .limit(k)
    )


def active_items_by(items: DataFrame, events: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Active items per category or type, ordered by use."""
    uses = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("uses"))
    base = items.filter("is_active").select("item_id", "item_name", by).join(uses, "item_id", "left")
    base = base.withColumn("uses", F.coalesce("uses", F.lit(0)))
    return skew.rank_rows(base, [by], [F.desc("uses"), F.asc("item_id")], k)
