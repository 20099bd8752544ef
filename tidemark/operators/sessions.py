"""Sessions, session features, n-grams, gaps and context switches.

All window results go through the slice helpers, so a user with a very large share
of the events is spread over many tasks and still gets the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.session import AS_OF

USER, ORDER = ["user_id"], ["event_time", "id"]
ATTRIBUTES = ["device_id", "browser", "os", "tone", "maintenance"]


def with_previous(events: DataFrame, columns: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Adds `prev_<column>` per user in time order and `_first` for a user's first event."""
    sliced = skew.slice_hot(events, USER, "event_time", min_rows=min_hot_rows)
    return skew.lag_in_slices(sliced, USER, ORDER, {f"prev_{c}": c for c in columns})


def changed(column: str) -> Column:
    """True when the value differs from the previous row; a null never equals anything."""
    return F.coalesce(F.col(column) != F.col(f"prev_{column}"), F.lit(True))


def sessionise(
    events: DataFrame, gap_minutes: int = 30, extra: Sequence[str] = (), min_hot_rows: int | None = None
) -> DataFrame:
    """Adds gap_minutes, starts (first event of a session) and session_no (from 0 per user).

    A gap of exactly `gap_minutes` stays in the session; a longer one starts a new one.
    """
    prev = with_previous(events, ["event_time", *extra], min_hot_rows)
    gap = tf.seconds_between(F.col("prev_event_time"), F.col("event_time")) / 60.0
    split = F.coalesce(gap > gap_minutes, F.lit(False))
    marked = prev.select("*", gap.alias("gap_minutes"), split.cast("int").alias("_split"), (F.col("_first") | split).alias("starts"))
    return skew.running_in_slices(marked, USER, ORDER, {"_split": F.col("_split")}).withColumnRenamed("_split", "session_no")


def _plain_median(columns: Sequence[str]) -> Column:
    gap = F.when(F.col("_slice") == 0, F.col("gap")) if "_slice" in columns else F.col("gap")
    return F.percentile(gap, 0.5).alias("median_gap")


def _hot_medians(stats: DataFrame, rows: DataFrame, keys: Sequence[str], min_hot_rows: int | None) -> DataFrame:
    """Fills median_gap for users whose rows are sliced; all others got it from the built-in aggregate."""
    if "_slice" not in rows.columns:
        return stats
    hot = skew.quantiles(rows.filter(F.col("_slice") != 0), keys, "gap", {"_hot_median": 0.5}, min_rows=min_hot_rows)
    joined = skew.join_same(stats, hot, list(keys), "left")
    return joined.withColumn("median_gap", F.coalesce("median_gap", "_hot_median")).drop("_hot_median")


def session_features(events: DataFrame, include_entry_gap: bool = True, min_hot_rows: int | None = None) -> DataFrame:
    """One row per session.

    The first event of a later session carries the long gap that split it off;
    `include_entry_gap=False` leaves that gap out of the gap statistics.
    """
    keep = ["user_id", "id", "event_time", "event_name", "item_id", "response_time_ms", "device_id", "tone", "maintenance"]
    attrs = ["device_id", "tone", "maintenance"]
    rows = sessionise(events.select(*keep), extra=attrs, min_hot_rows=min_hot_rows)
    key = ["user_id", "session_no"]

    def changes(c: str) -> Column:
        return (F.count_if(F.col("starts") | changed(c)) - 1).alias(f"{c.removesuffix('_id')}_changes")

    gap = F.col("gap_minutes") if include_entry_gap else F.when(~F.col("starts"), F.col("gap_minutes"))
    rows = rows.withColumn("gap", gap)
    runs = F.col("event_name").isin("run_paraphrasing", "editor_run_paraphrasing")
    selects = F.col("event_name").isin("selected_paraphrasing", "editor_selected_paraphrasing")
    # One pass: each event counts for its session and for its (session, event name), (session,
    # item) and (session, tone), from which the map and the distinct counts follow.
    parts = rows.withColumns({"item": F.col("item_id")}).groupingSets(
        [key, [*key, "event_name"], [*key, "item"], [*key, "tone"]], *key, "event_name", "item", "tone"
    )
    cells = parts.agg(
        F.grouping_id().alias("g"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count(F.lit(1)).alias("n"),
        *[changes(c) for c in attrs],
        F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.avg("gap").alias("avg_gap"),
        F.max("gap").alias("max_gap"),
        _plain_median(rows.columns),
    )
    whole, by_name, by_item, by_tone = (F.col("g") == g for g in (7, 3, 5, 6))
    direct = ["session_start", "session_end", *[f"{c.removesuffix('_id')}_changes" for c in attrs]]
    direct += ["avg_response_time_ms", "avg_gap", "max_gap", "median_gap"]
    wide = cells.groupBy(*key).agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in direct],
        F.sum(F.when(whole, F.col("n"))).alias("events"),
        F.sum(F.when(by_name & runs, F.col("n")).otherwise(0)).alias("runs"),
        F.sum(F.when(by_name & selects, F.col("n")).otherwise(0)).alias("selects"),
        F.sum(F.when(by_name & (F.col("event_name") == "copy_sentence"), F.col("n")).otherwise(0)).alias("copies"),
        F.count_if(by_item & F.col("item").isNotNull()).alias("unique_items"),
        F.count_if(by_tone & F.col("tone").isNotNull()).alias("tone_diversity"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(by_name & F.col("event_name").isNotNull(), F.struct("event_name", "n"))))).alias("event_counts"),
    )
    wide = _hot_medians(wide, rows, key, min_hot_rows)
    minutes = tf.seconds_between(F.col("session_start"), F.col("session_end")) / 60.0
    hour = F.hour("session_start")
    return (
        wide.withColumn("session_id", F.concat(F.col("user_id").cast("string"), F.lit("_session_"), F.col("session_no").cast("string")))
        .withColumn("duration_minutes", minutes)
        .withColumn("hour", hour)
        .withColumn("time_of_day", tf.time_of_day(hour))
        .withColumn("is_peak", hour.isin(tf.PEAK_HOURS))
        .withColumn("exploration_score", F.col("unique_items") / F.col("events") * F.col("tone_diversity") / 4.0)
        .withColumn("events_per_minute", F.col("events") / F.greatest(F.col("duration_minutes"), F.lit(1.0)))
        .withColumn("select_rate", F.col("selects") / F.greatest(F.col("runs"), F.lit(1)))
    )


def session_grams(events: DataFrame, min_hot_rows: int | None = None) -> DataFrame:
    """Counts of the 2- and 3-grams of event names inside each session, with their first place."""
    rows = sessionise(events.select("user_id", "id", "event_time", "event_name"), extra=["event_name"], min_hot_rows=min_hot_rows)
    rows = rows.drop("_first", "prev_event_time", "gap_minutes")
    rows = skew.lag_in_slices(rows, USER, ORDER, {"prev_starts": "starts", "prev2_event_name": "prev_event_name"})
    inside2 = ~F.col("starts")
    inside3 = inside2 & ~F.col("prev_starts")
    grams = F.array(
        F.when(inside2, F.array("prev_event_name", "event_name")),
        F.when(inside3, F.array("prev2_event_name", "prev_event_name", "event_name")),
    )
    flat = rows.select("user_id", "session_no", *ORDER, F.explode(F.filter(grams, lambda g: g.isNotNull())).alias("gram"))
    return flat.groupBy("user_id", "session_no", "gram").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first_place")
    )


def session_sequence_scores(grams: DataFrame, sessions: DataFrame) -> DataFrame:
    """Repeat score (share of the commonest trigram) and trigram diversity per session."""
    tri = grams.filter(F.size("gram") == 3).groupBy("user_id", "session_no").agg(
        F.max("n").alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sessions.select("user_id", "session_no").join(tri, ["user_id", "session_no"], "left").select(
        "user_id",
        "session_no",
        zero(F.col("top") / F.col("all")).alias("repeat_score"),
        zero(F.col("kinds") / F.col("all")).alias("sequence_diversity"),
    )


def common_sequences(grams: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest grams per session; on ties pairs come before triples, then the first seen."""
    order = [F.desc("n"), F.size("gram"), F.col("first_place"), F.col("gram")]
    return skew.rank_rows(grams, ["user_id", "session_no"], order, k)


def frequent_sequences(events: DataFrame, max_length: int = 5, min_count: int = 2, min_hot_rows: int | None = None) -> DataFrame:
    """Contiguous event sequences of length 2..max per user that occur at least `min_count` times.

    Each step extends the trail of the row before by one name, so no per-user list
    of events is ever built.
    """
    rows = skew.slice_hot(events.select("user_id", "id", "event_time", "event_name"), USER, "event_time", min_rows=min_hot_rows)
    rows = rows.withColumn("trail", F.array("event_name"))
    for _ in range(max_length - 1):
        rows = skew.lag_in_slices(rows, USER, ORDER, {"_tail": "trail"})
        grown = F.concat(F.coalesce("_tail", F.array().cast("array<string>")), F.array("event_name"))
        rows = rows.withColumn("trail", grown).drop("_tail", "_first")
    size = F.size("trail")
    tails = F.transform(F.sequence(F.lit(2), size), lambda length: F.slice("trail", size - length + 1, length))
    flat = rows.filter(size >= 2).select("user_id", F.explode(tails).alias("seq"))
    return flat.groupBy("user_id", "seq").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def gap_statistics(
    events: DataFrame, users: DataFrame, as_of: str = AS_OF, days: int = 30, min_hot_rows: int | None = None
) -> DataFrame:
    """Gaps between consecutive events in the window; zeros for users with fewer than two events."""
    recent = events.select("user_id", "id", "event_time").filter(tf.since("event_time", as_of, days=days))
    prev = with_previous(recent, ["event_time"], min_hot_rows).filter(~F.col("_first"))
    gap = tf.seconds_between(F.col("prev_event_time"), F.col("event_time")) / 60.0
    gaps = prev.select("user_id", *[c for c in prev.columns if c == "_slice"], gap.alias("gap"))
    stats = gaps.groupBy("user_id").agg(
        F.avg("gap").alias("avg_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.stddev_pop("gap").alias("std_gap"),
        F.count(F.lit(1)).alias("gaps"),
        _plain_median(gaps.columns),
    )
    stats = _hot_medians(stats, gaps, USER, min_hot_rows)
    return users.select("user_id").join(stats, "user_id", "left").fillna(0)


def context_switches(events: DataFrame, as_of: str = AS_OF, days: int = 30, min_hot_rows: int | None = None) -> DataFrame:
    """Switch counts and rates per attribute, and tone diversity."""
    recent = events.select("user_id", "id", "event_time", *ATTRIBUTES).filter(tf.since("event_time", as_of, days=days))
    rows = with_previous(recent, ATTRIBUTES, min_hot_rows)
    counts = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        *[(F.count_if(F.col("_first") | changed(c)) - 1).alias(f"{c.removesuffix('_id')}_switches") for c in ATTRIBUTES],
    )
    tones = skew.modes(recent, USER, {"tone": F.col("tone")}, distinct=["tone"]).select("user_id", F.col("n_tone").alias("tone_diversity"))
    steps = F.greatest(F.col("events") - 1, F.lit(1))
    names = [f"{c.removesuffix('_id')}_switches" for c in ATTRIBUTES]
    many = counts.filter("events >= 2").join(tones, "user_id")
    return many.select("*", *[(F.col(n) / steps).alias(n.replace("switches", "switch_rate")) for n in names])


def mean_session_minutes(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("duration_minutes").alias("avg_session_minutes")
    )
