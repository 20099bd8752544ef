"""Context groups of an event: time, device, place, session and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import device as dev
from tidemark.functions import timefn as tf


def temporal_context(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.struct(
        hour.alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        tf.time_of_day(hour).alias("time_of_day"),
        F.when(tf.is_weekend(ts), "weekend").otherwise("weekday").alias("day_type"),
        tf.is_business_hours(ts).alias("is_business_hours"),
        tf.is_weekend(ts).alias("is_weekend"),
        tf.is_peak(ts).alias("is_peak_hours"),
        tf.hour_tone(hour).alias("recommendation_tone"),
    )


def device_context(browser: Column, os: Column, device_id: Column) -> Column:
    kind, family = dev.device_type(os), dev.browser_family(browser)
    is_chrome, is_whale = F.coalesce(family == "Chrome", F.lit(False)), F.coalesce(family == "Whale", F.lit(False))
    return F.struct(
        kind.alias("device_type"),
        family.alias("browser_family"),
        dev.os_family(os).alias("os_family"),
        device_id.alias("device_id"),
        (kind == "mac").alias("is_mac"),
        (kind == "desktop").alias("is_desktop"),
        (kind == "tablet").alias("is_tablet"),
        is_chrome.alias("is_chrome"),
        is_whale.alias("is_whale"),
        (is_chrome | is_whale).alias("is_major_browser"),
    )


def location_context(country_code: Column, city: Column, timezone: Column) -> Column:
    region = dev.region(country_code)
    return F.struct(
        country_code.alias("country_code"),
        city.alias("city"),
        timezone.alias("timezone"),
        region.alias("region"),
        dev.is_korea(country_code).alias("is_korea"),
        dev.is_capital_area(country_code, city).alias("is_seoul_area"),
        *[F.coalesce(region == r, F.lit(False)).alias(f"is_{r.lower()}") for r in ("Asia", "Americas", "Europe")],
    )


def session_context(events: Column, minutes: Column, last_event: Column) -> Column:
    return F.struct(
        events.alias("events_in_session"),
        minutes.alias("session_duration_minutes"),
        last_event.alias("last_event_name"),
        tf.activity_level(events).alias("activity_level"),
        tf.engagement_level(minutes).alias("engagement_level"),
        (events == 0).alias("is_new_session"),
        (events >= 5).alias("is_active_session"),
        (events >= 10).alias("is_repeat_user"),
        (events >= 50).alias("is_power_user"),
    )


def preference_context(tone: Column, maintenance: Column, language: Column, tone_diversity: Column) -> Column:
    return F.struct(
        tone.alias("preferred_tone"),
        maintenance.alias("preferred_maintenance"),
        language.alias("preferred_language"),
        tone_diversity.alias("tone_diversity"),
        (tone_diversity <= 1).alias("is_single_tone_user"),
        (tone_diversity <= 2).alias("needs_exploration"),
        tone.isNotNull().alias("has_preferences"),
    )


def latest_context(events: DataFrame, users: DataFrame, sessions: DataFrame, preferences: DataFrame) -> DataFrame:
    """The five context groups of every user, taken at their latest event and session."""
    at = F.struct("event_time", "id")
    last = events.groupBy("user_id").agg(
        F.max_by(F.struct("event_time", "event_name", "browser", "os", "device_id"), at).alias("e")
    )
    current = sessions.groupBy("user_id").agg(
        F.max_by(F.struct("events", "duration_minutes"), F.col("session_no")).alias("s")
    )
    joined = last.join(current, "user_id").join(preferences, "user_id").join(users, "user_id", "left")
    nothing = F.lit(None).cast("string")
    return joined.select(
        "user_id",
        temporal_context(F.col("e.event_time")).alias("temporal"),
        device_context(F.col("e.browser"), F.col("e.os"), F.col("e.device_id")).alias("device"),
        location_context(F.col("country_code"), nothing, nothing).alias("location"),
        session_context(F.col("s.events"), F.col("s.duration_minutes"), F.col("e.event_name")).alias("session"),
        preference_context(
            F.col("preferred_tone"), F.col("preferred_maintenance"), F.col("preferred_language"), F.col("tone_diversity")
        ).alias("user_preference"),
    )
