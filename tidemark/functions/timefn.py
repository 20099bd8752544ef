"""Clock, calendar and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400

# Hour ranges [start, end) of the context vocabulary.
TIME_OF_DAY = [("dawn", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 22), ("night", 22, 24)]
HOUR_TONE = [("creative", 0, 6), ("focused", 6, 12), ("expansive", 12, 18), ("emotional", 18, 22), ("neutral", 22, 24)]
# Hour ranges of the activity panel; every other hour is night.
PANEL_PERIODS = [("dawn", 5, 8), ("morning", 8, 12), ("afternoon", 12, 18), ("evening", 18, 22)]
PEAK_HOURS = [7, 8]


def as_ts(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days (not calendar days), rounded towards minus infinity."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(SECONDS_PER_DAY * 1_000_000))


def since(ts: str, as_of: str | Column, days: int | None = None, hours: int | None = None) -> Column:
    """True for events of the last `days` / `hours`; a plain comparison, so it reaches the scan."""
    unit = f"INTERVAL {days} DAYS" if days is not None else f"INTERVAL {hours} HOURS"
    return F.col(ts) >= as_ts(as_of) - F.expr(unit)


def _ranges(hour: Column, table: list[tuple[str, int, int]], other: str | None = None) -> Column:
    out = None
    for name, start, end in table:
        cond = (hour >= start) & (hour < end)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(other) if other is not None else out


def time_of_day(hour: Column) -> Column:
    return _ranges(hour, TIME_OF_DAY)


def hour_tone(hour: Column) -> Column:
    return _ranges(hour, HOUR_TONE)


def panel_period(hour: Column) -> Column:
    return _ranges(hour, PANEL_PERIODS, "night")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_business_hours(ts: Column) -> Column:
    return (F.hour(ts) >= 9) & (F.hour(ts) < 18) & (F.weekday(ts) < 5)


def is_peak(ts: Column) -> Column:
    return F.hour(ts).isin(PEAK_HOURS)


def circular_hours(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(24) - gap)


def day_decay(ts: Column, end: Column, days: float = 30.0) -> Column:
    """exp(-whole days / days): an e-folding time, not a half-life."""
    return F.exp(-whole_days(ts, end) / F.lit(float(days)))


def hour_decay(ts: Column, end: Column, hours: float) -> Column:
    return F.exp(-seconds_between(ts, end) / F.lit(3600.0 * hours))


def activity_level(events: Column) -> Column:
    return (
        F.when(events == 0, "new").when(events < 5, "low").when(events < 15, "medium").when(events < 50, "high").otherwise("power")
    )


def engagement_level(minutes: Column) -> Column:
    return F.when(minutes < 2, "exploring").when(minutes < 10, "active").when(minutes < 30, "engaged").otherwise("deep_work")


# Accepted text layouts, tried in this order after ISO and epoch forms.
DATETIME_LAYOUTS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]


def parse_datetime(text: Column) -> Column:
    """Timestamp from ISO text (with or without zone), epoch seconds or a fixed layout; bad text gives null."""
    t = F.trim(text)
    epoch = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(t.try_cast("double")))
    iso = F.when(~t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.try_cast("timestamp"))
    layouts = [F.try_to_timestamp(t, F.lit(p)) for p in DATETIME_LAYOUTS]
    return F.coalesce(epoch, iso, *layouts)


# Seconds per unit.
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}


def time_difference(start: Column, end: Column, unit: str = "seconds", absolute: bool = False) -> Column:
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown unit {unit!r}; use one of {sorted(UNIT_SECONDS)}")
    diff = seconds_between(start, end) / F.lit(float(UNIT_SECONDS[unit]))
    return F.abs(diff) if absolute else diff


def time_range(spark: SparkSession, start: str, end: str, every: str) -> DataFrame:
    """Calendar table from start to end inclusive, e.g. every='6 hours'."""
    if start >= end:
        raise ValueError("start must be before end")
    steps = F.sequence(as_ts(start), as_ts(end), F.expr(f"INTERVAL {every}"))
    return spark.range(1).select(F.explode(steps).alias("ts"))
