"""Cleaning of raw events and client records; column names are settled before any row is read."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import device as dev
from tidemark.functions import timefn as tf
from tidemark.session import AS_OF
from tidemark.sources.tables import first_per_key

# Texts that mean "no value".
EMPTY_TEXTS = ["nan", "None", "null", "NULL", ""]
PLACEHOLDERS = ["$direct", "$unknown", "none", "null", ""]
NO_USER = ["", "null", "none", "None"]
TRUE_TEXTS = ["true", "1", "yes"]
ACCOUNT_FLAGS = ["kakao", "naver", "google", "apple", "email"]
# Event types by words in the event name; the first hit wins.
EVENT_TYPES = [
    (["paraphrasing", "run"], "action"),
    (["view"], "view"),
    (["click", "selected"], "click"),
    (["copy"], "copy"),
    (["open"], "open"),
    (["purchase", "buy"], "purchase"),
    (["scroll"], "scroll"),
    (["login", "auth"], "auth"),
]
EVENT_CATEGORIES = {
    "engagement": ["view", "scroll", "open"],
    "interaction": ["click", "copy", "action"],
    "conversion": ["purchase"],
    "session": ["auth"],
}
EVENT_LENGTHS = {
    "event_name": 200,
    "distinct_id": 255,
    "insert_id": 200,
    "device_id": 255,
    "browser": 200,
    "os": 200,
    "event_type": 50,
    "interaction_category": 50,
    "day_of_week": 20,
    "llm_name": 200,
    "llm_provider": 50,
    "llm_version": 100,
    "field": 100,
    "tone": 50,
    "maintenance": 50,
    "target_language": 50,
}
EVENT_COLUMNS = [
    "event_name", "distinct_id", "insert_id", "device_id", "user_id", "event_time", "event_type", "interaction_category",
    "hour_of_day", "day_of_week", "is_weekend", "tone", "maintenance", "field", "target_language", "response_time_ms",
    "input_sentence_length", "llm_provider", "llm_name", "llm_version", "position", "trigger", "browser", "os", "current_url",
    "processed_at",
]
USER_COLUMNS = [
    "distinct_id", "email", "name", "browser", "browser_version", "browser_family", "os", "device_category", "city", "region",
    "country_code", "timezone", "initial_referrer", "initial_referring_domain", "referrer_domain_clean", "initial_utm_source",
    "initial_utm_medium", "initial_utm_campaign", "is_logged_in", "account_type", "role", "last_seen", "total_sessions",
    "days_since_last_seen", "is_active",
]


def settle_suffixes(df: DataFrame) -> DataFrame:
    """One column per base name out of `x`, `x_m1`, `x.2`: the plain one, else the lowest number."""
    pattern = re.compile(r"(?:_m|\.)(\d+)$")
    best: dict[str, tuple[int, str]] = {}
    for name in df.columns:
        hit = pattern.search(name)
        base, number = (name[: hit.start()], int(hit.group(1))) if hit else (name, -1)
        if base not in best or number < best[base][0]:
            best[base] = (number, name)
    return df.select(*[F.col(f"`{old}`").alias(base) for base, (_, old) in best.items()])


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalise_fields(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Lower-case names, trimmed texts with empty words as null, absent required columns as null."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    clean = {c: F.when(~F.trim(c).isin(EMPTY_TEXTS), F.trim(c)) for c in _texts(named)}
    missing = {c: F.lit(None).cast("string") for c in required if c not in named.columns}
    return named.withColumns({**clean, **missing})


def as_flag(column: Column) -> Column:
    """Booleans from texts and numbers; unknown and missing values are false."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(TRUE_TEXTS), F.lit(False))


def without_placeholders(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(PLACEHOLDERS), F.col(c)) for c in _texts(df)})


def epoch_time(column: Column) -> Column:
    """UTC timestamp from epoch seconds (number or text); anything else is null."""
    return F.timestamp_seconds(column.try_cast("double"))


def event_type(name: Column) -> Column:
    return dev.keyword_family(name, EVENT_TYPES, "other", missing="unknown")


def event_category(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, kinds in EVENT_CATEGORIES.items():
        out = out.when(kind.isin(kinds), name)
    return out.otherwise("other")


def usable_events(df: DataFrame) -> DataFrame:
    """Rows with a user and a time, the earliest one per insert_id. Rows without an insert_id all stay:
    nothing says that they repeat each other."""
    users = F.when(~F.col("distinct_id").isin(NO_USER), F.col("distinct_id"))
    rows = df.withColumn("distinct_id", users).filter(F.col("distinct_id").isNotNull() & F.col("event_time").isNotNull())
    if "insert_id" not in df.columns:
        return rows
    once = first_per_key(rows.filter(F.col("insert_id").isNotNull()), "insert_id", ["event_time", "distinct_id"])
    return once.unionByName(rows.filter(F.col("insert_id").isNull()))


def with_time_parts(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "hour_of_day": F.hour("event_time"),
            "day_of_week": F.date_format("event_time", "EEEE"),
            "is_weekend": tf.is_weekend(F.col("event_time")),
        }
    )
    if {"session_start", "session_end"} <= set(df.columns):
        out = out.withColumn("session_duration", tf.seconds_between(F.col("session_start"), F.col("session_end")))
    return out


def limit_lengths(df: DataFrame, limits: Mapping[str, int] = EVENT_LENGTHS) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in limits.items() if c in df.columns})


def truncation_counts(df: DataFrame, limits: Mapping[str, int] = EVENT_LENGTHS) -> DataFrame:
    """How many values each limit would cut."""
    cols = [c for c in limits if c in df.columns]
    wide = df.agg(*[F.count_if(F.length(c) > limits[c]).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "truncated")


def pick_columns(df: DataFrame, wanted: Sequence[str], required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.select(*[c for c in wanted if c in df.columns])


def response_ms(props: Mapping[str, Column]) -> Column:
    """Milliseconds, else seconds x 1000; a zero falls through like a missing value."""
    ms, sec = (props[c].try_cast("double") for c in ("response_time_ms", "response_time_seconds"))
    return F.coalesce(F.nullif(ms, F.lit(0)), sec * 1000)


def first_known(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def ingest_fields(df: DataFrame) -> DataFrame:
    """Alternative property names of the language model fields and the response time."""
    have = set(df.columns)
    out = df
    for name in ("llm_provider", "llm_name", "llm_version"):
        other = name.replace("llm_", "llm_info_")
        known = [F.col(c) for c in (name, other) if c in have]
        if known:
            out = out.withColumn(name, first_known(*known))
    if "response_time_seconds" in have:
        ms = F.col("response_time_ms") if "response_time_ms" in have else F.lit(None).cast("double")
        out = out.withColumn("response_time_ms", response_ms({"response_time_ms": ms, "response_time_seconds": F.col("response_time_seconds")}))
    return out


def clean_events(raw: DataFrame, processed_at: str = AS_OF) -> DataFrame:
    """Raw event records to the event table's columns."""
    df = normalise_fields(settle_suffixes(raw), ["event_name", "distinct_id"])
    df = ingest_fields(df).withColumn("event_time", epoch_time(F.col("time")))
    kind = event_type(F.col("event_name"))
    df = df.withColumn("event_type", kind).withColumn("interaction_category", event_category(F.col("event_type")))
    df = with_time_parts(usable_events(df)).withColumn("processed_at", tf.as_ts(processed_at))
    return pick_columns(limit_lengths(df), EVENT_COLUMNS, ["event_name", "distinct_id", "event_time"])


def with_user_keys(events: DataFrame, users: DataFrame) -> DataFrame:
    """distinct_id -> users.user_id; events of unknown users stay with a null key.

    Left join on trimmed texts; whether users are broadcast is left to their measured size.
    """
    keys = users.select(F.trim(F.col("distinct_id").cast("string")).alias("distinct_id"), F.col("user_id").alias("_uid"))
    trimmed = events.drop("user_id").withColumn("distinct_id", F.trim(F.col("distinct_id").cast("string")))
    return trimmed.join(keys, "distinct_id", "left").withColumnRenamed("_uid", "user_id")


def account_type(df: DataFrame) -> Column:
    flags = [c for c in ACCOUNT_FLAGS if f"is_{c}_account" in df.columns]
    return F.coalesce(*[F.when(F.col(f"is_{c}_account"), c) for c in flags]) if flags else F.lit(None).cast("string")


def referrer_domain(domain: Column) -> Column:
    """Lower case, without www., last two labels."""
    parts = F.split(F.replace(F.lower(domain), F.lit("www."), F.lit("")), r"\.")
    kept = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(parts[0])
    return F.when(domain.isNotNull() & ~F.lower(domain).isin("", "$direct", "$unknown", "none", "nan"), kept)


def clean_users(raw: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Raw client records to the user table's columns, one row per distinct_id."""
    df = settle_suffixes(raw)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    flags = [c for c in df.columns if c == "is_logged_in" or (c.startswith("is_") and c.endswith("_account"))]
    df = normalise_fields(df.withColumns({c: as_flag(F.col(c)) for c in flags}), ["distinct_id"])
    derived = {"account_type": account_type(df)}
    if "last_seen" in df.columns:
        derived["last_seen"] = tf.parse_datetime(F.col("last_seen").cast("string"))
    for name, default in (("role", 1), ("total_sessions", 0)):
        if name in df.columns:
            derived[name] = F.coalesce(F.col(name).try_cast("double").cast("int"), F.lit(default))
    df = without_placeholders(df.withColumns(derived))
    more = {}
    if "initial_referring_domain" in df.columns:
        more["referrer_domain_clean"] = referrer_domain(F.col("initial_referring_domain"))
    if "browser" in df.columns:
        more["browser_family"] = dev.load_browser_family(F.col("browser"))
    if "os" in df.columns:
        more["device_category"] = dev.load_device_category(F.col("os"))
    if "last_seen" in df.columns:
        more["days_since_last_seen"] = tf.whole_days(F.col("last_seen"), tf.as_ts(as_of))
        more["is_active"] = more["days_since_last_seen"] <= 30
    return pick_columns(df.withColumns(more), USER_COLUMNS, ["distinct_id"])


# --- search and filters ----------------------------------------------------------------------


def equal_filter(df: DataFrame, **values: object) -> DataFrame:
    """All given columns equal their value; lists mean "one of", None means null."""
    for name, value in values.items():
        c = F.col(name)
        df = df.filter(c.isNull() if value is None else c.isin(value) if isinstance(value, list) else c == value)
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    pattern = "%" + re.sub(r"([\\%_])", r"\\\1", text) + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(pattern)
    return df.filter(hit)


# --- masking and paths -------------------------------------------------------------------------

# Parts of field names that mark secrets, and the replacement text.
SECRET_NAMES = [
    "password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "access_token", "refresh_token", "authorization",
    "auth", "credit_card", "card_number", "cvv", "ssn",
]
MASK = "***MASKED***"


def _is_secret(name: str) -> bool:
    return any(part in name.lower() for part in SECRET_NAMES)


def _masked(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(MASK) if _is_secret(f.name) else _masked(value.getField(f.name), f.dataType)).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        secret = lambda k: F.lower(k).rlike("|".join(SECRET_NAMES))
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(secret(k), MASK).otherwise(v))
        return F.transform_values(value, lambda k, v: F.when(~secret(k), _masked(v, kind.valueType)))
    return value


def mask_secrets(df: DataFrame) -> DataFrame:
    """Replaces fields with secret names at any depth; maps of non-text values get null instead."""
    return df.select(*[(F.lit(MASK) if _is_secret(f.name) else _masked(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])


def mask_email(email: Column) -> Column:
    """First and last letter of the local part stay: u***r@example.com."""
    local = F.substring_index(email, "@", 1)
    n = F.length(local)
    hidden = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(local, n, F.lit(1)))
    )
    return F.when(F.contains(email, F.lit("@")), F.concat(hidden, F.substr(email, n + 1))).otherwise(email)


def endpoint_of(path: Column) -> Column:
    """Path with numbers as {id} and 36-character ids with four dashes as {uuid}."""
    def part(p: Column) -> Column:
        dashes = F.length(p) - F.length(F.replace(p, F.lit("-"), F.lit("")))
        return F.when(p.rlike("^[0-9]+$"), "{id}").when((F.length(p) == 36) & (dashes == 4), "{uuid}").otherwise(p)

    return F.array_join(F.transform(F.split(path, "/"), part), "/")
