"""Cleaning, scalar texts and validation on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import device, text, vectors
from tidemark.functions import timefn as tf
from tidemark.operators import cleaning, quality, validation


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_suffix_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["tone", "tone_m1", "browser.2", "browser.1"])
    row = cleaning.settle_suffixes(df).first().asDict()
    assert row == {"tone": 1, "browser": 4}


def test_messy_texts(spark):
    df = spark.createDataFrame([(" nan ", "NULL", "", " ok ")], ["A ", "b", "c", "d"])
    row = cleaning.normalise_fields(df, ["event_name"]).first().asDict()
    assert row == {"a": None, "b": None, "c": None, "d": "ok", "event_name": None}


@pytest.mark.parametrize(
    "name,kind",
    [("selected_paraphrasing", "action"), ("PageView", "view"), ("selected", "click"), ("copy_sentence", "copy"), (None, "unknown"), ("", "unknown"), ("x", "other")],
)
def test_event_types(spark, name, kind):
    assert one(spark, cleaning.event_type, name) == kind


@pytest.mark.parametrize("value,flag", [("true", True), ("Yes", True), ("1", True), ("0", False), (None, False), ("None", False)])
def test_flags(spark, value, flag):
    assert one(spark, cleaning.as_flag, value) is flag


def test_missing_required_column(spark):
    with pytest.raises(ValueError, match="event_time"):
        cleaning.pick_columns(spark.range(1), ["id"], ["event_time"])


@pytest.mark.parametrize(
    "seconds,shown",
    [(-1.0, "0s"), (0.123, "123.00ms"), (5.0, "5.00s"), (65.5, "1m 5.50s"), (3661.0, "1h 1m 1s"), (183600.0, "2d 3h")],
)
def test_durations(spark, seconds, shown):
    assert one(spark, text.format_duration, seconds, "double") == shown


@pytest.mark.parametrize(
    "elapsed,said",
    [(30.0, "30 seconds ago"), (60.0, "1 minute ago"), (7200.0, "2 hours ago"), (-259200.0, "3 days from now"), (5e6, "1 month ago"), (7e7, "2 years ago"), (None, "unknown time")],
)
def test_relative_times(spark, elapsed, said):
    assert one(spark, text.relative_time, elapsed, "double") == said


@pytest.mark.parametrize(
    "raw,iso",
    [
        ("2025-01-01T12:00:00Z", "2025-01-01 12:00:00"),
        ("2025-01-01T12:00:00+09:00", "2025-01-01 03:00:00"),
        ("1704110400", "2024-01-01 12:00:00"),
        ("2025/02/03", "2025-02-03 00:00:00"),
        ("2025/02/03 04:05:06", "2025-02-03 04:05:06"),
        ("soon", None),
    ],
)
def test_flexible_datetimes(spark, raw, iso):
    assert one(spark, lambda c: F.date_format(tf.parse_datetime(c), "yyyy-MM-dd HH:mm:ss"), raw) == iso


def test_circular_hours(spark):
    assert one(spark, lambda c: tf.circular_hours(c, F.lit(1)), 23, "int") == 2


def test_time_range_checks_its_bounds(spark):
    assert tf.time_range(spark, "2024-01-01", "2024-01-02", "6 HOURS").count() == 5
    with pytest.raises(ValueError):
        tf.time_range(spark, "2024-01-02", "2024-01-01", "1 DAY")


@pytest.mark.parametrize("os,kind", [("Mac OS X", "mac"), ("Windows 11", "desktop"), ("iPad", "tablet"), ("Android", "desktop"), ("", "unknown"), (None, "unknown")])
def test_device_types(spark, os, kind):
    assert one(spark, device.device_type, os) == kind


def test_families_keep_their_rule_order(spark):
    assert one(spark, device.browser_family, "Chrome Edge") == "Chrome"
    assert one(spark, device.os_family, "Chrome OS on Linux") == "Linux"
    assert one(spark, device.region, "kr") == "Asia"
    assert one(spark, device.region, "ZZ") == "Other"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(
        vectors.cosine(a, b), vectors.cosine(a, z), vectors.unit_length(a), vectors.pad(a, 4), vectors.fuse(a, b, 3),
        vectors.item_similarity(a, z, F.lit("x"), F.lit("x")),
    ).first()
    assert row[0] == pytest.approx(0.96) and row[1] is None and row[2] == pytest.approx([0.6, 0.8]) and row[3] == [3, 4, 0, 0]
    assert row[4] == pytest.approx([3.3, 3.7, 0]) and row[5] == 1.0


def test_masking(spark):
    schema = "id int, Password string, info struct<api_key: string, more: array<struct<ssn: string, n: int>>>, tags map<string, string>"
    df = spark.createDataFrame([(1, "p", ("k", [("s", 2)]), {"token": "t", "x": "y"})], schema)
    row = cleaning.mask_secrets(df).first()
    m = cleaning.MASK
    assert (row["Password"], row["info"]["api_key"], row["info"]["more"][0]["ssn"], row["info"]["more"][0]["n"]) == (m, m, m, 2)
    assert row["tags"] == {"token": m, "x": "y"}
    assert one(spark, cleaning.mask_email, "user@a.b") == "u**r@a.b"
    assert one(spark, cleaning.mask_email, "ab@a.b") == "**@a.b"
    assert one(spark, cleaning.endpoint_of, "/u/12/123e4567-e89b-12d3-a456-426614174000/x1") == "/u/{id}/{uuid}/x1"


def test_search_takes_text_literally(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",)], ["t"])
    assert cleaning.search(df, "50%", ["t"]).count() == 1


def test_validator_demo(spark):
    schema = "k int, user_id string, age int, email string, properties map<string, string>"
    rows = [
        (0, "user_123", 25, "valid@example.com", {"city": "Seoul"}),
        (1, "user_456", 200, "invalid-email", {"city": "Busan"}),
        (2, None, 30, "test@example.com", None),
    ]
    rules = [
        validation.Rule("user_id", "string"),
        validation.Rule("age", "integer", required=False, min_value=0, max_value=150),
        validation.Rule("email", "email", required=False, pattern=validation.EMAIL),
        validation.Rule("properties", "json"),
    ]
    checked = validation.with_errors(spark.createDataFrame(rows, schema), rules)
    got = sorted((r["k"], r["field"], r["error_type"]) for r in validation.error_rows(checked, "k").collect())
    assert got == [(1, "age", "value_too_large"), (1, "email", "type_mismatch"), (2, "properties", "missing_field"), (2, "user_id", "missing_field")]
    s = validation.summary(checked).first()
    assert (s["total"], s["valid"], s["errors"]) == (3, 1, 4)


def test_quality_finds_planted_defects(spark):
    rows = [(i % 3, "same", None if i < 5 else 1, -1 if i == 0 else i, f"20{40 if i == 1 else 20}-01-01") for i in range(40)]
    df = spark.createDataFrame([*rows, rows[7]], "user_id int, kind string, x int, age int, date string")
    checks = {r["check_name"]: r for r in quality.quality_checks(df).collect()}
    assert not checks["duplicate_rows"]["passed"] and checks["duplicate_rows"]["message"].startswith("1 ")
    assert {"age_negative_values", "uniqueness_user_id", "kind_imbalance", "column_completeness_x", "date_future_dates"} <= set(checks)
    assert not quality.report(quality.quality_checks(df)).first()["overall_passed"]
    empty = quality.report(quality.quality_checks(df.filter("false"))).first()
    assert not empty["overall_passed"]
