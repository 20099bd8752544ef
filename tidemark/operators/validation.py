"""Rule-based row validation: one error record per broken rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the text kinds.
EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"
URL_STARTS = ("http://", "https://")


@dataclass(frozen=True)
class Rule:
    """Constraints of one field. `custom` maps the value column to a boolean column (a pandas
    UDF works as well). Missing values break only `required`."""

    field: str
    kind: str
    required: bool = True
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple | None = None
    pattern: str | None = None
    custom: Callable[[Column], Column] | None = None


def has_kind(value: Column, kind: str, actual: T.DataType) -> Column:
    """Whether the values are of a logical kind; typed columns answer from the schema."""
    text = isinstance(actual, T.StringType)
    number = isinstance(actual, T.NumericType)
    whole = isinstance(actual, T.IntegralType)
    if kind == "string":
        return F.lit(text)
    if kind == "integer":
        return F.lit(whole)
    if kind == "float":
        return F.lit(number)
    if kind == "boolean":
        return F.lit(isinstance(actual, T.BooleanType))
    if kind == "datetime":
        return value.try_cast("timestamp").isNotNull() if text else F.lit(isinstance(actual, (T.TimestampType, T.TimestampNTZType, T.DateType)))
    if kind == "json":
        return F.lit(isinstance(actual, (T.StructType, T.MapType, T.ArrayType, T.VariantType)))
    if kind == "email":
        return value.rlike(EMAIL) if text else F.lit(False)
    if kind == "url":
        return (value.startswith(URL_STARTS[0]) | value.startswith(URL_STARTS[1])) if text else F.lit(False)
    raise ValueError(f"unknown kind {kind!r}")


def _error(rule: Rule, kind: str, message: Column) -> Column:
    return F.struct(F.lit(rule.field).alias("field"), F.lit(kind).alias("error_type"), message.alias("message"))


def _checks(df: DataFrame, rule: Rule) -> list[Column]:
    missing = F.concat(F.lit(f"missing required field '{rule.field}'"))
    if rule.field not in df.columns:
        return [F.when(F.lit(rule.required), _error(rule, "missing_field", missing))]
    value, actual = F.col(rule.field), df.schema[rule.field].dataType
    there = value.isNotNull()
    typed = F.coalesce(has_kind(value, rule.kind, actual), F.lit(False))
    ok = there & typed
    shown = value.cast("string") if not isinstance(actual, (T.StructType, T.MapType, T.ArrayType)) else F.to_json(value)
    out = [
        F.when(~there & F.lit(rule.required), _error(rule, "missing_field", missing)),
        F.when(there & ~typed, _error(rule, "type_mismatch", F.lit(f"expected {rule.kind}"))),
    ]
    if isinstance(actual, T.NumericType):
        if rule.min_value is not None:
            out.append(F.when(ok & (value < rule.min_value), _error(rule, "value_too_small", F.concat(shown, F.lit(f" < {rule.min_value}")))))
        if rule.max_value is not None:
            out.append(F.when(ok & (value > rule.max_value), _error(rule, "value_too_large", F.concat(shown, F.lit(f" > {rule.max_value}")))))
    if rule.allowed:
        out.append(F.when(ok & ~value.isin(list(rule.allowed)), _error(rule, "invalid_value", F.concat(shown, F.lit(" is not allowed")))))
    if rule.pattern and isinstance(actual, T.StringType):
        anchored = rule.pattern if rule.pattern.startswith("^") else f"^(?:{rule.pattern})"
        out.append(F.when(ok & ~value.rlike(anchored), _error(rule, "pattern_mismatch", F.concat(shown, F.lit(" does not match")))))
    if rule.custom:
        passed = F.coalesce(rule.custom(value), F.lit(False))
        out.append(F.when(ok & ~passed, _error(rule, "custom_validation_failed", F.concat(F.lit("check failed for "), shown))))
    return out


def with_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds `errors`, an array of (field, error_type, message); empty for valid rows."""
    checks = [c for rule in rules for c in _checks(df, rule)]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def error_rows(checked: DataFrame, key: str) -> DataFrame:
    return checked.select(key, F.explode("errors").alias("e")).select(key, "e.*")


def summary(checked: DataFrame) -> DataFrame:
    row = checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("errors") == 0).alias("valid"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"),
    )
    return row.withColumn("invalid", F.col("total") - F.col("valid")).withColumn(
        "error_rate", F.when(F.col("total") > 0, F.col("invalid") / F.col("total")).otherwise(0.0)
    )


# Required fields of raw client and event records.
CLIENT_RULES = [Rule("distinct_id", "string")]
EVENT_RULES = [Rule("event_name", "string"), Rule("distinct_id", "string"), Rule("time", "float")]
