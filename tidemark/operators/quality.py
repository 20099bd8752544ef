"""Data-quality checks as long-form rows (check_name, passed, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.session import AS_OF

# Words in column names that decide which checks apply.
NEVER_NEGATIVE = ["count", "age", "duration"]
DATE_WORDS = ["date", "time", "timestamp"]


def _percent(rate: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", rate * 100), F.lit("%"))


def _check(name: str, passed: Column, severity: Column | str, message: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), sev.alias("severity"), message.alias("message"))


def _fails(name: str, broken: Column, severity: str, message: Column) -> Column:
    """A check that only shows up when it fails."""
    return F.when(F.coalesce(broken, F.lit(False)), _check(name, F.lit(False), severity, message))


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def quality_checks(df: DataFrame, as_of: str = AS_OF, accuracy: int = 10_000) -> DataFrame:
    """All checks of a table.

    One wide aggregate covers nulls, negatives and dates. Duplicates and top values come
    from counts by value, distinct values per id column from one grouping-set pass, and
    quartiles from the bracketed exact quantiles, so no value list sits in one task.
    """
    numbers, texts = _of_type(df, T.NumericType), _of_type(df, T.StringType)
    ids = [c for c in df.columns if "id" in c.lower()]
    dates = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]
    whens = {c: F.col(c).cast("timestamp") if c not in texts else F.col(c).try_cast("timestamp") for c in dates if c not in numbers}
    now = tf.as_ts(as_of)

    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
        *[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in numbers],
        *[F.count_if(t > now).alias(f"future_{c}") for c, t in whens.items()],
        *[F.count_if(t < now - F.expr("INTERVAL 3650 DAYS")).alias(f"old_{c}") for c, t in whens.items()],
    )
    rows = F.nullif(F.col("rows"), F.lit(0))  # rates of an empty table are null
    missing = sum((F.col(f"null_{c}") for c in df.columns), F.lit(0))
    complete = F.lit(1.0) - missing / (rows * len(df.columns))
    checks = [
        F.when(
            rows > 0,
            _check("data_completeness", complete >= 0.95, F.when(complete < 0.8, "error").otherwise("warning"), F.concat(F.lit("completeness "), _percent(complete))),
        ),
        F.when(F.col("rows") == 0, _check("empty_dataset", F.lit(False), "error", F.lit("dataset is empty"))),
    ]
    for c in df.columns:
        rate = F.col(f"null_{c}") / rows
        checks.append(_fails(f"column_completeness_{c}", rate > 0.1, "warning", F.concat(F.lit(f"{c}: "), _percent(rate, 1), F.lit(" missing"))))
    for c in numbers:
        if any(w in c.lower() for w in NEVER_NEGATIVE):
            n = F.col(f"neg_{c}")
            checks.append(_fails(f"{c}_negative_values", n > 0, "error", F.concat(n.cast("string"), F.lit(" negative values"))))
    for c in whens:
        checks.append(_fails(f"{c}_future_dates", F.col(f"future_{c}") > 0, "warning", F.lit("contains future dates")))
        checks.append(_fails(f"{c}_old_dates", F.col(f"old_{c}") > 0, "info", F.lit("contains very old dates")))
    parts = [_rows(wide, checks), _duplicates(df)]
    if ids:
        parts.append(_uniqueness(df, ids))
    if texts:
        parts.append(_imbalance(df, texts))
    if numbers:
        parts.append(_outliers(df, numbers, accuracy))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rows(wide: DataFrame, checks: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("c.*")


def _duplicates(df: DataFrame) -> DataFrame:
    """Rows are compared by two 64-bit hashes over all columns, so only the hashes are shuffled."""
    cols = [F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in df.columns]
    tagged = [F.struct(c.isNull(), c) for c in cols]
    hashed = df.select(F.xxhash64(*tagged).alias("h1"), F.xxhash64(F.lit(7), *reversed(tagged)).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    wide = groups.agg(extra.alias("extra")).filter("extra IS NOT NULL")
    n = F.col("extra")
    return _rows(wide, [_check("duplicate_rows", n == 0, "warning", F.concat(n.cast("string"), F.lit(" duplicate rows")))])


def _uniqueness(df: DataFrame, ids: list[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in ids])
    values = texts.unpivot([], ids, "column", "value").filter("value IS NOT NULL")
    per = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg((F.count(F.lit(1)) / F.sum("n")).alias("rate"))
    low = per.filter("rate < 0.95")
    return low.select(
        F.concat(F.lit("uniqueness_"), F.col("column")).alias("check_name"),
        F.lit(False).alias("passed"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("uniqueness "), _percent(F.col("rate"))).alias("message"),
    )


def _imbalance(df: DataFrame, texts: list[str]) -> DataFrame:
    values = df.unpivot([], texts, "column", "value") if len(texts) == len(df.columns) else df.select(*texts).unpivot([], texts, "column", "value")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    top = counts.groupBy("column").agg(
        F.max(F.when(known, F.struct("n", "value"))).alias("top"), F.sum("n").alias("rows")
    )
    return top.filter(F.col("top.n") / F.col("rows") > 0.95).select(
        F.concat("column", F.lit("_imbalance")).alias("check_name"),
        F.lit(False).alias("passed"),
        F.lit("info").alias("severity"),
        F.concat(F.col("top.value"), F.lit(" dominates > 95%")).alias("message"),
    )


def _outliers(df: DataFrame, numbers: list[str], accuracy: int) -> DataFrame:
    """Share of rows outside 1.5 x IQR, per numeric column with at least 10 values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "v")
    fences = skew.quantiles(long, ["column"], "v", {"q1": 0.25, "q3": 0.75}, accuracy=accuracy)
    joined = long.join(F.broadcast(fences), "column")  # one row per column
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("v") < F.col("q1") - 1.5 * iqr) | (F.col("v") > F.col("q3") + 1.5 * iqr)
    rates = joined.groupBy("column").agg(
        F.count_if(out).alias("n_out"), F.count("v").alias("known"), F.count(F.lit(1)).alias("rows"), F.first(iqr).alias("iqr")
    )
    rate = F.col("n_out") / F.col("rows")
    return rates.filter((F.col("known") >= 10) & (F.col("iqr") != 0) & (rate > 0.05)).select(
        F.concat(F.lit("outliers_"), F.col("column")).alias("check_name"),
        F.lit(False).alias("passed"),
        F.lit("info").alias("severity"),
        F.concat(_percent(rate), F.lit(" outliers")).alias("message"),
    )


def report(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.agg(
        (F.count_if(failed & (F.col("severity") == "error")) == 0).alias("overall_passed"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    )
