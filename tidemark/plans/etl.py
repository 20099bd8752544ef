"""File-to-table runs: extract, validate, transform, check quality, load, with a run log."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stage import stage
from tidemark.operators import cleaning, quality, validation
from tidemark.session import AS_OF
from tidemark.sources import files, tables

RUN_LOG = "run string, step string, rows long, seconds double, status string, note string"


@dataclass
class Run:
    """Result of one run: the loaded rows, validation errors, quality checks and the step log."""

    name: str
    rows: DataFrame | None = None
    errors: DataFrame | None = None
    checks: DataFrame | None = None
    steps: list[tuple] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(s[4] == "ok" for s in self.steps)

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps, RUN_LOG)


def run(
    name: str,
    raw: DataFrame,
    rules: Sequence[validation.Rule],
    transform: Callable[[DataFrame], DataFrame],
    existing: DataFrame,
    key: str,
    order: Sequence[str],
    required: Sequence[str] = (),
    as_of: str = AS_OF,
) -> Run:
    """One table's run. A record that breaks a rule stops the run before the load; quality
    checks only report. `rows` are those to append: complete, one per key, and new."""
    out = Run(name)
    checked = stage(validation.with_errors(raw, rules), f"{name}-checked")
    started = time.time()

    def step(label: str, rows: int, status: str = "ok", note: str = "") -> None:
        nonlocal started
        out.steps.append((name, label, rows, time.time() - started, status, note))
        started = time.time()

    step("extract", checked.count())
    broken = checked.filter(F.size("errors") > 0)
    out.errors = validation.error_rows(broken.withColumn("record", F.xxhash64(*raw.columns)), "record")
    n = broken.count()
    step("validate", n, "ok" if n == 0 else "failed", "" if n == 0 else f"{n} invalid records")
    if n:
        return out
    table = stage(transform(checked.drop("errors")), f"{name}-table")
    step("transform", table.count())
    out.checks = stage(quality.quality_checks(table, as_of), f"{name}-quality")
    step("quality", out.checks.count())
    out.rows = stage(tables.rows_to_insert(table, existing, key, order, required), f"{name}-new")
    step("load", out.rows.count())
    return out


def run_users(raw: DataFrame, existing: DataFrame, as_of: str = AS_OF) -> Run:
    clean = lambda df: cleaning.clean_users(df, as_of)
    return run("users", raw, validation.CLIENT_RULES, clean, existing, "distinct_id", ["distinct_id"], as_of=as_of)


def run_events(raw: DataFrame, users: DataFrame, existing: DataFrame, as_of: str = AS_OF) -> Run:
    """Users first: events look up their user keys; events of unknown users are not loaded."""
    clean = lambda df: cleaning.with_user_keys(cleaning.clean_events(df, as_of), users)
    return run("events", raw, validation.EVENT_RULES, clean, existing, "insert_id", ["event_time", "distinct_id"], ["user_id"], as_of)


def run_files(
    spark: SparkSession, user_paths: Sequence[str], event_paths: Sequence[str], user_keys: Callable[[DataFrame], DataFrame], existing_users: DataFrame, existing_events: DataFrame
) -> tuple[Run, Run | None]:
    """Users, then events. `user_keys` turns loaded user rows into (user_id, distinct_id)."""
    raw_users, _ = files.combine(spark, user_paths)
    users = run_users(raw_users, existing_users)
    if not users.ok:
        return users, None
    raw_events, _ = files.combine(spark, event_paths)
    return users, run_events(files.flatten_records(raw_events), user_keys(users.rows), existing_events)
