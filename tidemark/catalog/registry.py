"""Registry of named queries with their DuckDB twins."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.inputs import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def with_views(sql: str) -> str:
    """Prefixes the logical tables a query mentions as common table expressions."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    views = [f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in used]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":  # says so once for all tables of the query
        views.append(body[15:].lstrip())
        return "WITH RECURSIVE " + ",\n".join(views)
    if body[:5].upper() == "WITH ":
        views.append(body[5:].lstrip())
        return "WITH " + ",\n".join(views)
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # all clocks of the engine are UTC
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
