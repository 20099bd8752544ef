"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Every operator takes an explicit clock; this is the default used with the sample tables.
AS_OF = "2024-01-31 00:00:00"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.useV1SourceList": "avro,csv,json,orc,parquet,text",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's SQL settings; `master` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master.partition("[")[2].rstrip("]")
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else str(os.cpu_count() or 8))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
