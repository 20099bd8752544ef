"""Operations panels over a request log (ts, method, path, status_code, duration_s, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import skew
from tidemark.operators.cleaning import endpoint_of

PANEL = "5 minutes"
# Upper bounds of the latency histograms in seconds.
REQUEST_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PREDICT_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0]


def with_endpoint(log: DataFrame) -> DataFrame:
    return log.withColumn("endpoint", endpoint_of(F.col("path")))


def window_start(width: str = PANEL) -> Column:
    return F.window("ts", width)["start"].alias("window_start")


def request_rates(log: DataFrame, by: Sequence[str] = ("endpoint", "method"), width: str = PANEL, seconds: int = 300) -> DataFrame:
    """Requests and requests per second by time window and label."""
    n = F.count(F.lit(1))
    return log.groupBy(window_start(width), *by).agg(n.alias("n"), (n / F.lit(float(seconds))).alias("per_second"))


def success_rates(log: DataFrame, by: Sequence[str] = (), width: str = PANEL) -> DataFrame:
    ok = F.count_if((F.col("status_code") >= 200) & (F.col("status_code") < 300))
    n = F.count(F.lit(1))
    return log.groupBy(window_start(width), *by).agg(n.alias("n"), (ok / n).alias("success_rate"))


def latency_quantiles(log: DataFrame, by: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Exact p50, p95 and p99 per label; a label with most of the traffic is bracketed first."""
    return skew.quantiles(log, by, "duration_s", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, min_rows=min_hot_rows)


def histogram(log: DataFrame, by: Sequence[str], buckets: Sequence[float] = REQUEST_BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound `le`, with an open last bucket."""
    bounds = [*buckets, float("inf")]
    counts = [F.count_if(F.col("duration_s") <= b) for b in bounds]
    entries = F.array(*[F.struct(F.lit(b).alias("le"), c.alias("n")) for b, c in zip(bounds, counts)])
    return log.groupBy(*by).agg(entries.alias("b")).select(*by, F.explode("b").alias("e")).select(*by, "e.le", "e.n")


def histogram_quantile(hist: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it.

    Windows run over the few buckets of a label.
    """
    w = W.partitionBy(*by).orderBy("le")
    total = F.max("n").over(W.partitionBy(*by))
    low, below = F.coalesce(F.lag("le").over(w), F.lit(0.0)), F.coalesce(F.lag("n").over(w), F.lit(0))
    rows = hist.select(*by, "le", "n", low.alias("low"), below.alias("below"), (total * q).alias("rank"), total.alias("total"))
    hit = rows.filter((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def means(log: DataFrame, columns: Sequence[str], by: Sequence[str], width: str = PANEL) -> DataFrame:
    return log.groupBy(window_start(width), *by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def cache_hit_rates(log: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return log.groupBy(*by).agg(n.alias("n"), (F.count_if("cache_hit") / n).alias("hit_rate"))


def error_counts(log: DataFrame, by: Sequence[str], width: str = PANEL) -> DataFrame:
    return log.filter(F.col("status_code") >= 500).groupBy(window_start(width), *by).agg(F.count(F.lit(1)).alias("n"))


def top_errors(log: DataFrame, by: str, k: int = 10, width: str = PANEL) -> DataFrame:
    counts = error_counts(log, [by], width)
    return skew.rank_rows(counts, ["window_start"], [F.desc("n"), F.asc(by)], k)


def recent_performance(log: DataFrame, last: int = 100, slow_ms: float = 1000.0) -> DataFrame:
    """The last requests of each endpoint: count, mean, min, max, index percentiles, slow flag.

    The cut to `last` rows per endpoint runs before the shuffle, so the sorted list is short.
    """
    rows = with_endpoint(log).select("endpoint", "ts", "id", (F.col("duration_s") * 1000).alias("ms"))
    tail = skew.rank_rows(rows, ["endpoint"], [F.desc("ts"), F.desc("id")], last, "_r")
    packed = tail.groupBy("endpoint").agg(F.array_sort(F.collect_list("ms")).alias("ms"))
    n = F.size("ms")
    at = lambda p: F.element_at("ms", (F.floor(n * p) + 1).cast("int"))
    mean = F.aggregate("ms", F.lit(0.0), lambda a, x: a + x) / n
    return packed.select(
        "endpoint",
        n.alias("n"),
        mean.alias("mean_ms"),
        F.array_min("ms").alias("min_ms"),
        F.array_max("ms").alias("max_ms"),
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
        (F.array_max("ms") > slow_ms).alias("has_slow"),
    )


def quota_violations(
    log: DataFrame, per_minute: int = 100, per_hour: int = 1000, min_hot_rows: int | None = None
) -> DataFrame:
    """Requests that exceed a client's sliding quotas, with the counts of the last 60 s and 3600 s.

    Counts include the request itself and the full interval [t - width, t]. Each request
    also sends one probe to t - 60 s and one to t - 3600 s; both counts are differences of one
    running count over requests and probes. Unlike a range frame this costs the same for
    any traffic, and the running count is cut into time slices for hot clients.
    """
    rows = log.select("client_key", "id", F.unix_micros("ts").alias("us"))
    # kind 0 and 1 are probes that sort before requests of the same time; kind 2 are requests.
    spots = F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("us") - 60_000_000).alias("at")),
        F.struct(F.lit(1).alias("kind"), (F.col("us") - 3_600_000_000).alias("at")),
        F.struct(F.lit(2).alias("kind"), F.col("us").alias("at")),
    )
    probes = rows.select("client_key", "id", F.explode(spots).alias("p")).select(
        "client_key", "id", "p.kind", F.timestamp_micros("p.at").alias("at"), (F.col("p.kind") == 2).alias("real")
    )
    sliced = skew.slice_hot(probes, ["client_key"], "at", min_rows=min_hot_rows)
    counted = skew.running_in_slices(sliced, ["client_key"], ["at", "kind", "id"], {"seen": F.col("real").cast("long")})
    # Requests of the same instant all count: take the largest running count at that instant.
    peak = counted.filter("kind = 2").groupBy("client_key", "at").agg(F.max("seen").alias("upto"))
    before = counted.filter("kind < 2").groupBy("client_key", "id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("seen"))).alias("b60"), F.max(F.when(F.col("kind") == 1, F.col("seen"))).alias("b3600")
    )
    requests = counted.filter("kind = 2").select("client_key", "id", "at").join(peak, ["client_key", "at"])
    counts = requests.join(before, ["client_key", "id"]).select(
        "client_key", "id", (F.col("upto") - F.col("b60")).alias("last_minute"), (F.col("upto") - F.col("b3600")).alias("last_hour")
    )
    return counts.filter((F.col("last_minute") > per_minute) | (F.col("last_hour") > per_hour))
