"""Building blocks that stay balanced when one key holds a large share of the rows.

* `hot_keys`      - keys above a share of the table; their number is bounded by design
* `slice_hot`     - cuts the rows of hot keys into time slices
* `lag_in_slices`, `running_in_slices` - ordered window results over sliced keys
* `quantiles`     - exact quantiles without holding a hot group in one task
* `modes`         - most frequent value per key through pre-aggregated counts

Plain group-bys need no help (Spark combines on the map side), nor does
`row_number() <= k` (the planner inserts a group limit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], min_rows: int | None = None, max_keys: int | None = None
) -> DataFrame | None:
    """The at most `max_keys` largest keys with more than `min_rows` rows, or None without any.

    This is a statistics job that runs when the plan is built: one scan of the key
    columns, combined on the map side, and a bounded top-n. A key outside the top
    `max_keys` holds less than a 1/max_keys share of the rows, so nothing large is missed.
    The result is small enough to broadcast whatever the size of `df`.
    """
    min_rows = MIN_HOT_ROWS if min_rows is None else min_rows
    max_keys = MAX_HOT_KEYS if max_keys is None else max_keys
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)
    found = counts.orderBy(F.desc("_n")).limit(max_keys).select(*keys)
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; keeps the left side's key columns."""
    theirs = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in keys]
    joined = left.join(theirs, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_same_{c}" for c in keys])


def slice_hot(
    df: DataFrame, keys: Sequence[str], ts: str, slice_seconds: int = 300, min_rows: int | None = None
) -> DataFrame:
    """Adds `_slice` when some key is hot: 0 for ordinary keys, the time slice number for hot ones.

    Without hot keys the rows come back as they are and the helpers below are plain windows.
    """
    hot = hot_keys(df.select(*keys), keys, min_rows)
    if hot is None:
        return df
    number = F.floor(F.unix_micros(ts) / F.lit(slice_seconds * 1_000_000))
    return (
        join_same(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
        .withColumn("_slice", F.when(F.col("_hot"), number).otherwise(F.lit(0).cast("bigint")))
        .drop("_hot")
    )


def _carry(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    # Only hot keys have slices other than 0, so this stays a small side table.
    return df.filter(F.col("_slice") != 0).groupBy(*keys, "_slice").agg(*aggs)


def lag_in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Adds `out = lag(col)` per key for each out -> col, over the whole key.

    Within a slice this is a plain lag; the first row of a slice takes the last row
    of the slice before it, which is looked up from one row per (key, slice).
    `_first` marks rows without any predecessor.
    """
    packed = F.struct(*[F.col(c).alias(out) for out, c in columns.items()])
    if "_slice" not in df.columns:
        joined = df.withColumn("_prev", F.lag(packed).over(W.partitionBy(*keys).orderBy(*order)))
    else:
        w = W.partitionBy(*keys, "_slice").orderBy(*order)
        position = F.struct(*[F.col(c) for c in order])
        last = (
            _carry(df, keys, [F.max_by(packed, position).alias("_last")])
            .withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice")))
            .drop("_last")
        )
        joined = join_same(df.withColumn("_lag", F.lag(packed).over(w)), last, [*keys, "_slice"], "left")
        joined = joined.withColumn("_prev", F.coalesce("_lag", "_before")).drop("_lag", "_before")
    return joined.select(
        *df.columns, F.col("_prev").isNull().alias("_first"), *[F.col("_prev")[out].alias(out) for out in columns]
    )


def running_in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Adds `out = sum(expr)` from the first row of the key up to the current row."""
    kept = [c for c in df.columns if c not in columns]
    if "_slice" not in df.columns:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select(*kept, *[F.sum(expr).over(w).alias(out) for out, expr in columns.items()])
    w = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = _carry(df, keys, [F.sum(expr).alias(f"_t_{out}") for out, expr in columns.items()])
    totals = totals.select(*keys, "_slice", *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in columns])
    local = df.select("*", *[F.sum(expr).over(w).alias(f"_w_{out}") for out, expr in columns.items()])
    joined = join_same(local, totals, [*keys, "_slice"], "left")
    return joined.select(*kept, *[(F.col(f"_w_{o}") + F.coalesce(F.col(f"_b_{o}"), F.lit(0))).alias(o) for o in columns])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    min_rows: int | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one row per key, one column per name.

    Ordinary groups use the built-in exact percentile. Hot groups are bracketed first
    with the mergeable approximate sketch; only rows inside a bracket (about
    4/accuracy of the group) are ordered, the rest is merely counted.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        data, keys = data.withColumn("_all", F.lit(1)), ["_all"]
    names, ps = list(probs), [float(p) for p in probs.values()]
    hot = hot_keys(data.select(*keys), keys, min_rows)
    small = data if hot is None else join_same(data, F.broadcast(hot), keys, "left_anti")
    exact = small.groupBy(*keys).agg(F.percentile("_v", ps).alias("_q"))
    exact = exact.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if hot is None:
        return exact.drop("_all")

    big = join_same(data, F.broadcast(hot), keys, "left_semi")
    eps = 2.0 / accuracy
    bounds = [b for p in ps for b in (max(p - eps, 0.0), min(p + eps, 1.0))]
    brackets = big.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", bounds, accuracy).alias("_b")
    )  # one row per hot key
    tagged = join_same(big, F.broadcast(brackets), keys)
    lo = [F.col("_b")[2 * i] for i in range(len(ps))]
    hi = [F.col("_b")[2 * i + 1] for i in range(len(ps))]
    outside = tagged.groupBy(*keys, "_n").agg(
        *[F.count_if(F.col("_v") < lo[i]).alias(f"_below{i}") for i in range(len(ps))],
        *[F.max(F.when(F.col("_v") < lo[i], F.col("_v"))).alias(f"_left{i}") for i in range(len(ps))],
        *[F.min(F.when(F.col("_v") > hi[i], F.col("_v"))).alias(f"_right{i}") for i in range(len(ps))],
    )
    which = F.filter(
        F.array(*[F.when((F.col("_v") >= lo[i]) & (F.col("_v") <= hi[i]), F.lit(i)) for i in range(len(ps))]),
        lambda x: x.isNotNull(),
    )
    inside = tagged.select(*keys, "_v", F.explode(which).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("_cum", F.sum("_c").over(w)).transform(join_same, F.broadcast(outside), keys)
    pick: list[Column] = []
    for i, p in enumerate(ps):
        pos = F.lit(p) * (F.col("_n") - 1)
        mine = F.col("_i") == i
        upto, start = F.col(f"_below{i}") + F.col("_cum"), F.col(f"_below{i}") + F.col("_cum") - F.col("_c")
        for tag, rank in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            pick.append(F.max(F.when(mine & (start <= rank) & (rank < upto), F.col("_v"))).alias(f"_{tag}{i}"))
    picked = join_same(ranked.groupBy(*keys).agg(*pick), F.broadcast(outside), keys)
    cols = []
    for i, (name, p) in enumerate(zip(names, ps)):
        pos = F.lit(p) * (F.col("_n") - 1)
        low = F.coalesce(F.col(f"_f{i}"), F.col(f"_left{i}"))
        high = F.coalesce(F.col(f"_c{i}"), F.col(f"_right{i}"))
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    result = exact.unionByName(picked.select(*keys, *cols))
    return result.drop("_all")


def modes(df: DataFrame, keys: Sequence[str], attributes: Mapping[str, Column], distinct: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value of each attribute per key; smallest value on ties.

    All attributes share one shuffle of pre-aggregated (key, value) counts. Names in
    `distinct` also get a column `n_<name>` with their number of distinct values.
    """
    names = list(attributes)
    base = df.select(*keys, *[expr.alias(n) for n, expr in attributes.items()])
    counts = base.groupingSets([[*keys, n] for n in names], *keys, *names).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(n).alias(f"_g_{n}") for n in names]
    )
    mine = {n: (F.col(f"_g_{n}") == 0) & F.col(n).isNotNull() for n in names}
    best = [F.min(F.when(mine[n], F.struct((-F.col("_n")).alias("o"), F.col(n).alias("v")))).alias(n) for n in names]
    sizes = [F.count_if(mine[n]).alias(f"n_{n}") for n in distinct]
    packed = counts.groupBy(*keys).agg(*best, *sizes)
    return packed.select(*keys, *[F.col(n).getField("v").alias(n) for n in names], *[f"n_{n}" for n in distinct])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by key with a fixed number of partitions, ahead of a step that grows its
    input (small inputs would otherwise be merged into few partitions)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Rows of rank 1..k per key. Spark cuts to k rows per key and task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
