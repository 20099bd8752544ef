"""Mixing sources to target weights, with DataFrame functions only.

Word counts are summed per source, targets follow from the weights, and target / source size is the
source's repetition rate. A document is emitted floor(rate) times, plus once more if its hash
falls below the rate's fraction. Several hash seeds are drawn per document and for each
source the seed whose total comes nearest to the target is used: every document keeps its
probability, and small sources with a few long documents still meet their targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stage import maybe_broadcast
from tidemark.llm.common import WORD, written

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words together
MOST = 2  # times a source's own size
SEEDS = 16


def words(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draws(key: str = "doc_id") -> list[Column]:
    """SEEDS numbers in [0, 2^32) from SHA-256 of the key, alike for equal keys; a null key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digests = [F.sha2(F.concat(F.lit(f"{block}:"), text), 256) for block in range(SEEDS // 8)]
    return [F.conv(F.substring(digests[i // 8], 1 + 8 * (i % 8), 8), 16, 10).cast("bigint") for i in range(SEEDS)]


def _running(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows before this one, by a distributed sort.

    Only the sums of the sort's partitions go through one window, never the rows.
    """
    names = df.columns
    fixed = written(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "mix-order")
    blocks = fixed.groupBy("_p").agg(F.sum(value).alias("_b"))
    ahead = F.sum("_b").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("_p", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum(value).over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, -1))
    summed = fixed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(blocks), "_p")  # one row per partition
    return summed.select(*names, (F.col("_ahead") + F.col("_inside")).alias(out))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _null_keys(rows: DataFrame) -> DataFrame:
    """Adds `_key` to rows without an id: the digest `_text` and the row's place by (digest, source).

    Equal rows take different places, so they draw apart; which of them takes which place changes no result.
    The last sort column splits a text that very many rows share over the tasks.
    """
    order = [F.col("_text"), F.col("source").asc_nulls_last(), F.monotonically_increasing_id()]
    placed = _running(rows.withColumn("_one", F.lit(1)), order, "_one", "_place")
    return placed.withColumn("_key", F.concat("_text", F.lit("#"), F.col("_place").cast("string"))).drop("_one", "_place")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights`, repeating. A target stops at `most`
    times its source's size and the excess goes to the others by weight until none is above:
    that is min(cap, weight * level) with one level for all, found by a running sum over the sources in
    the order in which they reach their caps. Needs 0 < share <= most.
    """
    if not 0 < share <= most:
        raise ValueError("share must be above 0 and at most `most`")
    by_name = F.col("source").asc_nulls_last()
    placed = _running(sizes.withColumn("_one", F.lit(1)), [by_name], "_one", "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight.cast("bigint"))
    by_cap = [F.col("source_size") / F.col("weight"), by_name]
    ranked = _running(_running(weighed, by_cap, "source_size", "_full"), by_cap, "weight", "_closed")
    every = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    words_in_all, weight_of_all = every[0] or 0, every[1] or 0
    cap = F.col("source_size") * F.lit(float(most))
    # The level if exactly the sources before this one are at their caps; it holds at the first source below its cap.
    level = (F.lit(words_in_all * float(share)) - F.col("_full") * F.lit(float(most))) / (F.lit(weight_of_all) - F.col("_closed"))
    held = ranked.filter(F.col("weight") * level < cap).agg(F.min_by(level, F.struct(F.col("source_size") / F.col("weight"), "_place"))).first()[0]
    target = cap if held is None else F.least(cap, F.col("weight") * F.lit(float(held)))
    return ranked.select("source", "source_size", target.alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    # The plan has one row per source: broadcast if its counted rows are few, an ordinary join otherwise.
    return rows.join(maybe_broadcast(plan.withColumnRenamed("source", "_source")), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def _fraction() -> Column:
    return (F.col("_rate") - F.floor("_rate")) * F.lit(2.0**32)


def copies(drawn: Column) -> Column:
    """Times a document is emitted, given its draw for the source's seed and the columns of the plan."""
    return F.floor("_rate").cast("bigint") + F.when(drawn < _fraction(), 1).otherwise(0)


def plan(docs: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, _key) per row, and per source: source_size, target, _rate and _seed; both written.

    `_key` is what a row draws by: its id, or digest and place of its text where the id is null.
    """
    no_id = docs["doc_id"].isNull()
    columns = ["doc_id", "source", words(docs["text"]).alias("size"), F.when(no_id, _digest(docs["text"])).alias("_text")]
    narrow = written(docs.select(*columns), "mix-sizes")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("doc_id").isNull()).alias("_nulls"))
    sums = written(sums, "mix-sources")
    aims = targets(sums.select("source", "source_size"), **kw)
    keyed = narrow.filter("doc_id is not null").withColumn("_key", F.col("doc_id").cast("string"))
    if sums.filter("_nulls > 0").count():
        keyed = keyed.unionByName(_null_keys(narrow.filter("doc_id is null")))
    narrow = keyed.drop("_text")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = written(aims.withColumn("_rate", rate), "mix-targets")
    rated = _with_plan(narrow.select("source", "size", *[d.alias(f"_d{i}") for i, d in enumerate(draws("_key"))]), aims.select("source", "_rate"))
    extra = [F.sum(F.when(F.col(f"_d{i}") < _fraction(), F.col("size")).otherwise(0)).alias(f"_s{i}") for i in range(SEEDS)]
    sums = rated.groupBy("source").agg(*extra).withColumnRenamed("source", "_source")
    both = aims.join(sums, aims["source"].eqNullSafe(F.col("_source")))
    aim = F.col("target") - F.floor("_rate") * F.col("source_size")
    miss = F.array(*[F.struct(F.abs(F.col(f"_s{i}") - aim).alias("by"), F.lit(i).alias("seed")) for i in range(SEEDS)])
    # The seed whose total comes nearest to the source's target, the first one on ties.
    seeded = both.select("source", "source_size", "target", "_rate", F.array_min(miss)["seed"].alias("_seed"))
    return narrow, written(seeded, "mix-plan")


def mixture_sizes(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) per row of `docs`.

    A null text has size 0; a null source is a source of its own; rows of one id draw alike, rows without an id
    each for itself. Documents of a source without any word are not taken. Other columns are ignored.
    """
    narrow, aims = plan(docs, **kw)
    drawn = F.element_at(F.array(*draws("_key")), F.col("_seed") + 1)
    return _with_plan(narrow, aims).select("doc_id", "size", "source_size", "target", (F.col("size") * copies(drawn)).alias("taken"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns as they are, also under clashing names."""
    aims = plan(docs, **kw)[1].select(F.struct("source", "_rate", "_seed").alias("_plan"))
    no_id = docs["doc_id"].isNull()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")  # names inside a struct clash with nothing
    rows = docs.select(row, docs["source"].alias("source"), docs["doc_id"].cast("string").alias("_key"), F.when(no_id, _digest(docs["text"])).alias("_text"))
    without = rows.filter("_key is null")
    parts = rows.filter("_key is not null")
    if not without.isEmpty():
        parts = parts.unionByName(_null_keys(without.drop("_key")))
    joined = parts.join(maybe_broadcast(aims), F.col("source").eqNullSafe(F.col("_plan.source")))
    rate = F.col("_plan._rate")
    drawn = F.element_at(F.array(*draws("_key")), F.col("_plan._seed") + 1)
    times = F.floor(rate).cast("int") + F.when(drawn < (rate - F.floor(rate)) * F.lit(2.0**32), 1).otherwise(0)
    repeated = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
