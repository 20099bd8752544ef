"""Evaluation of recommendation lists and fitted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cf, scoring


def list_diversity(recs: DataFrame, k: int = 5) -> DataFrame:
    """Distinct top-k lists over users, with a verdict."""
    top = recs.filter(F.col("rank") <= k).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    lists = top.select(F.transform("l", lambda e: e["item_id"]).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    row = lists.agg(F.sum("n").alias("users"), F.count(F.lit(1)).alias("distinct_lists"))
    ratio = F.try_divide(F.col("distinct_lists"), F.col("users"))
    return row.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio > 0.5, "personal").when(ratio > 0.3, "partly").otherwise("uniform"))


def head_share(popularity: DataFrame, k: int = 3) -> DataFrame:
    head = popularity.orderBy(F.desc(F.round("popularity", 10)), "item_id").limit(k)
    return head.agg(F.sum("popularity").alias("share"), F.max("popularity").alias("top"))


def item_similarity_summary(pairs: DataFrame) -> DataFrame:
    """Mean of the positive similarities of different items, and the largest."""
    return pairs.agg(F.avg(F.when(F.col("sim") > 0, F.col("sim"))).alias("mean_sim"), F.max("sim").alias("max_sim"))


def matrix_summary(weights: DataFrame) -> DataFrame:
    return cf.matrix_info(weights)


def compare_models(first: DataFrame, second: DataFrame, metric: str, better: float = 1.2) -> DataFrame:
    """Two one-row metric tables: delta, ratio and a verdict."""
    a, b = first.select(F.col(metric).alias("first")), second.select(metric).scalar()
    row = a.withColumn("second", b)
    verdict = F.when(F.col("second") > F.col("first") * better, "better").when(F.col("second") * better < F.col("first"), "worse").otherwise("similar")
    return row.select("first", "second", (F.col("second") - F.col("first")).alias("delta"), verdict.alias("verdict"))


def user_coverage(recs: DataFrame, users: DataFrame) -> DataFrame:
    """Share of users with a list, and the mean list length of those."""
    sizes = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    row = users.select("user_id").join(sizes, "user_id", "left")
    return row.agg(
        F.count(F.lit(1)).alias("users"), F.try_divide(F.count("n"), F.count(F.lit(1))).alias("success_rate"), F.avg("n").alias("mean_length")
    )


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """precision@k, recall@k and ndcg@k, averaged over users with test items."""
    relevant = truth.select("user_id", "item_id").distinct()
    wanted = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("wanted"))
    hits = recs.filter(F.col("rank") <= k).join(relevant, ["user_id", "item_id"], "left_semi")
    per = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = sum((F.when(F.col("wanted") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
    rows = wanted.join(per, "user_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0))})
    return rows.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg(F.col("hits") / F.lit(float(k))).alias("precision"),
        F.avg(F.col("hits") / F.col("wanted")).alias("recall"),
        F.avg(F.col("dcg") / ideal).alias("ndcg"),
    )


def catalogue_coverage(recs: DataFrame, items: DataFrame) -> DataFrame:
    used = recs.select("item_id").distinct()
    return items.select("item_id").join(used.withColumn("u", F.lit(1)), "item_id", "left").agg(F.try_divide(F.count("u"), F.count(F.lit(1))).alias("coverage"))


def intra_list_diversity(recs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """1 - share of equal-category pairs per list, averaged; from category counts, not from pairs."""
    rows = recs.filter(F.col("rank") <= k).join(items.select("item_id", "category"), "item_id")
    sizes = rows.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("c"))
    per = sizes.groupBy("user_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return per.filter("n > 1").agg(F.avg(1 - F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def top_lists(scores: DataFrame, k: int) -> DataFrame:
    return scoring.top_k(scores, k)
