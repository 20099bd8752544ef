"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    # Every neighbour above u is linked to the smallest node around u.
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every neighbour below u, and u itself, is linked to the smallest of them.
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of an edge that has another end; root is the smallest node reachable.

    Loops and null ends count as no edge; nodes without edges do not appear. Each round is
    written to the shared folder, so lineage stays short; the work of a round is in
    proportion to the edges, also for nodes with very many of them. The number of rounds
    grows with the logarithm of the longest path.
    """
    a, b = F.col(left), F.col(right)
    now = written(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(row)
        after = written(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
