"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherflow.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` run from the larger to the smaller node."""
    least = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), the root being the smallest node of its component; roots have no row.

    Each step joins every node with one row holding its smallest neighbour. Those rows are written first, so that the join has a shuffle on
    either side and a hub's rows can be split; they never form a list. It runs until no edge changes; the number of steps grows with the logarithm of the size."""
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or seen["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["h"])
        now = checkpoint(_small_star(_large_star(now)))
