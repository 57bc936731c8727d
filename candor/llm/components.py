"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs to (node, root): root is the smallest node reachable; every node of an edge is listed once.

    Nulls and self loops are ignored; an empty edge table gives no rows. Each round joins the edges with each
    node's smallest neighbour (pre-aggregated before the shuffle) and writes the new edges to the checkpoint
    folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = saved(pairs.where("u > v").distinct())
    before = None
    for _ in range(most_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark or mark[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = saved(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
