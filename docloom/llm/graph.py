"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014) on thin edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any ordered type -> rows (node, root): root is the least node of its component.

    Only nodes with an edge to another node come back, each once; self-loops, repeated edges and both directions are
    fine. edges should be a written table. Every round is a written table, so a lost executor costs one round; rounds
    end when all edges point at roots, each node at one.
    """
    now, own = edges.where("u <> v").select("u", "v"), None
    while True:
        after = stash(_small_star(_large_star(now)), "edges", thin=True)
        if own is not None:
            forget(own)
        now = own = after
        nodes = now.groupBy("u").agg(F.count("*").alias("n"))
        if now.select(F.col("v").alias("u")).join(nodes, "u", "left_semi").isEmpty() and nodes.where("n > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
