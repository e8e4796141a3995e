"""Weakly connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.plans.shared import cut_and_sum, forget


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge whose root differs from itself; root is the smallest node reachable.

    Each round is two shuffles with map-side combining; its result is written to the shared folder, so the
    plan stays short and lost executors cost one round at most. Nodes that are their own root are left out,
    which keeps the result no larger than the edges. Self-loops and nulls are ignored.
    """
    a, b = F.col(src), F.col(dst)
    mark = {"n": F.count("*"), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}  # of the rows, in any order
    star, before = cut_and_sum(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc", **mark)
    for _ in range(max_rounds):
        last = star
        star, after = cut_and_sum(_small_star(_large_star(last)), "cc", **mark)
        forget(last)
        if after == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
