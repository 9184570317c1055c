"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a minimum per node (partial aggregation) and a join; neither
gathers the neighbours of a node. The number of rounds grows with the
logarithm of a component's size. Every round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node."""
    now = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().transform(cut_lineage)
    seen = _state(now)
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = (small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))).distinct().transform(cut_lineage))
        state = _state(now)
        if state == seen:
            break
        seen = state
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    tops = stars.select(F.col("component").alias("node")).distinct()
    return (stars.select(F.col("u").alias("node"), "component")
            .unionByName(tops.select("node", F.col("node").alias("component"))))
