"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import cut


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the smallest node of its component.

    Each round ties a node's larger, then its smaller neighbours to the smallest one it knows; the edges end as stars around the
    roots. Minima are combined before each shuffle, so a node with many edges is no hot key there, and written before they are joined, so that
    the join can be split at such a node. Every round is checkpointed.
    """
    held = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = cut(large.where("u != v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        held = cut(small.where("u != v").distinct())
        state = held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
