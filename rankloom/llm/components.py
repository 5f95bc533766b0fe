"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    spread = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return spread.unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the smallest node reachable, for every node with an edge.

    Self loops, repeated edges, either direction and null ends are accepted; a node without
    an edge to another node is not in the result.  Every round is a constant number of
    shuffles on node ids; minima are combined before the shuffle, and the joins are plain
    equi-joins whose hot keys the engine may split.  Each round is checkpointed.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        now = cut(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct())
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(state)
