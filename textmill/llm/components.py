"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Hooks the larger neighbours of every vertex to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m")).hint("rebalance")  # apart from the sums: a hot vertex can be split in the join
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Hooks every vertex and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: a, b (long) -> v, root: the least vertex of v's component, for each v that isn't a root.

    The number of rounds grows with the logarithm of the longest path. Between rounds the edges are a written table, so
    plans stay short; the driver sees two sums a round.
    """
    state = scratch.write(f"{name}-0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before, k = None, 0
    while True:
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return state.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before, k = seen, k + 1
        state = scratch.write(f"{name}-{k}", _small(_large(state)))
        scratch.drop(f"{name}-{k - 1}")
