"""Connected components of a graph given as a DataFrame of edges, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of an edge; edges: columns a and b of long.

    Large-star and small-star steps in turn: each joins every node's neighbours to the smallest of them, so that the edges
    shrink to stars in a number of rounds that grows with the logarithm of the size. Each step is one aggregation for the
    smallest neighbour (counted up before the shuffle) and one join; edges are written to the checkpoint folder every round.
    Nulls and loops are dropped.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        stars = small.select("m", F.explode(F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("a", "b"))).alias("a"))
        edges = checkpointed(stars.select("a", F.col("m").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
