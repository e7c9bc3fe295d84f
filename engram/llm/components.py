"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.stages import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that (a, b) edges reach from it. Nodes without edges don't appear.

    Large-star and small-star rounds: neighbours are linked to the smallest node around until nothing changes, in about
    as many rounds as the logarithm of the longest path. A node's neighbours are never gathered: each round takes a
    minimum per node (combined before the shuffle) and joins it back, and a hub's rows can be split in that join.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")  # every edge now points to a smaller node
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        down = materialize(down, "least")
        small = large.join(down.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialize(small.filter("a <> b").distinct(), "small-star")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
