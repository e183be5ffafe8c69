"""Connected components of an edge table whose nodes are values of any one orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.core import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node that links reach.

    In turns, the larger neighbours of each node move to its smallest neighbour, and then the smaller ones do. Every
    turn about halves the distance to the smallest node, so long chains take a number of turns that grows with the logarithm of their length.
    Loops, repeated and reversed edges are allowed.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    now, mark = stored(ordered(edges.select("a", "b"))), None
    while True:
        around = both_ways(now)
        lowest = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # A node's larger neighbours hang on the smallest of it and its neighbours.
        large = around.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ordered(large.unionByName(lowest.select("a", F.col("m").alias("b"))))
        # Then a node and its smaller neighbours hang on the smallest of these.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        now = stored(ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
