"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import cut


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs with the least of a and its b's, as column m; the minimum is combined before the shuffle."""
    least = pairs.groupBy("a").agg(F.min("b").alias("_m"))
    return pairs.join(least, "a").withColumn("m", F.least("a", "_m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node that it can reach.

    Each step replaces a node's links by links to its least neighbour, so the links never grow in number by more than a
    constant factor; they stay distributed, and each round is a checkpoint. The number of rounds is logarithmic.
    """
    now = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_least_neighbour(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        found = _least_neighbour(large)
        small = (found.select("a", F.col("m").alias("b"))
                 .union(found.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        now = cut(small)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(row)
