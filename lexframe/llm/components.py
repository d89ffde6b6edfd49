"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import keep


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one parent or is one, but not both."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("child")))
    return ends.groupBy("x").agg(F.sum("child").alias("parents"), F.min("child").alias("least")).where("parents > 1 or parents = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of the links (a, b), where the component is its smallest node.

    Alternating large and small stars: each step hangs the neighbours of a node from the smallest one, until the links
    are stars. Links stay in tables; the driver sees a yes or no of each step. Every step is written to the shared
    folder, so the lineage stays short and a lost executor costs one step.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # After the large star every link leads to a smaller node.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = keep(small, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
