"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, and those that others lead to have none."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the edges ``a, b``; the component is its least node.

    Each step gives every node an edge to the least node around it; all is joins and minima, so that a node of very many
    neighbours is summed before the shuffle and split by the skew join.  Edges at the end form stars around the least nodes.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).where("a != b").distinct()
        # small star: edges lead to smaller nodes
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = materialize(now, "edges")
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return materialize(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
