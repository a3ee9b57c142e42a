"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.llm.support import cut


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root points anywhere."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of a link with the smallest node that it reaches.

    Each step points the neighbours of a node to the smallest of them, larger and smaller neighbours in turn; edges never
    grow in number and the steps grow as the logarithm of the longest path.  The minima are written before they are joined,
    so that Spark can split a node with very many links.  Nodes without links are not listed.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "lowest")
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = cut(large, "edges")
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select("v", "m").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
