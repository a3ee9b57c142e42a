"""Network tables: integrity, filters, hop neighbourhoods and portfolio rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.functions.labels import health
from wattloom.session import cut_lineage


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a network: repeated node ids and edge ends without a node."""
    repeated = nodes.groupBy("node_id").count().filter("count > 1").select("node_id", F.lit("duplicate_node").alias("problem"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    dangling = ends.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", F.lit("dangling_endpoint").alias("problem"))
    return repeated.unionByName(dangling)


def members(nodes: DataFrame, substation: str, kind: str) -> DataFrame:
    return nodes.filter((F.col("substation_id") == substation) & (F.col("kind") == kind))


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def neighborhood(edges: DataFrame, start: str, radius: int) -> DataFrame:
    """Nodes within ``radius`` undirected hops of one node, with their hop count.

    Each hop joins only the newest frontier, so the work is the number of edges met.  A neighbour of the frontier lies
    in it, one hop before or one hop after, hence two levels are excluded.  Every frontier is written to the shared
    folder: the plan stays short and a lost executor costs one hop.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if both.filter(F.col("src") == start).isEmpty():
        raise ValueError(f"unknown node: {start}")
    level = edges.sparkSession.range(1).select(F.lit(start).alias("node_id"))
    levels = [level]
    for _ in range(radius):
        found = both.join(levels[-1].select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        for known in levels[-2:]:
            found = found.join(known, "node_id", "left_anti")
        levels.append(cut_lineage(found, "frontier"))
    out = level.withColumn("hops", F.lit(0))
    for hop, nodes in enumerate(levels[1:], 1):
        out = out.unionByName(nodes.withColumn("hops", F.lit(hop)))
    return out


def portfolio(nodes: DataFrame) -> DataFrame:
    """Meters, batteries and meter health per substation in one aggregate."""
    meter = F.col("kind") == "meter"
    h = health(F.col("mape"))
    return nodes.groupBy("substation_id").agg(
        F.count_if(meter).alias("n_meters"), F.count_if(F.col("kind") == "bess").alias("n_bess"), F.count_if(F.col("kind") == "feeder").alias("n_feeders"),
        *[F.count_if(meter & (h == c)).alias(f"n_{c}") for c in ("green", "amber", "red")])
