"""Access to the graph by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def successors(edges: DataFrame) -> DataFrame:
    """edge_idx, next_edge: edges that leave where an edge ends."""
    return edges.select("edge_idx", F.col("dest").alias("node")).join(edges.select(F.col("edge_idx").alias("next_edge"), F.col("origin").alias("node")), "node").select("edge_idx", "next_edge")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, out_degree, in_degree, terminal (nothing leaves)."""
    out = edges.groupBy(F.col("origin").alias("node_idx")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dest").alias("node_idx")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = nodes.select("node_idx").join(out, "node_idx", "left").join(into, "node_idx", "left").fillna(0)
    return both.withColumn("terminal", F.col("out_degree") == 0)


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """node_idx, edge_idx, origin of edges that lead to each node."""
    return edges.select(F.col("dest").alias("node_idx"), "edge_idx", "origin")


def incident_edges(edges: DataFrame) -> DataFrame:
    """node_idx, edge_idx of edges that touch a node; a loop once."""
    return edges.select("edge_idx", F.explode(F.array_distinct(F.array("origin", "dest"))).alias("node_idx"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count("x").alias("n_placed"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("profile_id").alias("n_profiles"), F.min("base_weight").alias("least_weight"), F.max("base_weight").alias("most_weight"))
    return n.join(F.broadcast(e), F.lit(True)).withColumn("mean_degree", F.col("n_edges") / F.col("n_nodes"))  # one row each
