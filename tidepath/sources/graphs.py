"""Routing models derived from the star-schema tables: a trade network of nations with profiles and overlays from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model, dense_ids

#: Event types in the order of profile ids 1 to 5, and the day mask of each.
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
DAY_MASKS = (127, 31, 96, 62, 127)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("int").alias("node_idx"), F.col("n_name").alias("node_id"), (k * 37 % 120 - 60).cast("double").alias("x"), (k * 53 % 300 - 150).cast("double").alias("y"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each supplier nation to each other customer nation it has line items for; weight by their number."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").cast("int").alias("origin"), F.col("c_nationkey").cast("int").alias("dest")).agg(F.count(F.lit(1)).alias("n"))
    edges = dense_ids(pairs, ["origin", "dest"], "edge_idx")
    return edges.select("edge_idx", F.format_string("E%d-%d", "origin", "dest").alias("edge_id"), "origin", "dest", (20 * (1 + F.col("n") % 97)).cast("float").alias("base_weight"), (1 + F.col("origin") % 5).alias("profile_id"))


def region_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(k.cast("int").alias("node_idx"), F.col("r_name").alias("node_id"), (k * 10).cast("double").alias("x"), (k * k).cast("double").alias("y"))


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade network by region: an edge from each supplier region to each other customer region, weighted like those of nations by the line items between them."""
    t = lambda n: table(spark, sf_dir, n)
    of = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_regionkey").cast("int").alias(name))
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(of("s_nationkey", "origin"), "s_nationkey").join(of("c_nationkey", "dest"), "c_nationkey")
    edges = dense_ids(pairs.filter("origin <> dest").groupBy("origin", "dest").agg(F.sum("n").alias("n")), ["origin", "dest"], "edge_idx")
    return edges.select("edge_idx", F.format_string("R%d-%d", "origin", "dest").alias("edge_id"), "origin", "dest", (20 * (1 + F.col("n") % 97)).cast("float").alias("base_weight"), (1 + F.col("origin") % 5).alias("profile_id"))


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of 24 hourly buckets per event type: 1 + (events of the hour of day modulo 16) / 16, exact in float. Events without a time are in no bucket."""
    kind = F.col("event_type")
    ids = F.element_at(F.create_map(*[x for i, k in enumerate(EVENT_TYPES) for x in (F.lit(k), F.lit(i + 1))]), kind)
    counts = table(spark, sf_dir, "events").groupBy(ids.alias("profile_id"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).filter("profile_id is not null")
    per = counts.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("hour").isNotNull(), F.struct("hour", "n")))).alias("m"))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (1.0 + (F.coalesce(F.element_at("m", h), F.lit(0)) % 16) / 16.0).cast("float"))
    return per.select("profile_id", F.element_at(F.array(*[F.lit(m) for m in DAY_MASKS]), F.col("profile_id")).alias("day_mask"), buckets.alias("buckets"))


def trade_turns(edges: DataFrame) -> DataFrame:
    """Turn penalties of the trade network, by the nations a turn comes from and leads to: some cost 5, some are forbidden."""
    a, b = edges.alias("a"), edges.alias("b")
    key = F.col("a.origin") + F.col("b.dest")
    penalty = F.when(key % 13 == 0, F.lit(float("inf"))).when(key % 11 == 0, F.lit(5.0)).otherwise(F.lit(0.0)).cast("float")
    return a.join(b, F.col("a.dest") == F.col("b.origin")).select(F.col("a.edge_idx").alias("from_edge"), F.col("b.edge_idx").alias("to_edge"), penalty.alias("penalty")).filter("penalty <> 0")


def trade_model(spark: SparkSession, sf_dir: str) -> Model:
    edges = trade_edges(spark, sf_dir)
    return Model(nation_nodes(spark, sf_dir), edges, event_profiles(spark, sf_dir), trade_turns(edges))


def event_updates(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """Live updates from all events: edge_idx, speed_factor, valid_from, valid_until, ordinal. Errors block, clicks and purchases slow."""
    n = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    speed = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "click", 0.25).when(F.col("event_type") == "purchase", 0.5).otherwise(1.0).cast("float")
    start = F.unix_timestamp("ts")
    events = table(spark, sf_dir, "events").join(F.broadcast(n), F.lit(True))  # a table of one row
    return events.select((F.col("event_id") % F.col("n_edges")).cast("int").alias("edge_idx"), speed.alias("speed_factor"), start.alias("valid_from"), (start + 3600).alias("valid_until"), F.col("event_id").alias("ordinal"))
