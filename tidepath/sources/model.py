"""The routing model: tables of nodes, edges, profiles and turn costs, their checks, and their Parquet form."""

from __future__ import annotations

from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timefn

NODES = "node_idx int, node_id string, x double, y double"
EDGES = "edge_idx int, edge_id string, origin int, dest int, base_weight float, profile_id int"
PROFILES = "profile_id int, day_mask int, buckets array<float>"
CALIBRATION = "profile_id int, confidence float, observation_count int, flavor string, last_observed_at long"
CALIBRATION_COLUMNS = ["profile_id", "confidence", "observation_count", "flavor", "last_observed_at"]
TURNS = "from_edge int, to_edge int, penalty float"


class ModelError(ValueError):
    """A model or option breaks its contract; `code` names the rule."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass
class Metadata:
    schema_version: int = 1
    model_version: str = "1"
    unit: str = "SECONDS"
    tick_ns: int = 1_000_000_000
    zone: str = "UTC"
    bucket_seconds: int = 3_600

    def check(self) -> Metadata:
        if self.schema_version != 1:
            raise ModelError("SCHEMA_VERSION", f"{self.schema_version}; 1 is read")
        if timefn.TICK_NS.get(self.unit) != self.tick_ns:
            raise ModelError("TICK_DURATION", f"{self.tick_ns} ns do not match {self.unit}")
        if not self.zone.strip():
            raise ModelError("TIMEZONE", "blank")
        try:
            ZoneInfo(self.zone)
        except Exception as e:
            raise ModelError("TIMEZONE", self.zone) from e
        return self


@dataclass
class Model:
    nodes: DataFrame
    edges: DataFrame
    profiles: DataFrame
    turns: DataFrame
    meta: Metadata = field(default_factory=Metadata)
    #: What is known of profiles beyond their shape, if anything: profile_id, confidence, observation_count, flavor, last_observed_at.
    calibration: DataFrame | None = None

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        for name in ("nodes", "edges", "profiles", "turns"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        if self.calibration is not None:
            self.calibration.select(*CALIBRATION_COLUMNS).write.parquet(f"{path}/calibration")
        spark.createDataFrame([tuple(vars(self.meta).values())], "schema_version int, model_version string, unit string, tick_ns long, zone string, bucket_seconds int").coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        meta = Metadata(**spark.read.parquet(f"{path}/meta").first().asDict()).check()
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        edges = read("edges", EDGES).withColumns({"base_weight": F.coalesce("base_weight", F.lit(0).cast("float")), "profile_id": F.coalesce("profile_id", F.lit(0))})
        return Model(read("nodes", NODES), edges, read("profiles", PROFILES), read("turns", TURNS), meta, read("calibration", CALIBRATION) if _exists(spark, f"{path}/calibration") else None)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _ahead(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """rows with _before, the sum of `value` over all rows that come before each in a total order.

    Rows are range-sorted and summed within their partitions; what the partitions before hold is a sum over one
    number for each of them. No task sees all rows.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_value", value)
    local = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    sizes = placed.groupBy("_pid").agg(F.sum("_value").alias("_n"))
    parts = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("_pid", F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_ahead"))
    return placed.join(ahead, "_pid").withColumn("_before", F.col("_ahead") + F.col("_local")).drop("_pid", "_value", "_local", "_ahead")


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids from 0 in a total order."""
    return _ahead(rows, order, F.lit(1)).withColumn(name, F.col("_before").cast("int")).drop("_before")


def scaled_profiles(raw: DataFrame) -> DataFrame:
    """profile_id, day_mask, buckets from raw profiles with a multiplier: buckets times multiplier, as float."""
    return raw.select("profile_id", "day_mask", F.transform("buckets", lambda b: (b.cast("double") * F.col("multiplier").cast("double")).cast("float")).alias("buckets"))


def last_turns(raw: DataFrame) -> DataFrame:
    """One row per (from_edge, to_edge), the last by ordinal; penalties may be infinite: the turn is forbidden."""
    return raw.groupBy("from_edge", "to_edge").agg(F.max_by("penalty", "ordinal").alias("penalty"))


def csr_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, first_edge, next_edge: the range of edge indices that leave each node, edges being sorted by origin."""
    degree = edges.groupBy(F.col("origin").alias("node_idx")).agg(F.min("edge_idx").alias("low"), F.count(F.lit(1)).cast("int").alias("degree"))
    joined = nodes.select("node_idx").join(degree, "node_idx", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return _ahead(joined, ["node_idx"], F.col("degree")).select("node_idx", F.col("_before").cast("int").alias("first_edge"), (F.col("_before") + F.col("degree")).cast("int").alias("next_edge"))


def origins_from_offsets(offsets: DataFrame) -> DataFrame:
    """edge_idx, origin from offset rows."""
    return offsets.filter("next_edge > first_edge").select(F.explode(F.sequence("first_edge", F.col("next_edge") - 1)).alias("edge_idx"), F.col("node_idx").alias("origin"))


def diagnose(model: Model) -> DataFrame:
    """level, code, subject for every breach found: unique and dense ids, ends that exist, weights, profiles, coordinates, isolated nodes."""
    nodes, edges, profiles = model.nodes, model.edges, model.profiles
    row = lambda df, level, code, subject: df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    twice = lambda df, key: df.groupBy(key).count().filter("count > 1")
    ends = edges.select(F.explode(F.array("origin", "dest")).alias("node_idx")).distinct()
    partial = nodes.agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("x"), F.count("y").alias("y")).filter("(x <> 0 and x <> n) or x <> y")
    dense = nodes.agg(F.min("node_idx").alias("a"), F.max("node_idx").alias("b"), F.countDistinct("node_idx").alias("n")).filter("n > 0 and (a <> 0 or b <> n - 1)")
    found = [
        row(twice(nodes, "node_id"), "error", "DUPLICATE_NODE_ID", F.col("node_id")),
        row(twice(edges, "edge_id"), "error", "DUPLICATE_EDGE_ID", F.col("edge_id")),
        row(twice(profiles, "profile_id"), "error", "DUPLICATE_PROFILE_ID", F.col("profile_id")),
        row(ends.join(nodes, "node_idx", "left_anti"), "error", "UNKNOWN_NODE", F.col("node_idx")),
        row(dense, "error", "NODE_IDS_NOT_DENSE", F.lit("nodes")),
        row(edges.filter("base_weight is null or isnan(base_weight) or base_weight < 0 or base_weight = float('infinity')"), "error", "BASE_WEIGHT", F.col("edge_id")),
        row(edges.filter("profile_id < 0 or profile_id > 65535"), "error", "PROFILE_ID_RANGE", F.col("edge_id")),
        row(edges.filter("profile_id <> 0").join(profiles, "profile_id", "left_anti"), "error", "UNKNOWN_PROFILE", F.col("edge_id")),
        row(profiles.filter("day_mask < 1 or day_mask > 127"), "error", "DAY_MASK", F.col("profile_id")),
        row(profiles.filter("size(buckets) = 0 or exists(buckets, b -> b is null or isnan(b) or b <= 0 or b = float('infinity'))"), "error", "BUCKETS", F.col("profile_id")),
        row(profiles.filter("profile_id = 0 and exists(buckets, b -> b <> 1)"), "error", "PROFILE_ZERO_NOT_NEUTRAL", F.col("profile_id")),
        row(partial, "error", "PARTIAL_COORDINATES", F.lit("nodes")),
        row(nodes.filter("isnan(x) or isnan(y)"), "error", "NAN_COORDINATES", F.col("node_id")),
        row(nodes.join(ends, "node_idx", "left_anti"), "warning", "ISOLATED_NODE", F.col("node_id")),
        row(nodes.filter("x is null").limit(1), "warning", "NO_COORDINATES", F.lit("nodes")),
        row(model.turns.filter("penalty is null or isnan(penalty) or penalty < 0"), "error", "TURN_PENALTY", F.concat_ws("-", "from_edge", "to_edge")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check_calibration(rows: DataFrame) -> DataFrame:
    """profile_id of override rows that break the rule: all three fields or none, a flavour other than NONE, confidence in [0, 1], a positive count."""
    given = F.col("confidence").isNotNull().cast("int") + F.col("observation_count").isNotNull().cast("int") + F.col("flavor").isNotNull().cast("int")
    bad = ~given.isin(0, 3) | ((given == 3) & ((F.col("flavor") == "NONE") | ~F.col("confidence").between(0, 1) | (F.col("observation_count") <= 0)))
    return rows.filter(bad).select("profile_id")
