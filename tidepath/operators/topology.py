"""Changes of the topology, quarantine of failures, and publication of versions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model import Model, ModelError, dense_ids, diagnose

QUARANTINE = "kind string, subject_idx int, valid_until long, observed_at long, reason string, source string"


@dataclass
class ChangeSet:
    """Rows to remove (ids), add (full rows) and change (id and new values, null keeps); any part may be None. policy: ATOMIC_RELOAD publishes, VALIDATE_ONLY does not."""

    remove_nodes: DataFrame | None = None
    remove_edges: DataFrame | None = None
    add_nodes: DataFrame | None = None
    add_edges: DataFrame | None = None
    change_edges: DataFrame | None = None
    add_turns: DataFrame | None = None
    remove_turns: DataFrame | None = None
    policy: str = "ATOMIC_RELOAD"


def check_changes(changes: ChangeSet) -> DataFrame | None:
    """reason_code, subject of parts that name an id twice or remove and add the same one; None if there is nothing to check."""
    found = []
    for what, key in (("nodes", "node_id"), ("edges", "edge_id")):
        gone, new = getattr(changes, f"remove_{what}"), getattr(changes, f"add_{what}")
        for part in (gone, new, changes.change_edges if what == "edges" else None):
            if part is not None:
                found.append(part.groupBy(key).count().filter("count > 1").select(F.lit("CHANGE_DUPLICATE").alias("reason_code"), F.col(key).alias("subject")))
        if gone is not None and new is not None:
            found.append(gone.select(key).intersect(new.select(key)).select(F.lit("CHANGE_CONFLICT").alias("reason_code"), F.col(key).alias("subject")))
    out = found[0] if found else None
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def apply_changes(nodes: DataFrame, edges: DataFrame, turns: DataFrame, changes: ChangeSet) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node_id, x, y), edges (edge_id, origin_id, dest_id, base_weight, profile_id, ordinal) and turns (from_id, to_id, penalty) by external ids, after removals, their cascades, additions and changes.

    A removed node takes its edges with it, a removed edge its turns. Added rows come after the existing ones.
    """
    if changes.remove_nodes is not None:
        gone = changes.remove_nodes.select("node_id")
        nodes = nodes.join(gone, "node_id", "left_anti")
        edges = edges.join(gone.withColumnRenamed("node_id", "origin_id"), "origin_id", "left_anti").join(gone.withColumnRenamed("node_id", "dest_id"), "dest_id", "left_anti")
    if changes.remove_edges is not None:
        edges = edges.join(changes.remove_edges.select("edge_id"), "edge_id", "left_anti")
    left = edges.select("edge_id")
    if changes.add_nodes is not None:
        nodes = nodes.unionByName(changes.add_nodes)
    if changes.add_edges is not None:
        edges = edges.unionByName(changes.add_edges)
        left = edges.select("edge_id")
    if changes.change_edges is not None:
        new = changes.change_edges.select("edge_id", F.col("base_weight").alias("_w"), F.col("profile_id").alias("_p"))
        edges = edges.join(new, "edge_id", "left").withColumns({"base_weight": F.coalesce("_w", "base_weight"), "profile_id": F.coalesce("_p", "profile_id")}).drop("_w", "_p")
    turns = turns.join(left.withColumnRenamed("edge_id", "from_id"), "from_id", "left_semi").join(left.withColumnRenamed("edge_id", "to_id"), "to_id", "left_semi")
    if changes.remove_turns is not None:
        turns = turns.join(changes.remove_turns.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    if changes.add_turns is not None:
        turns = turns.join(changes.add_turns.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").unionByName(changes.add_turns)
    return nodes, edges, turns


def external(model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model's nodes, edges and turns by external ids, as apply_changes takes them."""
    name = lambda side: model.nodes.select(F.col("node_idx").alias(side), F.col("node_id").alias(f"{side}_id"))
    edges = model.edges.join(name("origin"), "origin").join(name("dest"), "dest").select("edge_id", "origin_id", "dest_id", "base_weight", "profile_id", F.col("edge_idx").alias("ordinal"))
    of = lambda side: model.edges.select(F.col("edge_idx").alias(f"{side}_edge"), F.col("edge_id").alias(f"{side}_id"))
    turns = model.turns.join(of("from"), "from_edge").join(of("to"), "to_edge").select("from_id", "to_id", "penalty")
    return model.nodes.select("node_id", "x", "y"), edges, turns


def compile_model(nodes: DataFrame, edges: DataFrame, profiles: DataFrame, turns: DataFrame, meta) -> Model:
    """Dense indices: nodes by id, edges by origin and then source order; ends and turns by index."""
    nodes = dense_ids(nodes, ["node_id"], "node_idx")
    idx = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("node_idx").alias(side))
    placed = edges.join(idx("origin"), "origin_id", "left").join(idx("dest"), "dest_id", "left")
    placed = dense_ids(placed, ["origin", "ordinal", "edge_id"], "edge_idx").select("edge_idx", "edge_id", F.coalesce("origin", F.lit(-1)).alias("origin"), F.coalesce("dest", F.lit(-1)).alias("dest"), "base_weight", "profile_id")
    of = lambda side: placed.select(F.col("edge_id").alias(f"{side}_id"), F.col("edge_idx").alias(f"{side}_edge"))
    turns = turns.join(of("from"), "from_id").join(of("to"), "to_id").select("from_edge", "to_edge", "penalty")
    return Model(nodes.select("node_idx", "node_id", "x", "y"), placed, profiles, turns, meta)


def last_failures(events: DataFrame) -> DataFrame:
    """One row per subject, the last by observed_at, then the longest."""
    return events.groupBy("kind", "subject_idx").agg(F.max(F.struct("observed_at", "valid_until", "reason", "source")).alias("q")).select("kind", "subject_idx", "q.*")


def active_failures(quarantine: DataFrame, now: int) -> DataFrame:
    return quarantine.filter(F.col("valid_until") > now)


def clear_failures(quarantine: DataFrame) -> DataFrame:
    """The quarantine without any failure."""
    return quarantine.limit(0)


def failed_edges(quarantine: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """edge_idx, valid_until of edges out of use: failed themselves or at a failed node, until the last of these ends."""
    live = active_failures(quarantine, now)
    touch = edges.select("edge_idx", F.explode(F.array_distinct(F.array("origin", "dest"))).alias("subject_idx"))
    by_node = touch.join(live.filter("kind = 'node'"), "subject_idx").select("edge_idx", "valid_until")
    by_edge = live.filter("kind = 'edge'").select(F.col("subject_idx").alias("edge_idx"), "valid_until").join(edges.select("edge_idx"), "edge_idx", "left_semi")
    return by_node.unionByName(by_edge).groupBy("edge_idx").agg(F.max("valid_until").alias("valid_until"))


def failure_updates(quarantine: DataFrame, edges: DataFrame, now: int, clip: Column | None = None) -> DataFrame:
    """Overlay entries that block failed edges from now on, at most until clip."""
    until = F.col("valid_until") if clip is None else F.least("valid_until", clip)
    return failed_edges(quarantine, edges, now).select("edge_idx", F.lit(0.0).cast("float").alias("speed_factor"), F.lit(now).cast("long").alias("valid_from"), until.alias("valid_until")).filter("valid_until > valid_from")


def failure_summary(quarantine: DataFrame, now: int) -> DataFrame:
    """n_active, observed_at (the latest), tags: sorted distinct reasons and sources, one row."""
    live = active_failures(quarantine, now)
    return live.agg(F.count(F.lit(1)).alias("n_active"), F.max("observed_at").alias("observed_at"), F.array_sort(F.array_union(F.collect_set("reason"), F.collect_set("source"))).alias("tags"))


def carry_over(entries: DataFrame, key: str, old: DataFrame, new: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    """entries of an old version keyed by index, under the new version's index of the same external id; those of removed subjects go."""
    ids = old.select(F.col(idx_col).alias(key), id_col).join(new.select(id_col, F.col(idx_col).alias("_new")), id_col).select(key, "_new")
    return entries.join(ids, key).withColumn(key, F.col("_new")).drop("_new").select(*entries.columns)


def granularity_ok(bucket_seconds: int, ticks_per_second: int, drift_ticks: int) -> bool:
    """Half a bucket, rounded up, may not pass the drift budget."""
    return (bucket_seconds * ticks_per_second + 1) // 2 <= drift_ticks


def version_of(model: Model) -> str:
    """A hash of all rows: equal content, equal version, whatever the order of rows."""
    total = []
    for name in ("nodes", "edges", "profiles", "turns", *(["calibration"] if model.calibration is not None else [])):
        df = getattr(model, name)
        digest = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("decimal(38,0)")
        total.append(df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("string"))).first()[0])
    return hashlib.sha256("|".join(total).encode()).hexdigest()


class Publisher:
    """Versions of a model below a folder. A version is written whole, checked by gates, then a pointer file names it: readers see the old or the new one."""

    def __init__(self, spark: SparkSession, root: str, gates: list[Callable[[Model], str | None]] | None = None):
        self.spark, self.root, self.gates = spark, root.rstrip("/"), gates or []

    def publish(self, model: Model, policy: str = "ATOMIC_RELOAD") -> str:
        broken = diagnose(model).filter("level = 'error'").select("code", "subject").limit(5).collect()
        if broken:
            raise ModelError("TOPOLOGY_INVALID", "; ".join(f"{r.code} {r.subject}" for r in broken))
        for gate in self.gates:
            if why := gate(model):
                raise ModelError("TOPOLOGY_GATE", why)
        version = version_of(model)
        if policy == "VALIDATE_ONLY":
            return version
        if version not in self._versions():
            model.meta = replace(model.meta, model_version=version)
            model.save(f"{self.root}/versions/{version}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{self.root}/pointers/{self._next():012d}")
        return version

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self) -> list[str]:
        return self._list("versions")

    def _next(self) -> int:
        return len(self._list("pointers"))

    def current(self) -> Model:
        pointers = self._list("pointers")
        if not pointers:
            raise ModelError("TOPOLOGY_NONE")
        return Model.load(self.spark, f"{self.root}/versions/{self.spark.read.parquet(f'{self.root}/pointers/{pointers[-1]}').first().version}")
