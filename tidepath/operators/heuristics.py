"""Lower bounds of route costs: by geometry and by landmarks. They prune, and never change an answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.model import Model, ModelError
from ..staging import stage


def least_multiplier(buckets: Column, day_mask: Column) -> Column:
    """The least multiplier of the week: days that the mask leaves out count as 1, an unknown profile is 1."""
    low = F.array_min(buckets).cast("double")
    return F.when(buckets.isNull(), F.lit(1.0)).when(day_mask != 127, F.least(low, F.lit(1.0))).otherwise(low)


def bound_weights(model: Model) -> DataFrame:
    """edge_idx, origin, dest, bound: no cost of entering the edge is ever less."""
    edges = model.edges.join(model.profiles, "profile_id", "left")
    return edges.select("edge_idx", "origin", "dest", (F.col("base_weight").cast("double") * F.least(least_multiplier(F.col("buckets"), F.col("day_mask")), F.lit(1.0))).alias("bound"))


def _distance(kind: str):
    return {"EUCLIDEAN": geo.euclidean, "SPHERICAL": geo.great_circle_m}[kind]


def geometry_ratio(model: Model, kind: str) -> DataFrame:
    """ratio, n_edges: the least cost per unit of distance over edges of positive length, one row; null without such edges."""
    edges = model.edges.join(model.profiles, "profile_id", "left")
    ends = lambda side: model.nodes.select(F.col("node_idx").alias(side), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    placed = edges.join(ends("origin"), "origin").join(ends("dest"), "dest")
    d = _distance(kind)(F.col("origin_x"), F.col("origin_y"), F.col("dest_x"), F.col("dest_y"))
    cost = F.col("base_weight").cast("double") * least_multiplier(F.col("buckets"), F.col("day_mask"))
    return placed.withColumn("d", d).filter("d > 0").agg(F.min(cost / F.col("d")).alias("ratio"), F.count(F.lit(1)).alias("n_edges"))


def geometry_bounds(pairs: DataFrame, model: Model, kind: str) -> DataFrame:
    """source, target, bound of node pairs: distance times the calibrated ratio; NONE gives 0."""
    if kind == "NONE":
        return pairs.select("source", "target", F.lit(0.0).alias("bound"))
    if kind not in ("EUCLIDEAN", "SPHERICAL"):
        raise ModelError("HEURISTIC_TYPE", kind)
    at = lambda side: model.nodes.select(F.col("node_idx").alias(side), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    ratio = F.broadcast(geometry_ratio(model, kind).select("ratio"))  # one row
    rows = pairs.join(at("source"), "source").join(at("target"), "target").join(ratio, F.lit(True))
    raw = _distance(kind)(F.col("source_x"), F.col("source_y"), F.col("target_x"), F.col("target_y")) * F.col("ratio")
    return rows.select("source", "target", F.when(geo.finite(raw), raw).otherwise(F.lit(0.0)).alias("bound"))


@dataclass(frozen=True)
class Guide:
    """Lower bounds for a search: nodes has node_idx and info, and bound(info of a node, info of a target) is a Column that no route between them costs less than; null is no bound."""

    nodes: DataFrame
    bound: Callable[[Column, Column], Column]


def check_coordinates(model: Model, kind: str) -> None:
    """Raises unless all coordinates are finite and, for SPHERICAL, degrees in range; a model without any has no geometry either."""
    good = geo.finite(F.col("x"), F.col("y"))
    if kind == "SPHERICAL":
        good = good & geo.valid_lat_lon(F.col("x"), F.col("y"))
    one = model.nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good")).first()
    if one.good != one.n or not one.n:
        raise ModelError("HEURISTIC_COORDINATES", f"{one.n - one.good} of {one.n} nodes")


def geometry_guide(model: Model, kind: str) -> Guide:
    """Distance times the least cost per unit of distance."""
    check_coordinates(model, kind)
    ratio = geometry_ratio(model, kind).first().ratio or 0.0
    bound = lambda a, b: _distance(kind)(a["x"], a["y"], b["x"], b["y"]) * ratio
    return Guide(model.nodes.select("node_idx", F.struct("x", "y").alias("info")), bound)


def landmark_guide(model: Model, table: DataFrame | None = None, count: int = 8) -> Guide:
    """Triangle bounds over the landmarks of a table, or of `count` that are computed here."""
    table = landmark_table(model, count) if table is None else table
    n = table.agg(F.max("landmark_pos")).first()[0] or 0
    side = lambda c: F.array(*[F.max(F.when(F.col("landmark_pos") == i, F.col(c))) for i in range(n + 1)])
    nodes = stage(table.groupBy("node_idx").agg(F.struct(side("fwd").alias("f"), side("bwd").alias("b")).alias("info")), "landmark-nodes")
    zero = F.lit(0.0)

    def bound(a: Column, b: Column) -> Column:
        each = [x for i in range(n + 1) for x in (F.coalesce(b["f"][i] - a["f"][i], zero), F.coalesce(a["b"][i] - b["b"][i], zero))]
        return F.greatest(zero, *each)

    return Guide(nodes, bound)


def guide_for(model: Model, kind: str, landmarks: DataFrame | None = None) -> Guide | None:
    """The guide of a heuristic's name: NONE, EUCLIDEAN, SPHERICAL or LANDMARK."""
    if kind == "NONE":
        return None
    if kind == "LANDMARK":
        return landmark_guide(model, landmarks)
    if kind in ("EUCLIDEAN", "SPHERICAL"):
        return geometry_guide(model, kind)
    raise ModelError("HEURISTIC_TYPE", kind)


def choose_landmarks(model: Model, count: int, seed: str = "landmarks") -> DataFrame:
    """landmark_pos, landmark: nodes with edges first, then by a hash of the seed and the node."""
    out = model.edges.groupBy(F.col("origin").alias("node_idx")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = model.nodes.select("node_idx").join(out, "node_idx", "left").withColumn("none", F.col("degree").isNull()).withColumn("key", F.md5(F.concat(F.lit(seed), F.col("node_idx").cast("string"))))
    top = nodes.orderBy("none", "key", "node_idx").limit(count)
    return top.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("none", "key", "node_idx")) - 1).alias("landmark_pos"), F.col("node_idx").alias("landmark"))


def _relax(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """way, source, node, distance: least sums of `bound` from each start (way, source) over steps (way, node, next, bound). All starts advance together, a staged table a round."""
    best = stage(starts.select("way", "source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")), "distances")
    steps = stage(steps, "steps")
    while not best.filter("fresh").isEmpty():
        reach = best.filter("fresh").join(steps, ["way", "node"]).select("way", "source", F.col("next").alias("node"), (F.col("distance") + F.col("bound")).alias("distance"), F.lit(True).alias("new"))
        both = best.select("way", "source", "node", "distance", F.lit(False).alias("new")).unionByName(reach)
        least = both.groupBy("way", "source", "node").agg(F.min("distance").alias("distance"), F.min(F.when(~F.col("new"), F.col("distance"))).alias("old"))
        best = stage(least.select("way", "source", "node", "distance", (F.col("old").isNull() | (F.col("distance") < F.col("old"))).alias("fresh")), "distances")
    return best.drop("fresh")


def _steps(weights: DataFrame, backward: bool) -> DataFrame:
    return weights.select(F.lit(backward).alias("way"), F.col("dest" if backward else "origin").alias("node"), F.col("origin" if backward else "dest").alias("next"), "bound")


def distances(sources: DataFrame, weights: DataFrame, backward: bool = False) -> DataFrame:
    """source, node, distance: least sums of `bound` from (or, backward, to) each source (landmark) over edges of weights."""
    return _relax(sources.select(F.lit(backward).alias("way"), F.col("landmark").alias("source")), _steps(weights, backward)).drop("way")


def landmark_table(model: Model, count: int, seed: str = "landmarks") -> DataFrame:
    """landmark_pos, landmark, node_idx, fwd, bwd: bound distances from and to each landmark, found together; null where there is no way."""
    marks = stage(choose_landmarks(model, count, seed), "landmarks")
    weights = bound_weights(model)
    starts = marks.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("way"), F.col("landmark").alias("source"))
    found = _relax(starts, _steps(weights, False).unionByName(_steps(weights, True)))
    grid = found.groupBy(F.col("source").alias("landmark"), F.col("node").alias("node_idx")).agg(F.min(F.when(~F.col("way"), F.col("distance"))).alias("fwd"), F.min(F.when(F.col("way"), F.col("distance"))).alias("bwd"))
    return marks.join(grid, "landmark").select("landmark_pos", "landmark", "node_idx", "fwd", "bwd")


def landmark_bounds(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """source, target, bound: the greatest of the triangle bounds over all landmarks, at least 0; distances that do not exist bound nothing."""
    side = lambda name: table.select("landmark_pos", F.col("node_idx").alias(name), F.col("fwd").alias(f"{name}_f"), F.col("bwd").alias(f"{name}_b"))
    rows = pairs.join(side("source"), "source", "left").join(side("target"), ["landmark_pos", "target"], "left")
    zero = F.lit(0.0)
    one = F.greatest(zero, F.coalesce(F.col("target_f") - F.col("source_f"), zero), F.coalesce(F.col("source_b") - F.col("target_b"), zero))
    return rows.groupBy("source", "target").agg(F.max(one).alias("bound"))


def signature(model: Model) -> DataFrame:
    """n_nodes, n_edges, signature of the bound weights: equal for equal graphs, whatever the order of their rows."""
    each = bound_weights(model).select(F.conv(F.substring(F.md5(F.concat_ws("|", "edge_idx", "origin", "dest", F.round(F.col("bound") * 1000).cast("long").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    n = model.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(F.broadcast(each.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("signature"))), F.lit(True))  # one row each


def check_compatible(table_meta: dict, model: Model) -> None:
    """Raises if landmarks were computed for another graph."""
    now = signature(model).first().asDict()
    for key in ("n_nodes", "n_edges", "signature"):
        if table_meta[key] != now[key]:
            raise ModelError("LANDMARK_INCOMPATIBLE", f"{key}: {table_meta[key]} and {now[key]}")


def save_landmarks(table: DataFrame, model: Model, path: str) -> None:
    """Write a landmark table with the signature of the graph it belongs to."""
    table.select("landmark_pos", "landmark", "node_idx", "fwd", "bwd").write.parquet(f"{path}/landmarks")
    signature(model).coalesce(1).write.parquet(f"{path}/signature")


def load_landmarks(spark: SparkSession, path: str, model: Model) -> DataFrame:
    """The landmark table below a path; raises if it was computed for another graph."""
    check_compatible(spark.read.parquet(f"{path}/signature").first().asDict(), model)
    return spark.read.schema("landmark_pos int, landmark int, node_idx int, fwd double, bwd double").parquet(f"{path}/landmarks")
