"""Endpoints of requests: identity lookups and nearest nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..staging import stage

#: Default snap distances by strategy, and the widest range a request may ask for.
SNAP_DEFAULT = {"XY": 1_000.0, "LAT_LON": 250.0}
SNAP_MOST = 1_000_000.0


def to_internal(requests: DataFrame, nodes: DataFrame, id_col: str, out: str) -> DataFrame:
    """requests with the node index of an external id, null if unknown."""
    return requests.join(nodes.select(F.col("node_id").alias(id_col), F.col("node_idx").alias(out)), id_col, "left")


def to_external(rows: DataFrame, nodes: DataFrame, idx_col: str, out: str) -> DataFrame:
    return rows.join(nodes.select(F.col("node_idx").alias(idx_col), F.col("node_id").alias(out)), idx_col, "left")


def resolve_routes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, source, target, departure, reason_code from request_id, source_id, target_id, departure; invalid rows keep a reason and fail nothing."""
    both = to_internal(to_internal(requests, nodes, "source_id", "source"), nodes, "target_id", "target")
    reason = (
        F.when(F.col("source_id").isNull() | (F.trim("source_id") == ""), "ADDRESS_SOURCE_REQUIRED")
        .when(F.col("target_id").isNull() | (F.trim("target_id") == ""), "ADDRESS_TARGET_REQUIRED")
        .when(F.col("departure").isNull(), "REQUEST_DEPARTURE_REQUIRED")
        .when(F.col("source").isNull(), "ADDRESS_SOURCE_UNKNOWN")
        .when(F.col("target").isNull(), "ADDRESS_TARGET_UNKNOWN")
    )
    return both.select("request_id", "source", "target", "departure", reason.alias("reason_code"))


def resolve_matrix(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, source_pos, target_pos, source, target, departure, reason_code: a row per cell, order and duplicates of both lists kept."""
    cells = requests.select("request_id", "departure", "target_ids", F.posexplode("source_ids").alias("source_pos", "source_id"))
    cells = cells.select("request_id", "departure", "source_pos", "source_id", F.posexplode("target_ids").alias("target_pos", "target_id"))
    both = to_internal(to_internal(cells, nodes, "source_id", "source"), nodes, "target_id", "target")
    reason = F.when(F.col("source").isNull(), "ADDRESS_SOURCE_UNKNOWN").when(F.col("target").isNull(), "ADDRESS_TARGET_UNKNOWN")
    return both.select("request_id", "source_pos", "target_pos", "source", "target", "departure", reason.alias("reason_code"))


def distance(strategy: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return geo.great_circle_m(x1, y1, x2, y2) if strategy == "LAT_LON" else geo.euclidean(x1, y1, x2, y2)


def valid_point(strategy: str, x: Column, y: Column) -> Column:
    return geo.finite(x, y) & geo.valid_lat_lon(x, y) if strategy == "LAT_LON" else geo.finite(x, y)


def _boxes(nodes: DataFrame, x0: float, y0: float, size: float, depth: int) -> DataFrame:
    """level, px, py (the parent's cell), cx, cy, and the least box around the nodes of each cell that has any, on levels 1 to depth of a grid whose cells split in 4 by 4."""
    split = lambda c, low, n: F.floor((F.col(c) - low) / size * n).cast("long")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(4**k).alias("n")) for k in range(1, depth + 1)])
    each = nodes.select("nx", "ny", F.explode(levels).alias("l"))
    each = each.select(F.col("l.level").alias("level"), "nx", "ny", split("nx", x0, F.col("l.n")).alias("cx"), split("ny", y0, F.col("l.n")).alias("cy"))
    found = each.groupBy("level", "cx", "cy").agg(F.min("nx").alias("x_lo"), F.max("nx").alias("x_hi"), F.min("ny").alias("y_lo"), F.max("ny").alias("y_hi"))
    return found.withColumn("px", F.shiftright("cx", 2)).withColumn("py", F.shiftright("cy", 2))


def nearest(points: DataFrame, nodes: DataFrame, per_cell: int = 16) -> DataFrame:
    """point_id, node_idx, d2 of the nearest node of each point (point_id, x, y): squared planar distance, ties to the smaller index.

    Nodes lie in a grid that is split 4 by 4 on each level, until cells hold about `per_cell` nodes. All points go
    down the levels together: a point keeps the cells that may hold its nearest node, those whose box is no
    farther than the far corner of some other cell's box, so it meets few cells on any level, however far away it
    lies, and is compared with the nodes of its last cells alone. Points that are not finite get no row; without
    nodes nobody does. Nodes at one place count as one, the smallest index.
    """
    placed = nodes.filter(geo.finite(F.col("x"), F.col("y"))).groupBy(F.col("x").alias("nx"), F.col("y").alias("ny")).agg(F.min("node_idx").alias("node_idx"))
    box = placed.agg(F.count(F.lit(1)).alias("n"), F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("ny").alias("y0"), F.max("ny").alias("y1")).first()
    live = points.filter(geo.finite(F.col("x"), F.col("y"))).select("point_id", "x", "y")
    if not box.n:
        return live.limit(0).select("point_id", F.lit(0).alias("node_idx"), F.lit(0.0).alias("d2"))
    # a little more than the extent, so that the last node lies inside; one cell where all nodes are at one place
    size = max(box.x1 - box.x0, box.y1 - box.y0) * (1 + 1e-9) or 1.0
    depth = min(12, max(1, math.ceil(math.log(max(1, box.n / per_cell), 16))))
    boxes = stage(_boxes(placed, box.x0, box.y0, size, depth), "boxes")
    front = live.withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long"))
    gap = lambda c, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(c), F.col(c) - F.col(hi))
    reach = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
    own = Window.partitionBy("point_id", "x", "y")
    for level in range(1, depth + 1):
        inside = front.join(boxes.filter(F.col("level") == level).drop("level"), ["px", "py"])
        dx, dy, fx, fy = gap("x", "x_lo", "x_hi"), gap("y", "y_lo", "y_hi"), reach("x", "x_lo", "x_hi"), reach("y", "y_lo", "y_hi")
        inside = inside.select("point_id", "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"), (dx * dx + dy * dy).alias("near"), (fx * fx + fy * fy).alias("far"))
        front = inside.withColumn("least", F.min("far").over(own)).filter("near <= least").select("point_id", "x", "y", "px", "py")
    cell = lambda c, low: F.floor((F.col(c) - low) / size * 4**depth).cast("long")
    found = front.join(placed.withColumn("px", cell("nx", box.x0)).withColumn("py", cell("ny", box.y0)), ["px", "py"])
    best = found.withColumn("d2", geo.squared(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).groupBy("point_id", "x", "y").agg(F.min(F.struct("d2", "node_idx")).alias("b"))
    return best.select("point_id", F.col("b.node_idx").alias("node_idx"), F.col("b.d2").alias("d2"))


def snap(points: DataFrame, nodes: DataFrame, strategy: str, own=None) -> DataFrame:
    """point_id, node_idx, distance, max_snap, reason_code for each point (point_id, x, y, max_snap or null): the nearest node by plane, accepted by the strategy's own distance unless that is greater than max_snap.

    own: a strategy of the user, with distance, valid and default_snap, in place of the built-in one of that name.
    """
    good = own.valid(F.col("x"), F.col("y")) if own else valid_point(strategy, F.col("x"), F.col("y"))
    good = F.coalesce(good, F.lit(False)) & geo.finite(F.col("x"), F.col("y"))
    limit = F.coalesce("max_snap", F.lit(float(own.default_snap if own else SNAP_DEFAULT[strategy])))
    near = nearest(points.filter(good), nodes)
    rows = points.join(near, "point_id", "left").join(nodes.select("node_idx", F.col("x").alias("nx"), F.col("y").alias("ny")), "node_idx", "left")
    ends = [F.col(c) for c in ("x", "y", "nx", "ny")]
    d = own.distance(*ends) if own else distance(strategy, *ends)
    reason = (
        F.when(~good, "ADDRESS_COORDINATES_INVALID")
        .when(~limit.between(0.0, SNAP_MOST), "ADDRESS_SNAP_RANGE")
        .when(F.col("node_idx").isNull(), "ADDRESS_NO_NODE")
        .when(~geo.finite(d) | (d < 0), "ADDRESS_COORDINATES_INVALID")
        .when(d > limit, "ADDRESS_SNAP_EXCEEDED")
    )
    return rows.select("point_id", F.when(reason.isNull(), F.col("node_idx")).alias("node_idx"), d.alias("distance"), limit.alias("max_snap"), reason.alias("reason_code"))


#: An endpoint: an id, or coordinates with an optional hint of the strategy they are meant for.
END = "struct<id:string,x:double,y:double,strategy:string>"


def resolve_ends(ends: DataFrame, nodes: DataFrame, strategy: str, own=None) -> DataFrame:
    """end_key, node, reason_code once per distinct endpoint: rows of `end` (END) and max_snap; each is looked up or snapped once, however many requests name it.

    An endpoint has either an id or coordinates: with both it is mixed, with neither it is missing. A hint must
    name the strategy that is bound.
    """
    e = lambda c: F.col(f"end.{c}")
    zero = lambda c: F.when(e(c) == 0, F.lit(0.0)).otherwise(e(c))
    one = stage(ends.select(F.trim(e("id")).alias("id"), zero("x").alias("x"), zero("y").alias("y"), e("strategy").alias("strategy"), "max_snap").distinct().withColumn("end_key", _end_key()), "ends")
    has_id, has_xy = F.coalesce(F.col("id") != "", F.lit(False)), F.col("x").isNotNull() | F.col("y").isNotNull()
    snapped = snap(one.filter(~has_id & has_xy).select(F.col("end_key").alias("point_id"), "x", "y", "max_snap"), nodes, strategy, own)
    rows = one.join(nodes.select(F.col("node_id").alias("id"), F.col("node_idx").alias("by_id")), "id", "left").join(snapped.select(F.col("point_id").alias("end_key"), "node_idx", F.col("reason_code").alias("why")), "end_key", "left")
    reason = (
        F.when(has_id & has_xy, "ADDRESS_MIXED")
        .when(~has_id & ~has_xy, "ADDRESS_REQUIRED")
        .when(has_xy & (F.coalesce("strategy", F.lit(strategy)) != strategy), "ADDRESS_STRATEGY")
        .when(has_id & F.col("by_id").isNull(), "ADDRESS_UNKNOWN")
        .otherwise(F.col("why"))
    )
    return rows.select("end_key", F.when(reason.isNull(), F.coalesce("by_id", "node_idx")).alias("node"), reason.alias("reason_code"))


def _end_key() -> Column:
    return F.to_json(F.struct("id", "x", "y", "strategy", "max_snap"))


def _keyed(rows: DataFrame, col: str, key: str) -> DataFrame:
    e = lambda c: F.col(f"{col}.{c}")
    zero = lambda c: F.when(e(c) == 0, F.lit(0.0)).otherwise(e(c)).alias(c)
    return rows.withColumn(key, F.to_json(F.struct(F.trim(e("id")).alias("id"), zero("x"), zero("y"), e("strategy").alias("strategy"), "max_snap")))


def _sided(reason: Column, side: str) -> Column:
    """Reasons that speak of the source or the target."""
    return F.when(reason == "ADDRESS_REQUIRED", f"ADDRESS_{side}_REQUIRED").when(reason == "ADDRESS_UNKNOWN", f"ADDRESS_{side}_UNKNOWN").otherwise(reason)


def resolve_pairs(pairs: DataFrame, nodes: DataFrame, strategy: str, own=None, mixed: bool = False) -> DataFrame:
    """pairs (source_end and target_end as END, max_snap, departure, and other columns) with source, target and reason_code in place of the ends.

    Unless mixed, a pair of an id and coordinates is refused.
    """
    rows = _keyed(_keyed(pairs, "source_end", "source_key"), "target_end", "target_key")
    ends = rows.select(F.col("source_end").alias("end"), "max_snap").unionByName(rows.select(F.col("target_end").alias("end"), "max_snap"))
    found = stage(resolve_ends(ends, nodes, strategy, own), "found")
    side = lambda name: found.select(F.col("end_key").alias(f"{name}_key"), F.col("node").alias(name), F.col("reason_code").alias(f"{name}_why"))
    rows = rows.join(side("source"), "source_key").join(side("target"), "target_key")
    kind = lambda name: F.col(f"{name}_end.x").isNotNull()
    reason = F.coalesce(_sided(F.col("source_why"), "SOURCE"), _sided(F.col("target_why"), "TARGET"), F.when(F.col("departure").isNull(), "REQUEST_DEPARTURE_REQUIRED"))
    if not mixed:
        reason = F.coalesce(reason, F.when(kind("source") != kind("target"), "ADDRESS_MIXED"))
    return rows.withColumn("reason_code", reason).drop("source_end", "target_end", "source_key", "target_key", "source_why", "target_why", "max_snap")


def distinct_endpoints(endpoints: DataFrame) -> DataFrame:
    """endpoint_key and its columns, once per distinct endpoint (kind, id, x, y, strategy); -0.0 and 0.0 are one coordinate, ids are trimmed."""
    zero = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))
    normal = endpoints.select("kind", F.trim("id").alias("id"), zero("x").alias("x"), zero("y").alias("y"), "strategy")
    return normal.distinct().withColumn("endpoint_key", F.xxhash64("kind", "id", "x", "y", "strategy"))


def check_dense(ids: DataFrame, col: str) -> DataFrame:
    """n, lowest, highest, n_distinct, dense: whether ids are 0 to n - 1, each once, none null."""
    one = ids.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lowest"), F.max(col).alias("highest"), F.countDistinct(col).alias("n_distinct"), F.count(col).alias("present"))
    return one.select("n", "lowest", "highest", "n_distinct", ((F.col("n") == 0) | ((F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")) & (F.col("present") == F.col("n")))).alias("dense"))


def ranked(rows: DataFrame, by: list, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
