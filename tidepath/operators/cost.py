"""The cost of entering an edge at a tick: base, profile, live overlay, turn. Every factor is a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profilefn, timefn
from ..sources.model import Metadata, Model
from . import overlay as live

FLOAT_MAX = 3.4028234663852886e38
INF = float("inf")


@dataclass(frozen=True)
class CostOptions:
    """interpolate: between bucket starts, else the bucket's value. calendar: local days of the model's zone and day masks, else UTC and every day. turns: EDGE_BASED applies finite penalties, NODE_BASED only forbids.

    A user's strategies go before the built-in ones: offset(sec, zone) gives seconds added to UTC (calendar then says
    whether day masks count), turn(penalty, has_predecessor) what a turn adds.
    """

    interpolate: bool = True
    calendar: bool = False
    turns: str = "EDGE_BASED"
    offset: Callable[[Column, str], Column] | None = None
    turn: Callable[[Column, Column], Column] | None = None


def multiplier(tick: Column, meta: Metadata, opts: CostOptions, buckets: Column | None = None, day_mask: Column | None = None) -> Column:
    buckets, day_mask = F.col("buckets") if buckets is None else buckets, F.col("day_mask") if day_mask is None else day_mask
    sec = timefn.epoch_seconds(tick, meta.unit)
    offset = opts.offset(sec, meta.zone) if opts.offset else timefn.zone_offset(sec, meta.zone) if opts.calendar else F.lit(0)
    day = timefn.day_of_week(sec, offset)
    if opts.interpolate:
        share = timefn.fractional_bucket(sec, meta.bucket_seconds, offset)
        return profilefn.interpolated_for_day(buckets, day_mask, day, share) if opts.calendar else profilefn.interpolated(buckets, share)
    bucket = timefn.bucket_of_day(sec, meta.bucket_seconds, offset)
    return profilefn.discrete_for_day(buckets, day_mask, day, bucket) if opts.calendar else profilefn.discrete(buckets, bucket)


def turn_cost(penalty: Column, has_predecessor: Column, opts: CostOptions) -> Column:
    """What a turn adds: nothing without a predecessor or a row; infinite if forbidden; finite penalties only if EDGE_BASED."""
    if opts.turn is not None:
        return opts.turn(penalty, has_predecessor).cast("float")
    known = F.coalesce(penalty, F.lit(0.0).cast("float"))
    if opts.turns == "NODE_BASED":
        known = F.when(known == INF, F.lit(INF)).otherwise(F.lit(0.0)).cast("float")
    return F.when(has_predecessor, known).otherwise(F.lit(0.0).cast("float"))


def travel_cost(base: Column, mult: Column, penalty: Column) -> Column:
    product = base.cast("double") * mult.cast("double") * penalty.cast("double")
    return F.when(penalty == INF, F.lit(INF)).when(product > FLOAT_MAX, F.lit(INF)).otherwise(product).cast("float")


def with_turn(travel: Column, turn: Column) -> Column:
    total = travel.cast("double") + turn.cast("double")
    return F.when(total > FLOAT_MAX, F.lit(INF)).otherwise(total).cast("float")


def priced_edges(model: Model, overlay: DataFrame | None = None) -> DataFrame:
    """Edges with their profile (buckets, day_mask; null if unknown) and overlay entry (speed_factor, valid_from, valid_until; null if none)."""
    out = model.edges.select("edge_idx", "origin", "dest", "base_weight", "profile_id").join(model.profiles, "profile_id", "left")
    if overlay is None:
        return out.withColumns({"speed_factor": F.lit(None).cast("float"), "valid_from": F.lit(None).cast("long"), "valid_until": F.lit(None).cast("long")})
    return out.join(overlay.select("edge_idx", "speed_factor", "valid_from", "valid_until"), "edge_idx", "left")


def cost_columns(tick: str, meta: Metadata, opts: CostOptions, predecessor: str | None) -> list[dict[str, Column]]:
    """The columns of with_cost in the steps they are added in; a loop builds them once."""
    t = F.col(tick)
    entry = (F.col("speed_factor"), F.col("valid_from"), F.col("valid_until"), t)
    turn = F.lit(0.0).cast("float") if predecessor is None else turn_cost(F.col("penalty"), F.col(predecessor).isNotNull(), opts)
    return [
        {"multiplier": multiplier(t, meta, opts), "live_state": live.state(*entry), "live_penalty": live.penalty(*entry), "turn_penalty": turn},
        {"travel_cost": travel_cost(F.col("base_weight"), F.col("multiplier"), F.col("live_penalty"))},
        {"cost": with_turn(F.col("travel_cost"), F.col("turn_penalty"))},
    ]


def with_cost(df: DataFrame, tick: str, meta: Metadata, opts: CostOptions, predecessor: str | None) -> DataFrame:
    """Adds multiplier, live_state, live_penalty, travel_cost, turn_penalty and cost to rows of priced edges with a tick and, if there may be turns, predecessor and penalty."""
    for step in cost_columns(tick, meta, opts, predecessor):
        df = df.withColumns(step)
    return df


def explain(requests: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions()) -> DataFrame:
    """All factors of the cost of each request (edge_idx, from_edge or null, tick); an unknown edge gets reason_code COST_EDGE_UNKNOWN."""
    rows = requests.join(priced_edges(model, overlay), "edge_idx", "left").join(model.turns.withColumnRenamed("to_edge", "edge_idx"), ["from_edge", "edge_idx"], "left")
    return with_cost(rows, "tick", model.meta, opts, "from_edge").withColumn("reason_code", F.when(F.col("base_weight").isNull(), "COST_EDGE_UNKNOWN"))


def fifo_breaches(model: Model, weekly: bool = False) -> DataFrame:
    """edge_idx, profile_id, position of buckets at which entering later would arrive earlier, with the week's (or day's) end leading to its start.

    weekly also takes days that the mask leaves out as neutral. A day's arrivals are a bucket's start plus
    base weight times multiplier; a decrease of more than 1e-9 is a breach.
    """
    ticks = model.meta.bucket_seconds * timefn.TICKS[model.meta.unit]
    days = F.sequence(F.lit(0), F.lit(6)) if weekly else F.array(F.lit(0))
    profile = model.profiles.select("profile_id", "day_mask", "buckets", F.explode(days).alias("day"))
    profile = profile.select("profile_id", "day_mask", "day", F.size("buckets").alias("n"), F.posexplode("buckets").alias("bucket", "m")).withColumn("position", F.col("day") * F.col("n") + F.col("bucket"))
    if weekly:
        profile = profile.withColumn("m", F.when(profilefn.active_on(F.col("day_mask"), F.col("day")), F.col("m")).otherwise(F.lit(1.0).cast("float")))
    # neighbours are compared per profile, not per edge: the breach depends on the edge by its weight alone
    w = Window.partitionBy("profile_id").orderBy("position")
    steps = profile.withColumn("next_m", F.coalesce(F.lead("m").over(w), F.first("m").over(w))).filter("n > 1" if not weekly else "n >= 1").select("profile_id", "position", "m", "next_m")
    edges = model.edges.select("edge_idx", "profile_id", F.col("base_weight").cast("double").alias("base"))
    arrives = F.col("base") * F.col("m").cast("double")
    later = F.lit(float(ticks)) + F.col("base") * F.col("next_m").cast("double")
    return edges.join(steps, "profile_id").filter(later + 1e-9 < arrives).select("edge_idx", "profile_id", "position")
