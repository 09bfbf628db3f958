"""Live overlay: at most one timed speed factor per edge. Batches are merged by joins and windows, never row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefn

NOW_ON = -(2**63)
UPDATES = "edge_idx int, speed_factor float, valid_from long, valid_until long, ordinal long"
SLOTS = ["edge_idx", "speed_factor", "valid_from", "valid_until"]


def state(speed: Column, start: Column, until: Column, tick: Column) -> Column:
    """MISSING, SCHEDULED, EXPIRED, BLOCKED or ACTIVE at a tick; an entry holds in [start, until)."""
    return F.when(until.isNull(), "MISSING").when(tick < start, "SCHEDULED").when(tick >= until, "EXPIRED").when(speed == 0, "BLOCKED").otherwise("ACTIVE")


def penalty(speed: Column, start: Column, until: Column, tick: Column) -> Column:
    """1 outside of the interval, infinite where blocked, else 1 / speed as float."""
    inside = until.isNotNull() & (tick >= start) & (tick < until)
    return F.when(~inside, F.lit(1.0)).when(speed == 0, F.lit(float("inf"))).otherwise(1.0 / speed.cast("double")).cast("float")


def relative_update(now: Column, ttl: Column, unit: str = "SECONDS", engine: str = "SECONDS") -> Column:
    """The end of an update that holds for ttl (in unit) from now (in engine ticks); an overflow is an error."""
    return now + timefn.to_engine_ticks(ttl, unit, engine)


def checked(updates: DataFrame, edge_count: int | None = None) -> DataFrame:
    """The updates with reason_code: null if they may be applied."""
    reason = (
        F.when(F.col("edge_idx").isNull() | (F.col("edge_idx") < 0), "OVERLAY_EDGE_ID")
        .when(F.col("speed_factor").isNull() | F.isnan("speed_factor") | ~F.col("speed_factor").between(0, 1), "OVERLAY_SPEED_FACTOR")
        .when(F.col("valid_until").isNull() | (F.col("valid_until") <= F.coalesce("valid_from", F.lit(NOW_ON))), "OVERLAY_INTERVAL")
    )
    if edge_count is not None:
        reason = reason.when(F.col("edge_idx") >= edge_count, "OVERLAY_EDGE_UNKNOWN")
    return updates.withColumn("valid_from", F.coalesce("valid_from", F.lit(NOW_ON))).withColumn("reason_code", reason)


def last_per_edge(updates: DataFrame) -> DataFrame:
    """The last write of a batch for each edge, by ordinal."""
    return updates.groupBy("edge_idx").agg(F.max_by(F.struct("speed_factor", "valid_from", "valid_until", "ordinal"), "ordinal").alias("u")).select("edge_idx", "u.*")


def merge(current: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """The overlay after a batch, without a cap: updates expired at `now` are left out, others replace their edge's entry."""
    fresh = last_per_edge(checked(updates).filter("reason_code is null").filter(F.col("valid_until") > now))
    return current.join(fresh.select("edge_idx"), "edge_idx", "left_anti").select(*SLOTS).unionByName(fresh.select(*SLOTS))


def batch_counts(current: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """accepted, rejected_expired, rejected_invalid, distinct_edges, new_edges of a batch, one row."""
    judged = checked(updates).withColumn("expired", F.col("reason_code").isNull() & (F.col("valid_until") <= now))
    live = judged.filter("reason_code is null and not expired").select("edge_idx").distinct()
    new = live.join(current.select("edge_idx"), "edge_idx", "left_anti").agg(F.count(F.lit(1)).alias("new_edges"))
    ok = F.col("reason_code").isNull()
    totals = judged.agg(F.count_if(ok & ~F.col("expired")).alias("accepted"), F.count_if("expired").alias("rejected_expired"), F.count_if(~ok).alias("rejected_invalid"))
    return totals.join(F.broadcast(live.agg(F.count(F.lit(1)).alias("distinct_edges"))), F.lit(True)).join(F.broadcast(new), F.lit(True))  # tables of one row


def merge_capped(current: DataFrame, updates: DataFrame, now: int, capacity: int, policy: str) -> DataFrame:
    """The overlay after a batch under a cap.

    REJECT_BATCH: if old and new edges together pass the cap nothing of the batch is applied.
    EVICT_EXPIRED: expired entries go first, then new edges enter in order of arrival while there is room.
    EVICT_OLDEST_EXPIRY: of all entries those with the latest end stay, ties by smaller edge index.
    """
    fresh = last_per_edge(checked(updates).filter("reason_code is null").filter(F.col("valid_until") > now))
    known = fresh.join(current.select("edge_idx"), "edge_idx", "left_semi")
    new = fresh.join(current.select("edge_idx"), "edge_idx", "left_anti")
    merged = merge(current, updates, now)
    if policy == "REJECT_BATCH":
        total = merged.agg(F.count(F.lit(1)).alias("n"))
        fits = F.broadcast(total)  # one row
        return merged.join(fits, F.col("n") <= capacity, "left_semi").unionByName(current.select(*SLOTS).join(fits, F.col("n") > capacity, "left_semi"))
    if policy == "EVICT_EXPIRED":
        kept = current.filter(F.col("valid_until") > now).join(known.select("edge_idx"), "edge_idx", "left_anti").select(*SLOTS).unionByName(known.select(*SLOTS))
        room = F.broadcast(kept.agg(F.greatest(F.lit(0).cast("long"), F.lit(capacity) - F.count(F.lit(1))).alias("room")))
        turn = Window.partitionBy(F.lit(0)).orderBy("ordinal")
        enters = new.orderBy("ordinal").limit(capacity).withColumn("turn", F.row_number().over(turn)).join(room, F.col("turn") <= F.col("room"))
        return kept.unionByName(enters.select(*SLOTS))
    if policy == "EVICT_OLDEST_EXPIRY":
        return merged.orderBy(F.desc("valid_until"), "edge_idx").limit(capacity)
    raise ValueError(policy)


def oldest_expiry(current: DataFrame) -> DataFrame:
    """edge_idx of the entry that ends first, ties by smaller index."""
    return current.agg(F.min(F.struct("valid_until", "edge_idx")).alias("v")).select("v.edge_idx", "v.valid_until").filter("edge_idx is not null")


def sweep(current: DataFrame, now: int) -> DataFrame:
    """Entries that have not expired; scheduled ones stay."""
    return current.filter(F.col("valid_until") > now)


def snapshot(current: DataFrame, now: int) -> DataFrame:
    return sweep(current, now).orderBy("edge_idx")
