"""Time arithmetic on long ticks as Columns; Monday is day 0, and everything floors, so times before 1970 work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
TICKS = {"SECONDS": 1, "MILLISECONDS": 1_000}
TICK_NS = {"SECONDS": 1_000_000_000, "MILLISECONDS": 1_000_000}


def floor_div(x: Column, n: int) -> Column:
    return F.floor((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def epoch_seconds(ticks: Column, unit: str = "SECONDS") -> Column:
    return ticks if unit == "SECONDS" else floor_div(ticks, TICKS[unit])


def to_engine_ticks(value: Column, unit: str, engine: str) -> Column:
    """Up by exact multiplication (an overflow is an error under ANSI), down by floor division."""
    if unit == engine:
        return value
    return value * TICKS["MILLISECONDS"] if engine == "MILLISECONDS" else floor_div(value, TICKS["MILLISECONDS"])


def time_of_day(sec: Column, offset: Column | int = 0) -> Column:
    return F.pmod(sec + offset, F.lit(DAY))


def time_of_day_ticks(ticks: Column, unit: str = "SECONDS", offset: Column | int = 0) -> Column:
    """Whole seconds only: a fraction of a second is dropped before scaling."""
    return time_of_day(epoch_seconds(ticks, unit), offset) * TICKS[unit]


def bucket_of_day(sec: Column, bucket_seconds: int, offset: Column | int = 0) -> Column:
    return F.floor(time_of_day(sec, offset) / bucket_seconds).cast("int")


def day_of_week(sec: Column, offset: Column | int = 0) -> Column:
    return F.pmod(floor_div(sec + offset, DAY) + 3, F.lit(7)).cast("int")


def zone_offset(sec: Column, zone: str) -> Column:
    """Seconds that the zone is ahead of UTC at that instant; the session's zone must be UTC."""
    ts = F.timestamp_seconds(sec)
    return F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - sec


def fractional_bucket(sec: Column, bucket_seconds: int, offset: Column | int = 0) -> Column:
    return time_of_day(sec, offset) / F.lit(float(bucket_seconds))


def bucket_label(bucket: Column, bucket_seconds: int) -> Column:
    """HH:MM-HH:MM of a bucket; its end is at most 24:00."""
    start = bucket * bucket_seconds
    end = F.least(start + bucket_seconds, F.lit(DAY))
    part = lambda s: F.format_string("%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"))
    return F.concat(part(start), F.lit("-"), part(end))


def unit_of_tick(ns: Column) -> Column:
    """SECONDS or MILLISECONDS; null for any other tick duration."""
    return F.when(ns == TICK_NS["SECONDS"], "SECONDS").when(ns == TICK_NS["MILLISECONDS"], "MILLISECONDS")


def is_fifo(arrivals: Column) -> Column:
    """Whether an array of longs never decreases."""
    n = F.size(arrivals)
    return F.when(n < 2, F.lit(True)).otherwise(F.forall(F.zip_with(F.slice(arrivals, 1, F.greatest(n - 1, F.lit(0))), F.slice(arrivals, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] <= p["b"]))
