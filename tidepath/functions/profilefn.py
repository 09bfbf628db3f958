"""Multipliers of weekly profiles as Columns over (buckets array<float>, day_mask int); a null profile is neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 1.0


def active_on(day_mask: Column, day: Column) -> Column:
    return F.get(F.array(*[day_mask.bitwiseAND(1 << i) != 0 for i in range(7)]), day)


def discrete(buckets: Column, bucket: Column) -> Column:
    """The bucket's multiplier, 1.0 for an unknown profile; a bucket out of range of a known one is an error."""
    return F.when(buckets.isNull(), F.lit(NEUTRAL).cast("float")).otherwise(F.element_at(buckets, bucket + 1))


def discrete_for_day(buckets: Column, day_mask: Column, day: Column, bucket: Column) -> Column:
    return F.when(active_on(day_mask, day), discrete(buckets, bucket)).otherwise(F.lit(NEUTRAL).cast("float"))


def _lerp(low: Column, high: Column, share: Column) -> Column:
    # the difference is taken in float, the product and sum in double
    return (low.cast("double") + (high - low).cast("float").cast("double") * share).cast("float")


def interpolated(buckets: Column, fraction: Column) -> Column:
    """Cyclic linear interpolation between buckets, in double, given as float."""
    n = F.size(buckets)
    low = F.floor(fraction).cast("int")
    a, b = F.element_at(buckets, F.pmod(low, n) + 1), F.element_at(buckets, F.pmod(low + 1, n) + 1)
    return F.when(buckets.isNull(), F.lit(NEUTRAL).cast("float")).otherwise(_lerp(a, b, fraction - low))


def interpolated_for_day(buckets: Column, day_mask: Column, day: Column, fraction: Column) -> Column:
    """As interpolated; past the last bucket the next day's mask counts."""
    n = F.size(buckets)
    low = F.pmod(F.floor(fraction).cast("int"), n)
    share = fraction - F.floor(fraction)
    wraps = low + 1 == n
    a = discrete_for_day(buckets, day_mask, day, low)
    b = discrete_for_day(buckets, day_mask, F.when(wraps, F.pmod(day + 1, F.lit(7))).otherwise(day), F.when(wraps, F.lit(0)).otherwise(low + 1))
    return F.when(buckets.isNull(), F.lit(NEUTRAL).cast("float")).when(share == 0.0, a).otherwise(_lerp(a, b, share))
