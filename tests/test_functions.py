import math
import random

import pytest
from pyspark.sql import functions as F

from tidepath.functions import geo, patternfn, profilefn, timefn


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_time_of_negative_epochs(spark):
    s = F.lit(-1).cast("long")
    r = one(spark, tod=timefn.time_of_day(s), dow=timefn.day_of_week(s), bucket=timefn.bucket_of_day(s, 3600), down=timefn.to_engine_ticks(F.lit(-1).cast("long"), "MILLISECONDS", "SECONDS"))
    assert (r.tod, r.dow, r.bucket, r.down) == (86399, 2, 23, -1)


@pytest.mark.parametrize(("sec", "day"), [(0, 3), (-86400, 2), (1704067200, 0), (1704067200 + 6 * 86400, 6)])
def test_day_of_week(spark, sec, day):
    assert one(spark, d=timefn.day_of_week(F.lit(sec).cast("long"))).d == day


def test_milliseconds_drop_below_a_second(spark):
    assert one(spark, t=timefn.time_of_day_ticks(F.lit(1_999).cast("long"), "MILLISECONDS")).t == 1000


def test_zone_offset_over_dst(spark):
    # clocks in New York go forward on 2024-03-10 at 07:00 UTC
    at = 1710054000
    r = one(spark, a=timefn.zone_offset(F.lit(at - 1), "America/New_York"), b=timefn.zone_offset(F.lit(at), "America/New_York"))
    assert (r.a, r.b) == (-18000, -14400)


def test_labels_and_units(spark):
    r = one(spark, a=timefn.bucket_label(F.lit(23), 3600), b=timefn.bucket_label(F.lit(17), 5000), u=timefn.unit_of_tick(F.lit(1_000_000_000)), x=timefn.unit_of_tick(F.lit(5)))
    assert (r.a, r.b, r.u, r.x) == ("23:00-24:00", "23:36-24:00", "SECONDS", None)


def test_fifo_of_arrays(spark):
    r = one(spark, a=timefn.is_fifo(F.array(*map(F.lit, (1, 2, 2)))), b=timefn.is_fifo(F.array(*map(F.lit, (1, 3, 2)))), c=timefn.is_fifo(F.array(F.lit(1))))
    assert (r.a, r.b, r.c) == (True, False, True)


def test_great_circle(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    r = one(spark, quarter=geo.great_circle_m(*lit(0, 0, 0, 90)), none=geo.great_circle_m(*lit(10, 20, 10, 20)), wrap=geo.great_circle_m(*lit(0, 179, 0, -179)), lon=geo.normal_longitude_delta(F.lit(180.0)), flat=geo.euclidean(*lit(0, 0, 3, 4)))
    assert r.quarter == pytest.approx(math.pi / 2 * geo.EARTH_RADIUS_M)
    assert r.wrap == pytest.approx(math.radians(2) * geo.EARTH_RADIUS_M)
    assert (r.none, r.lon, r.flat) == (0.0, 180.0, 5.0)


def test_interpolation_and_masks(spark):
    b = F.array(*[F.lit(x).cast("float") for x in (1.0, 2.0, 4.0, 1.5)])
    r = one(spark, a=profilefn.interpolated(b, F.lit(1.5)), wrap=profilefn.interpolated(b, F.lit(3.5)), unknown=profilefn.interpolated(F.lit(None).cast("array<float>"), F.lit(2.0)),
            off=profilefn.interpolated_for_day(b, F.lit(1), F.lit(1), F.lit(1.5)), night=profilefn.interpolated_for_day(b, F.lit(1), F.lit(0), F.lit(3.5)), on=profilefn.discrete_for_day(b, F.lit(64), F.lit(6), F.lit(2)))
    assert (r.a, r.wrap, r.unknown, r.off, r.on) == (3.0, 1.25, 1.0, 1.0, 4.0)
    assert r.night == 1.25  # half of 1.5, half of the neutral next day


def test_pattern_classes(spark):
    rows = [(1, 127, [1.0] * 24), (2, 127, [1.0] * 23 + [1.1]), (3, 127, [1.0] * 12 + [2.0] * 12), (4, 127, [1.5] * 12 + [2.5] * 12)]
    got = {r.profile_id: (r.pattern, r.posture) for r in patternfn.profile_patterns(spark.createDataFrame(rows, "profile_id int, day_mask int, buckets array<float>")).collect()}
    assert got[1] == ("FULLY_PERSISTENT", "NO_RECURRING_SIGNAL")
    assert got[2] == ("WEAK_SIGNAL_PERIODIC", "WEAK_SIGNAL_REJECTED")
    assert got[3] == ("STRICT_PERIODIC", "HIGH_CONFIDENCE")
    assert got[4][0] == "MIXED_PERSISTENT_AND_PERIODIC"


def test_random_buckets_against_arithmetic(spark):
    rng = random.Random(5)
    secs = [rng.randrange(-(10**9), 2 * 10**9) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in secs], "s long").select("s", timefn.bucket_of_day(F.col("s"), 900).alias("b"), timefn.day_of_week(F.col("s")).alias("d"))
    for r in df.collect():
        assert r.b == r.s % 86400 // 900 and r.d == (r.s // 86400 + 3) % 7
