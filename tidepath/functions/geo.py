"""Planar and great-circle distances as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return dx * dx + dy * dy


def normal_longitude_delta(degrees: Column) -> Column:
    """Into (-180, 180]; the remainder is truncated, not floored."""
    d = (degrees + 540.0) % 360.0 - 180.0
    return F.when(d == -180.0, F.lit(180.0)).otherwise(d)


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(normal_longitude_delta(lon2 - lon1))
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def valid_lat_lon(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok
