"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two Earth radii in km, by call site, and the mercator sphere in m.
RADIUS_KM = 6371.0088
LOOKUP_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0
MERCATOR_HALF_M = math.pi * MERCATOR_RADIUS_M


def _hav(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s1 = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    s2 = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _hav(lat1, lon1, lat2, lon2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * RADIUS_KM


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def lookup_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance used by gazetteer lookups (arcsine form, rounder radius)."""
    return F.asin(F.sqrt(_hav(lat1, lon1, lat2, lon2))) * (2 * LOOKUP_RADIUS_KM)


def encode_cid(lat: Column, lon: Column) -> Column:
    """Latitude and longitude, six decimals each, packed in one long."""
    la = ((F.bround(lat, 6) + 90.0) * 1000000.0).cast("long")
    lo = ((F.bround(lon, 6) + 180.0) * 1000000.0).cast("long")
    return F.shiftleft(la, 32).bitwiseOR(lo)


def decode_lat(cid: Column) -> Column:
    return F.bround(F.shiftright(cid, 32) / 1000000.0 - 90.0, 6)


def decode_lon(cid: Column) -> Column:
    return F.bround(cid.bitwiseAND(F.lit(0xFFFFFFFF)) / 1000000.0 - 180.0, 6)


def unit_lat(dlat: Column, dlon: Column) -> Column:
    mag = F.sqrt(dlat * dlat + dlon * dlon)
    return F.when(mag == 0, F.lit(0.0)).otherwise(dlat / mag)


def unit_lon(dlat: Column, dlon: Column) -> Column:
    return unit_lat(dlon, dlat)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS_M)))


def foot(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of the way along a segment at which it is closest to a point."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.when(len2 > 0, len2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
