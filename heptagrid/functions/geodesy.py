"""Distances, bearings and plane coordinates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257223563
METRES_PER_DEGREE = 111320.0
ROUNDS = 12


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """East and north of a point, in metres, near it."""
    return (lon - lon0) * (METRES_PER_DEGREE * math.cos(math.radians(lat0))), (lat - lat0) * METRES_PER_DEGREE


def angle_difference(a: Column, b: Column) -> Column:
    """-180 up to 180."""
    return F.pmod(a - b + 540, F.lit(360.0)) - 180


def circular_mean_std(degrees: Column) -> tuple[Column, Column]:
    """Aggregates: mean direction, 0 up to 360, and circular deviation, both in degrees."""
    c, s = F.avg(F.cos(F.radians(degrees))), F.avg(F.sin(F.radians(degrees)))
    r = F.hypot(c, s)
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.when(r > 0, F.degrees(F.sqrt(F.greatest(-2 * F.log(r), F.lit(0.0)))))


def geodesic_struct(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """distance (m) and azimuth (degrees, 0 up to 360) on WGS84, by Vincenty's inverse method, in an Arrow UDF; null in, null
    out. Where that doesn't settle, between nearly opposite points, the azimuth is found by bisection."""
    @F.arrow_udf("struct<distance: double, azimuth: double>")
    def inverse(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        x1, y1, x2, y2 = (np.radians(v.cast(pa.float64()).to_numpy(zero_copy_only=False)) for v in (a, b, c, d))
        distance, azimuth = vincenty(x1, y1, x2, y2)
        bad = pa.array(~np.isfinite(distance))
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(azimuth)], names=["distance", "azimuth"], mask=bad)

    return inverse(lon1, lat1, lon2, lat2)


def vincenty(x1, y1, x2, y2):
    """Arrays of radians -> metres and degrees (0 up to 360)."""
    b = A * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(y1)), np.arctan((1 - FLAT) * np.tan(y2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    across = x2 - x1
    turn = across.copy()
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            before = turn
            sl, cl = np.sin(turn), np.cos(turn)
            sin = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos = s1 * s2 + c1 * c2 * cl
            arc = np.arctan2(sin, cos)
            sa = np.where(sin > 0, c1 * c2 * sl / sin, 0.0)
            ca2 = 1 - sa * sa
            mid = np.where(ca2 > 1e-15, cos - 2 * s1 * s2 / ca2, 0.0)
            k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            turn = across + (1 - k) * FLAT * sa * (arc + k * sin * (mid + k * cos * (2 * mid * mid - 1)))
        u = ca2 * (A * A - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        off = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
        distance = b * big * (arc - off)
        settled = np.abs(turn - before) < 1e-11
        azimuth = _turned(np.arctan2(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn)))
    rest = np.flatnonzero(~settled & np.isfinite(x1 + y1 + x2 + y2))
    if len(rest):
        distance[rest], azimuth[rest] = opposite(u1[rest], u2[rest], across[rest])
    return distance, azimuth


def opposite(u1, u2, across):
    """The same for points of any kind, from reduced latitudes and the difference of longitudes.

    The points are turned about so that the first is the southern one and further from the equator, and the second east of it.
    The longitude at which a geodesic that leaves with some azimuth passes the second latitude, northward, goes past the one
    wanted but once as the azimuth goes from north to south, so halving the interval finds it.
    """
    across = (across + math.pi) % (2 * math.pi) - math.pi
    swap = np.abs(u1) < np.abs(u2)
    a, b = np.where(swap, u2, u1), np.where(swap, u1, u2)
    north, east = np.where(a > 0, -1.0, 1.0), np.where((across < 0) ^ swap, -1.0, 1.0)
    a, b, want = np.minimum(a * north, -1e-12), b * north, np.abs(across)
    low, high = np.zeros(len(a)), np.full(len(a), math.pi)
    for _ in range(60):
        mid = (low + high) / 2
        past = _reached(a, b, mid)[0] > want
        low, high = np.where(past, low, mid), np.where(past, mid, high)
    azimuth = (low + high) / 2
    _, distance, end_sin, end_cos = _reached(a, b, azimuth)
    # along the equator, as far as that is the shortest way
    flat = (a > -1e-11) & (np.abs(b) < 1e-11) & (want <= math.pi * (1 - FLAT))
    distance, sin, cos = np.where(flat, A * want, distance), np.where(flat, 1.0, np.sin(azimuth)), np.where(flat, 0.0, np.cos(azimuth))
    sin, cos = np.where(swap & ~flat, end_sin, sin), np.where(swap & ~flat, end_cos, cos)
    turn = np.where(swap, -1.0, 1.0)
    return distance, _turned(np.arctan2(sin * turn * east, cos * turn * north))


def _turned(angle):
    """Degrees, 0 up to 360."""
    found = np.degrees(angle) % 360
    return np.where(found >= 360, 0.0, found)


def _reached(a, b, azimuth):
    """Longitude and distance to where the geodesic from latitude a passes b northward, and its sine and cosine of azimuth."""
    sin0 = np.sin(azimuth) * np.cos(a)
    cos_start = np.cos(azimuth) * np.cos(a)
    cos_end = np.sqrt(np.maximum(cos_start**2 + np.cos(b) ** 2 - np.cos(a) ** 2, 0))
    s1, s2 = np.arctan2(np.sin(a), cos_start), np.arctan2(np.sin(b), cos_end)
    turn = np.arctan2(sin0 * np.sin(s2), np.cos(s2)) - np.arctan2(sin0 * np.sin(s1), np.cos(s1))
    arc, mid, ca2 = s2 - s1, np.cos(s1 + s2), 1 - sin0**2
    sin, cos = np.sin(arc), np.cos(arc)
    k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    # mid is the cosine of twice the arc from the equator to the middle
    longitude = turn - (1 - k) * FLAT * sin0 * (arc + k * sin * (mid + k * cos * (2 * mid * mid - 1)))
    u = ca2 * (A * A - (A * (1 - FLAT)) ** 2) / (A * (1 - FLAT)) ** 2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    off = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
    return longitude, A * (1 - FLAT) * big * (arc - off), sin0 / np.cos(b), cos_end / np.cos(b)
