"""Geometry as column functions, and the few Arrow functions that need loops."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M, DEGREE_M, LAT_DEGREE_M = 6_371_000.0, 111_320.0, 111_000.0

Ring = list[tuple[float, float]]  # (lat, lng) corners


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2.0)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    dy, dx = (lat2 - lat1) * DEGREE_M, (lng2 - lng1) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dl = F.radians(lng2 - lng1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Smallest angle between two headings."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def view_x(heading: Column, target: Column, fov: float, width: int) -> Column:
    """Column of an image at which a bearing appears; null outside the field of view."""
    d = F.pmod(target - heading + 540.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(d) <= fov / 2, width / 2 + d / fov * width)


def mercator_lat(y: Column, zoom: int, tile: int = 256) -> Column:
    n = math.pi - 2.0 * math.pi * y / (tile * 2.0**zoom)
    return F.degrees(F.atan(F.sinh(n)))


def mercator_lng(x: Column, zoom: int, tile: int = 256) -> Column:
    return x / (tile * 2.0**zoom) * 360.0 - 180.0


def utm_zone(lng: Column) -> Column:
    return (F.floor((lng + 180.0) / 6.0) + 1).cast("int")


def cell(value: Column, size: float) -> Column:
    """Grid cell, cut towards zero."""
    return (value / F.lit(size)).cast("bigint")


def floor_cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def box(ring: Ring, margin_m: float = 0.0) -> tuple[float, float, float, float]:
    """(south, north, west, east) of a ring with a margin in metres on each axis."""
    lats, lngs = [p[0] for p in ring], [p[1] for p in ring]
    dy = margin_m / LAT_DEGREE_M
    dx = margin_m / (DEGREE_M * max(0.01, math.cos(math.radians(sum(lats) / len(lats)))))
    return min(lats) - dy, max(lats) + dy, min(lngs) - dx, max(lngs) + dx


def in_box(lat: Column, lng: Column, ring: Ring, margin_m: float = 0.0) -> Column:
    s, n, w, e = box(ring, margin_m)
    return lat.between(s, n) & lng.between(w, e)


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, an array of structs (lat, lng); half-open crossing rule."""
    n = F.size(ring)
    corner = lambda i: F.element_at(ring, (F.pmod(i, n) + 1).cast("int"))

    def cross(inside: Column, i: Column) -> Column:
        a, b = corner(i), corner(i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return F.when(spans & (lng < at), ~inside).otherwise(inside)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), cross)).otherwise(F.lit(False))


def ring_literal(ring: Ring) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lng")) for a, b in ring])


def plausible_point(lat: Column, lng: Column) -> Column:
    """Neither null nor 0/0, inside the country's bounds."""
    return F.coalesce(~((lat == 0) & (lng == 0)) & lat.between(-34.0, 6.0) & lng.between(-74.0, -34.0), F.lit(False))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners (x, y) of the convex hull, counter-clockwise from the smallest."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(order):
        side: list[tuple[float, float]] = []
        for q in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                side.pop()
            side.append(q)
        return side[:-1]

    return half(p) + half(p[::-1])


@F.pandas_udf(T.StringType())
def hull_wkt(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """WKT of the hull of arrays of longitudes and latitudes."""

    def one(x, y) -> str | None:
        h = hull(list(zip(map(float, x), map(float, y), strict=True)))
        show = ", ".join(f"{a:.6f} {b:.6f}" for a, b in (h + h[:1] if len(h) > 2 else h))
        return None if not h else f"POINT ({show})" if len(h) == 1 else f"LINESTRING ({show})" if len(h) == 2 else f"POLYGON (({show}))"

    return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)])


def ring_area(ring: Column) -> Column:
    """Unsigned area of a ring in square degrees."""
    n = F.size(ring)
    corner = lambda i: F.element_at(ring, (F.pmod(i, n) + 1).cast("int"))
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + corner(i)["lng"] * corner(i + 1)["lat"] - corner(i + 1)["lng"] * corner(i)["lat"])) / 2


def project(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Struct (x, y) in metres around an origin."""
    return F.struct(((lng - lng0) * (DEGREE_M * math.cos(math.radians(lat0)))).alias("x"), ((lat - lat0) * DEGREE_M).alias("y"))


def destination(lat: Column, lng: Column, heading: Column, m: float) -> Column:
    """Struct (lat, lng) of the point so many metres away at a bearing."""
    d, p = m / EARTH_M, F.radians(lat)
    la = F.asin(F.sin(p) * math.cos(d) + F.cos(p) * math.sin(d) * F.cos(F.radians(heading)))
    lo = F.radians(lng) + F.atan2(F.sin(F.radians(heading)) * math.sin(d) * F.cos(p), math.cos(d) - F.sin(p) * F.sin(la))
    return F.struct(F.degrees(la).alias("lat"), F.degrees(lo).alias("lng"))


def inner_point(ring: Column) -> Column:
    """Struct (lat, lng) of a point inside a ring: on the middle line, halfway between its first two crossings."""
    n = F.size(ring)
    corner = lambda i: F.element_at(ring, (F.pmod(i, n) + 1).cast("int"))
    lats = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["lat"])))
    y = (F.element_at(lats, 1) + F.element_at(lats, 2)) / 2  # between the two lowest corners, so off all corners
    at = lambda i: corner(i)["lng"] + (y - corner(i)["lat"]) / (corner(i + 1)["lat"] - corner(i)["lat"]) * (corner(i + 1)["lng"] - corner(i)["lng"])
    xs = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (corner(i)["lat"] > y) != (corner(i + 1)["lat"] > y)), at))
    return F.struct(y.alias("lat"), ((xs[0] + xs[1]) / 2).alias("lng"))
