"""Spherical and raster geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import RADIUS_KM, RADIUS_M
from .arrays import bind


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def wrap_half_open(lon: Column) -> Column:
    """[-180, 180): 180 becomes -180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_above_180(lon: Column) -> Column:
    """Subtracts 360 above 180 only: 180 stays."""
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def project(lon: Column, lat: Column, radius: float = RADIUS_M) -> tuple[Column, Column]:
    """Equirectangular metres."""
    return F.radians(lon) * radius, F.radians(lat) * radius


def cell_of(x: Column, y: Column, transform: tuple) -> tuple[Column, Column]:
    """(row, col) by floor under the affine (a, b, c, d, e, f) with b = d = 0."""
    a, _, c, _, e, f = transform
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


def cell_centre(row: Column, col: Column, transform: tuple) -> tuple[Column, Column]:
    """(x, y) of a pixel's centre."""
    a, _, c, _, e, f = transform
    return (col + 0.5) * a + c, (row + 0.5) * e + f


def wkt_rings(text: Column) -> Column:
    """Every innermost bracketed group of a POLYGON or MULTIPOLYGON as a ring of (x, y) of its own, holes too.
    Unclosed rings are accepted, unreadable points skipped, rings of fewer than 3 points dropped."""

    def ring(group: Column) -> Column:
        points = F.transform(F.split(group, ","), lambda p: F.split(F.trim(p), r"\s+"))
        read = F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
        return F.filter(read, lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    upper = F.upper(F.trim(text))
    rings = F.transform(F.regexp_extract_all(upper, F.lit(r"\(([^()]+)\)"), F.lit(1)), ring)
    shaped = F.startswith(upper, F.lit("POLYGON")) | F.startswith(upper, F.lit("MULTIPOLYGON"))
    return F.when(shaped, F.filter(rings, lambda r: F.size(r) >= 3)).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))


def closed(ring: Column) -> Column:
    """The ring with its first point at the end as well."""
    return F.concat(ring, F.array(F.get(ring, 0)))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area in squared input units."""
    cross = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])
    return F.abs(cross) / 2


def ring_centroid_y(ring: Column) -> Column:
    def of(edges: Column) -> Column:
        cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
        twice = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e))
        moment = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["y0"] + e["y1"]) * cross(e))
        return F.try_divide(moment, 3 * twice)

    return bind(_edges(ring), of)


def ring_area_km2(ring: Column, radius_km: float = RADIUS_KM) -> Column:
    """Planar area in squared degrees times the cosine of the centroid's latitude."""
    return ring_area(ring) * (radius_km * math.pi / 180) ** 2 * F.cos(F.radians(ring_centroid_y(ring)))


def lon_span(ring: Column) -> Column:
    xs = F.transform(ring, lambda p: p["x"])
    return F.array_max(xs) - F.array_min(xs)


def geodesic_disk(lon: Column, lat: Column, radius_km: Column, vertices: int = 128, planet_km: float = RADIUS_KM) -> Column:
    """Ring of the circle on the sphere; longitudes stay continuous around the centre."""
    d, la = radius_km / planet_km, F.radians(lat)

    def vertex(k: Column) -> Column:
        t = k * (2 * math.pi / vertices)
        y = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(t))
        x = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(y))
        return F.struct(F.degrees(x).alias("x"), F.degrees(y).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), vertex)


def disk_radius_km(area_km2: Column, margin: float = 1.5, floor_km: float = 3.0) -> Column:
    return F.greatest(F.sqrt(area_km2 / math.pi) * margin, F.lit(floor_km))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on the lower or left edge counts as inside, on the upper or right one as outside."""
    hits = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(e["y1"] == e["y0"], F.lit(1.0)).otherwise(e["y1"] - e["y0"]) + e["x0"])
    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + hits(e).cast("int")) % 2 == 1
