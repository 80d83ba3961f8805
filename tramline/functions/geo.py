"""Distances and shapes on the sphere as column expressions, in degrees and kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """At 111.32 km a degree on the mean latitude; a degree of longitude is 12 km at least."""
    scale = F.greatest(F.lit(12.0), 111.32 * F.cos(F.radians((lat1 + lat2) / 2)))
    return F.sqrt(F.pow((lat2 - lat1) * 111.32, 2) + F.pow((lon2 - lon1) * scale, 2))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of a point from a short segment, in a plane around the point."""
    k = 111.195 * F.cos(F.radians(lat))
    ax, ay = (lon1 - lon) * k, (lat1 - lat) * 111.195
    bx, by = (lon2 - lon) * k, (lat2 - lat) * 111.195
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring, an array of structs with x and y, holds the point: an odd number of edges crosses its ray."""
    ends = F.slice(ring, F.lit(2), F.size(ring))
    crosses = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        ends,
        lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]),
    )
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring; counter-clockwise is positive."""
    ends = F.slice(ring, F.lit(2), F.size(ring))
    cross = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ends, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2
