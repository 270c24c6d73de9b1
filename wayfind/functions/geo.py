"""Distances, boxes and rings as column expressions (degrees in, miles or metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii and the miles that a degree of latitude counts for.
EARTH_MILES = 3958.8
EARTH_METRES = 6_371_000.0
MILES_PER_DEGREE = 69.0


def haversine(lat: Column, lon: Column, lat2, lon2, radius: float = EARTH_MILES) -> Column:
    lat2, lon2 = (x if isinstance(x, Column) else F.lit(x) for x in (lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat) / 2, F.radians(lon2 - lon) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def box(lat: float, lon: float, miles: float) -> tuple[float, float, float, float]:
    """South, north, west, east of a box that holds the circle."""
    up, across = miles / MILES_PER_DEGREE, miles / (MILES_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return lat - up, lat + up, lon - across, lon + across


def within_radius(lat: Column, lon: Column, centre: tuple[float, float], miles: float) -> Column:
    """The box, which a Parquet scan can prune by, and then the exact circle."""
    south, north, west, east = box(*centre, miles)
    return lat.between(south, north) & lon.between(west, east) & (haversine(lat, lon, *centre) <= miles)


def within_any(lat: Column, lon: Column, centres: list[tuple[float, float]], miles: float) -> Column:
    """Any of several circles, inside the box around all of them; no centre: nothing."""
    if not centres:
        return F.lit(False)
    boxes = [box(*c, miles) for c in centres]
    south, north, west, east = min(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes)
    hit = F.lit(False)
    for c in centres:
        hit = hit | within_radius(lat, lon, c, miles)
    return lat.between(south, north) & lon.between(west, east) & hit


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lat, lon), after its bounding box."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((lat < y1) != (lat < y2)) & (lon < at), 1).otherwise(0)
    return lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)) & (crossings % 2 == 1)


def circle_area(miles: Column) -> Column:
    return F.lit(math.pi) * miles * miles


def box_area(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Square miles, with the longitude narrowed at the middle latitude."""
    return (north - south) * (east - west) * F.cos(F.radians((south + north) / 2)) * MILES_PER_DEGREE**2


def ring_of_circle(lat: float, lon: float, miles: float, steps: int = 96) -> list[tuple[float, float]]:
    """A closed ring of steps + 1 points."""
    up, across = miles / MILES_PER_DEGREE, miles / (MILES_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return [(lat + up * math.sin(2 * math.pi * k / steps), lon + across * math.cos(2 * math.pi * k / steps)) for k in range(steps + 1)]


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """A grid cell's name."""
    return F.concat_ws("_", F.floor(lat / degrees).cast("string"), F.floor(lon / degrees).cast("string"))
