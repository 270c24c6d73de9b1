"""Regions of a search: gazetteers, boundaries, GeoJSON, grids, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.geo import MILES_PER_DEGREE, box_area, haversine

METRES_PER_DEGREE = 111_320.0


def gazetteer(places: DataFrame, by: str, least: int) -> DataFrame:
    """by, n, lat, lon and the box of every town of at least so many places, its centre in the middle of the box."""
    boxed = places.groupBy(by).agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    return boxed.filter(F.col("n") >= least).withColumns({"lat": (F.col("south") + F.col("north")) / 2, "lon": (F.col("west") + F.col("east")) / 2})


def divisions(divisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted(name, kind) the largest of the divisions(id, name, kind, south, north, west, east) so called, whatever the case."""
    area = box_area(F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    known = divisions.select(F.lower("name").alias("_name"), "kind", F.struct(area.alias("area"), "id").alias("best"))
    asked = wanted.select("name", "kind", F.lower("name").alias("_name"))
    return asked.join(known, ["_name", "kind"]).groupBy("name", "kind").agg(F.max("best").alias("b")).select("name", "kind", F.col("b.id").alias("id"), F.round("b.area", 6).alias("area"))


GEOMETRY = "struct<type: string, features: array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>>>, geometry: struct<type: string, coordinates: array<array<array<double>>>>, coordinates: array<array<array<double>>>>"


def geojson_box(document: Column) -> Column:
    """struct<west, east, south, north> of the outer ring of a bare polygon, a feature, or the first feature of a collection; null without one."""
    read = F.from_json(document, GEOMETRY)
    rings = F.coalesce(F.get(read.getField("features"), F.lit(0)).getField("geometry").getField("coordinates"), read.getField("geometry").getField("coordinates"), read.getField("coordinates"))
    ring = F.get(rings, F.lit(0))
    lon, lat = F.transform(ring, lambda p: F.get(p, F.lit(0))), F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(ring) > 0, F.struct(F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north")))


def ring_json(lat: Column, lon: Column, miles: Column, steps: int = 96) -> Column:
    """A circle as a GeoJSON polygon, its ring closed."""
    up, across = miles / MILES_PER_DEGREE, miles / (MILES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    angle = lambda k: 2 * F.pi() * (k % steps) / steps
    ring = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.array(lon + across * F.cos(angle(k)), lat + up * F.sin(angle(k))))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def within_rings(places: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Places inside boundaries(boundary, ring: array<struct<lat, lon>>), by the even-odd rule.

    The box of each ring and its cells of one degree bring places and rings together, so a
    place is held only against rings whose box has its cell.
    """
    lats, lons = F.transform("ring", lambda p: p.getField("lat")), F.transform("ring", lambda p: p.getField("lon"))
    boxed = boundaries.select("boundary", "ring", F.array_min(lats).alias("_s"), F.array_max(lats).alias("_n"), F.array_min(lons).alias("_w"), F.array_max(lons).alias("_e"))
    whole = lambda c: F.floor(c).cast("int")
    cells = boxed.withColumn("_y", F.explode(F.sequence(whole(F.col("_s")), whole(F.col("_n"))))).withColumn("_x", F.explode(F.sequence(whole(F.col("_w")), whole(F.col("_e")))))
    met = places.withColumns({"_y": whole(F.col("lat")), "_x": whole(F.col("lon"))}).join(cells, ["_y", "_x"])
    met = met.filter(F.col("lat").between(F.col("_s"), F.col("_n")) & F.col("lon").between(F.col("_w"), F.col("_e")))
    edges = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        y1, y2, x1, x2 = e["a"]["lat"], e["b"]["lat"], e["a"]["lon"], e["b"]["lon"]
        return ((F.col("lat") < y1) != (F.col("lat") < y2)) & (F.col("lon") < x1 + (F.col("lat") - y1) * F.try_divide(x2 - x1, y2 - y1))

    return met.filter(F.size(F.filter(edges, crosses)) % 2 == 1).drop("ring", "_y", "_x", "_s", "_n", "_w", "_e")


def grid(centres: DataFrame, miles: float, half_metres: float) -> DataFrame:
    """The squares of 2 * half_metres that abut and have their middle within so many miles of centres(name, lat, lon): name, row, column, lat, lon."""
    high = 2 * half_metres / METRES_PER_DEGREE
    wide = F.lit(high) / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    reach = int(miles * 1609.344 / (2 * half_metres)) + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    cells = centres.withColumn("row", F.explode(steps)).withColumn("column", F.explode(steps)).withColumn("_lat", F.col("lat") + F.col("row") * high).withColumn("_lon", F.col("lon") + F.col("column") * wide)
    return cells.filter(haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= miles).select("name", "row", "column", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


def turn(names: Column, at: Column, hours: int = 4, among: int = 50) -> Column:
    """Whose turn it is at a time: names in rank order take turns of so many hours."""
    slot = F.floor(F.unix_timestamp(at) / (3600 * hours)) % among
    return F.get(names, (slot % F.size(names)).cast("int"))
