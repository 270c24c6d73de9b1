"""Areas from well-known binary: their size, box and members, by a covering of cells that follows each area's own outline.

An area is a polygon or multipolygon, holes included; a point is inside by the even-odd
rule over all rings, on a line or not as the crossing test falls; points so near a line
that rounding decides are marked, for those who know the outline otherwise. A covering is a
quadtree over longitudes and latitudes: a cell that no edge enters is wholly in or out, a
cell with few edges, or at the finest level, is a border cell and keeps the edges that a
ray to the east can meet. Points meet cells by equal keys; only those in border cells are
held against edges. A large area is coarse inside and fine along its outline only, so
both its cells and its points spread over tasks, and Spark splits a cell that is hot.

Defined results: a null, empty or unreadable geometry, or one of another kind, has null
measures and no members; a ring across the date line is taken as written; points without
coordinates are in nothing; areas that overlap each hold their points; repeated rows count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.geo import MILES_PER_DEGREE

COARSEST, FINEST, FEW_EDGES = 3, 14, 24
CLOSE = 1e-9  # degrees: far above what rounding does to coordinates up to 360, far below what a map shows
POLYGON, MULTIPOLYGON = 3, 6
EDGE = np.dtype([("x1", "<f8"), ("y1", "<f8"), ("x2", "<f8"), ("y2", "<f8")])


def rings_of(data: bytes | None) -> list[list[np.ndarray]] | None:
    """Polygons as lists of rings of (x, y) rows; None for what is no polygon or multipolygon. Further dimensions are dropped."""
    try:
        polygons, at = _geometry(memoryview(data), 0) if data else (None, 0)
        return polygons if polygons is not None and at <= len(data) else None
    except (struct.error, ValueError):
        return None


def _geometry(data: memoryview, at: int) -> tuple[list[list[np.ndarray]] | None, int]:
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    flags, kind = code >> 28, code & 0x0FFFFFFF
    if flags & 2:  # an identifier of the reference system
        at += 4
    dims = 2 + ((flags >> 3) & 1) + ((flags >> 2) & 1) if flags else {0: 2, 1: 3, 2: 3, 3: 4}.get(kind // 1000, 2)
    kind %= 1000
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind == MULTIPOLYGON:
        out = []
        for _ in range(n):
            part, at = _geometry(data, at)
            out += part or []
        return out, at
    if kind != POLYGON:
        return None, at
    rings = []
    for _ in range(n):
        (points,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        rings.append(np.frombuffer(data, f"{order}f8", points * dims, at).reshape(points, dims)[:, :2].astype(np.float64))
        at += points * dims * 8
    return [rings], at


def to_wkb(polygons: list[list[np.ndarray]]) -> bytes:
    """A multipolygon in little-endian binary."""
    parts = [struct.pack("<BII", 1, MULTIPOLYGON, len(polygons))]
    for rings in polygons:
        parts.append(struct.pack("<BII", 1, POLYGON, len(rings)))
        for ring in rings:
            parts += [struct.pack("<I", len(ring)), np.ascontiguousarray(ring, "<f8").tobytes()]
    return b"".join(parts)


def edges_of(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """The edges of all rings, each closed; level ones, which no ray to the east crosses, too."""
    out = []
    for ring in (r for rings in polygons for r in rings if len(r)):
        closed = ring if (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])
        edge = np.zeros(len(closed) - 1, EDGE)
        edge["x1"], edge["y1"], edge["x2"], edge["y2"] = closed[:-1, 0], closed[:-1, 1], closed[1:, 0], closed[1:, 1]
        out.append(edge)
    return np.concatenate(out) if out else np.zeros(0, EDGE)


def inside(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside: an odd number of edges crosses the ray from each to the east."""
    e, x, y = edges[:, None], x[None, :], y[None, :]
    up = (y < e["y1"]) != (y < e["y2"])
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    return (up & right).sum(axis=0) % 2 == 1


def close_to(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are within CLOSE of an edge."""
    dx, dy = edges["x2"] - edges["x1"], edges["y2"] - edges["y1"]
    length = np.hypot(dx, dy)
    side = (x[None, :] - edges["x1"][:, None]) * dy[:, None] - (y[None, :] - edges["y1"][:, None]) * dx[:, None]
    e, p = np.nonzero(np.abs(side) <= 2 * CLOSE * length[:, None])  # near the whole line; few are, and near the edge itself fewer
    east, north = x[p] - edges["x1"][e], y[p] - edges["y1"][e]
    along = np.clip((east * dx[e] + north * dy[e]) / np.where(length[e] > 0, length[e] ** 2, 1), 0, 1)
    out = np.zeros(len(x), bool)
    out[p[np.hypot(east - along * dx[e], north - along * dy[e]) <= CLOSE]] = True
    return out


def _enters(edges: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """Which edges can touch a box or come close to it: their boxes meet, and the corners don't all lie on one side of the edge's line."""
    west, south, east, north = west - CLOSE, south - CLOSE, east + CLOSE, north + CLOSE
    near = (np.minimum(edges["x1"], edges["x2"]) <= east) & (np.maximum(edges["x1"], edges["x2"]) >= west) & (np.minimum(edges["y1"], edges["y2"]) <= north) & (np.maximum(edges["y1"], edges["y2"]) >= south)
    dx, dy = edges["x2"] - edges["x1"], edges["y2"] - edges["y1"]
    sides = [dx * (y - edges["y1"]) - dy * (x - edges["x1"]) for x in (west, east) for y in (south, north)]
    margin = 1e-9 * (np.abs(dx) + np.abs(dy)) * 360
    return near & ~(np.minimum.reduce(sides) > margin) & ~(np.maximum.reduce(sides) < -margin)


def covering(polygons: list[list[np.ndarray]], coarsest: int = COARSEST, finest: int = FINEST, few: int = FEW_EDGES) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(level, column, row, whole, edges) of the cells that hold a part of an area; a cell's size is 360 / 2^level degrees both ways."""
    edges = edges_of(polygons)
    if not len(edges):
        return
    low_y, high_y = np.minimum(edges["y1"], edges["y2"]), np.maximum(edges["y1"], edges["y2"])
    size = 360 / (1 << coarsest)
    span = lambda a, b: range(int(np.floor((a - CLOSE) / size)), int(np.floor((b + CLOSE) / size)) + 1)
    everything = np.arange(len(edges))
    xs, ys = span(min(edges["x1"].min(), edges["x2"].min()) + 180, max(edges["x1"].max(), edges["x2"].max()) + 180), span(low_y.min() + 180, high_y.max() + 180)
    todo = [(coarsest, x, y, everything) for x in xs for y in ys]  # level, column, row, edges whose heights meet the cell's
    while todo:
        level, cx, cy, strip = todo.pop()
        size = 360 / (1 << level)
        west, south = cx * size - 180, cy * size - 180
        east, north = west + size, south + size
        strip = strip[(low_y[strip] <= north + CLOSE) & (high_y[strip] >= south - CLOSE)]
        strip = strip[np.maximum(edges["x1"][strip], edges["x2"][strip]) >= west - CLOSE]  # a ray to the east meets no others
        touching = int(_enters(edges[strip], west, south, east, north).sum())
        if not touching:
            if inside(edges[strip], np.array([(west + east) / 2]), np.array([(south + north) / 2]))[0]:
                yield level, cx, cy, True, b""
        elif len(strip) <= few or level >= finest:
            yield level, cx, cy, False, edges[strip].tobytes()
        else:
            todo += [(level + 1, 2 * cx + i, 2 * cy + j, strip) for i in (0, 1) for j in (0, 1)]


def cells(areas: DataFrame, **options) -> DataFrame:
    """area, level, cx, cy, whole, edges: the coverings of areas(area, geometry), geometry in well-known binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                found = list(covering(rings_of(data.as_py()) or [], **options))
                for lo in range(0, len(found), 4096):
                    part = found[lo : lo + 4096]
                    columns = [pa.array([c[k] for c in part], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part), pa.int64())), *columns], names=["area", "level", "cx", "cy", "whole", "edges"])

    kind = areas.schema["area"].dataType.simpleString()
    return areas.select("area", "geometry").mapInArrow(run, f"area {kind}, level int, cx long, cy long, whole boolean, edges binary")


def measures(areas: DataFrame) -> DataFrame:
    """area, polygons, rings, west, east, south, north, square_degrees and square_miles (flat at the middle latitude), outer rings less holes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measure(rings_of(d.as_py())) for d in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], pa.int32() if k < 2 else pa.float64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["area", "polygons", "rings", "west", "east", "south", "north", "square_degrees"])

    kind = areas.schema["area"].dataType.simpleString()
    found = areas.select("area", "geometry").mapInArrow(run, f"area {kind}, polygons int, rings int, west double, east double, south double, north double, square_degrees double")
    return found.withColumn("square_miles", F.col("square_degrees") * F.cos(F.radians((F.col("south") + F.col("north")) / 2)) * MILES_PER_DEGREE * MILES_PER_DEGREE)


def _measure(polygons: list[list[np.ndarray]] | None) -> tuple:
    points = [r for rings in polygons or [] for r in rings if len(r)]
    if not points:
        return (None,) * 7
    every = np.vstack(points)
    size = sum((1 if k == 0 else -1) * abs(_shoelace(r)) for rings in polygons for k, r in enumerate(rings) if len(r))
    return len(polygons), len(points), *(float(v) for v in (every[:, 0].min(), every[:, 0].max(), every[:, 1].min(), every[:, 1].max(), size))


def _shoelace(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _ancestors(lon: Column, lat: Column, coarsest: int, finest: int) -> Column:
    """level, cx, cy of the cells of all levels that hold a point."""
    at = lambda c, level: F.floor((c + 180) / (F.lit(360.0) / F.pow(F.lit(2.0), level))).cast("long")
    return F.transform(F.sequence(F.lit(coarsest), F.lit(finest)), lambda k: F.struct(k.alias("level"), at(lon, k).alias("cx"), at(lat, k).alias("cy")))


def members(points: DataFrame, areas: DataFrame, coarsest: int = COARSEST, finest: int = FINEST, few: int = FEW_EDGES) -> DataFrame:
    """area, id: the points(id, lat, lon) inside areas(area, geometry)."""
    return located(points, areas, coarsest, finest, few).filter("inside").select("area", "id")


def located(points: DataFrame, areas: DataFrame, coarsest: int = COARSEST, finest: int = FINEST, few: int = FEW_EDGES) -> DataFrame:
    """area, id, lat, lon, inside, close: the points(id, lat, lon) inside areas(area, geometry) or close to their lines, where `inside` may be rounding's doing.

    A point is asked for in its cell of every level that a covering uses; the levels are
    looked up first, as there are `finest` of them at most.
    """
    covered = cells(areas, coarsest=coarsest, finest=finest, few=few)
    levels = sorted(r.level for r in covered.select("level").distinct().collect())  # one row a level
    if not levels:
        none = points.select("id", "lat", "lon").limit(0).join(areas.select("area").limit(0), F.lit(True))
        return none.select("area", "id", "lat", "lon", F.lit(False).alias("inside"), F.lit(False).alias("close"))
    held = points.filter("lat is not null and lon is not null").select("id", "lat", "lon", F.explode(F.filter(_ancestors(F.col("lon"), F.col("lat"), levels[0], levels[-1]), lambda c: c["level"].isin(levels))).alias("c"))
    met = held.select("id", "lat", "lon", "c.*").join(covered, ["level", "cx", "cy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            encoded = batch.column(4).dictionary_encode()
            codes, held_, close = encoded.indices.to_numpy(), np.zeros(len(x), bool), np.zeros(len(x), bool)
            for k, edges in enumerate(encoded.dictionary):
                mine = np.flatnonzero(codes == k)
                lines = np.frombuffer(edges.as_py(), EDGE)
                held_[mine], close[mine] = inside(lines, x[mine], y[mine]), close_to(lines, x[mine], y[mine])
            columns = [*(batch.column(k) for k in (3, 0, 1, 2)), pa.array(held_), pa.array(close)]
            yield pa.RecordBatch.from_arrays(columns, names=["area", "id", "lat", "lon", "inside", "close"]).filter(pa.array(held_ | close))

    border = met.filter("not whole").select("id", "lat", "lon", "area", "edges")
    kinds = {c: dict(met.dtypes)[c] for c in ("area", "id", "lat", "lon")}
    tested = border.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", inside boolean, close boolean")
    return met.filter("whole").select("area", "id", "lat", "lon", F.lit(True).alias("inside"), F.lit(False).alias("close")).union(tested)
