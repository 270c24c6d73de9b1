"""Multipolygons from binary: measures, coverings and members against a plain crossing count."""

import struct

import numpy as np
import pytest

from wayfind.operators import geometry as g


def plain_inside(polygons, x, y):
    crossings = 0
    for ring in (r for rings in polygons for r in rings):
        pts = [tuple(p) for p in ring]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (y < y1) != (y < y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                crossings += 1
    return crossings % 2 == 1


def star(cx, cy, r, n, seed):
    rng = np.random.default_rng(seed)
    angle, far = np.arange(n) * 2 * np.pi / n, r * rng.uniform(0.5, 1.0, n)
    ring = np.stack([cx + far * np.cos(angle), cy + far * np.sin(angle)], axis=1)
    return np.vstack([ring, ring[:1]])


AREAS = {
    "state": [[star(-105.0, 39.0, 4.0, 900, 1), star(-105.0, 39.0, 1.5, 60, 2)], [star(-98.0, 37.0, 1.0, 40, 3)]],
    "city": [[star(-105.0, 39.7, 0.02, 50, 4)]],
    "box": [[np.array([(0.0, 0.0), (45.0, 0.0), (45.0, 45.0), (0.0, 45.0), (0.0, 0.0)])]],
}


def test_members_are_those_of_a_plain_count(spark):
    rng = np.random.default_rng(7)
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(np.concatenate([rng.uniform((-110, 34), (-96, 44), (3000, 2)), rng.normal((-105, 39.7), 0.02, (1500, 2)), [(0, 0), (45, 45), (10, 10), (0, 10), (45, 10), (10, 45)]]))]
    points += [(10_000, None, 1.0), (10_001, 10.0, None), (10_002, 91.0, 200.0)]
    areas = [(a, g.to_wkb(p)) for a, p in AREAS.items()] + [("null", None), ("empty", b""), ("cut", g.to_wkb(AREAS["city"])[:-5]), ("point", struct.pack("<BIdd", 1, 1, 0.0, 0.0))]
    got = g.members(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(areas, "area string, geometry binary"))
    want = {(a, i) for a, p in AREAS.items() for i, y, x in points if y is not None and x is not None and plain_inside(p, x, y)}
    assert {(r.area, r.id) for r in got.collect()} == want and len(want) > 500
    none = spark.createDataFrame(areas[3:], "area string, geometry binary")
    assert g.members(spark.createDataFrame(points, "id long, lat double, lon double"), none).count() == 0


def test_points_close_to_a_line_are_marked_whatever_their_cell(spark):
    """Lines a rounding away from the edge of a cell, with points in the cell beyond."""
    off = np.nextafter(-90.0, -91.0)
    hole = np.array([(off - 1, 10.0), (off, 10.0), (off, 20.0), (off - 1, 20.0), (off - 1, 10.0)])
    outer = np.array([(-135.0, np.nextafter(0.0, 1.0)), (-60.0, np.nextafter(0.0, 1.0)), (-60.0, 40.0), (-135.0, 40.0), (-135.0, np.nextafter(0.0, 1.0))])
    points = [("hole", 15.0, -90.0), ("below", 0.0, -80.0), ("west", 5.0, -135.0 - 1e-13), ("in", 15.0, -89.9), ("held", 15.0, -90.5), ("out", -0.1, -80.0)]
    got = g.located(spark.createDataFrame(points, "id string, lat double, lon double"), spark.createDataFrame([("a", g.to_wkb([[outer, hole]]))], "area string, geometry binary"))
    assert {r.id: (r.inside, r.close) for r in got.collect()} == {"hole": (True, True), "below": (False, True), "west": (False, True), "in": (True, False)}


def test_coverings_follow_the_outline():
    cells = list(g.covering(AREAS["state"]))
    whole = sum((360 / 2 ** c[0]) ** 2 for c in cells if c[3])
    border = sum((360 / 2 ** c[0]) ** 2 for c in cells if not c[3])
    size = g._measure(AREAS["state"])[6]
    assert whole < size < whole + border and len({c[0] for c in cells if c[3]}) > 2
    assert max(len(c[4]) // g.EDGE.itemsize for c in cells if c[0] < g.FINEST) <= g.FEW_EDGES
    edges = g.edges_of(AREAS["state"])
    outline = np.hypot(edges["x2"] - edges["x1"], edges["y2"] - edges["y1"]).sum()
    assert len({c[:3] for c in cells}) == len(cells) < 3 * outline / (360 / 2**g.FINEST)  # cells grow with the outline, not with the area


def test_measures_and_layouts(spark):
    square, hole = np.array([(0.0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), np.array([(1.0, 1), (1, 2), (2, 2), (2, 1), (1, 1)])
    two = [[square, hole], [square + 10]]
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 5) + square.astype(">f8").tobytes()
    with_z = struct.pack("<BIII", 1, 3 | 0x80000000 | 0x20000000, 4326, 1) + struct.pack("<I", 5) + np.column_stack([square, np.ones(5)]).astype("<f8").tobytes()
    iso_z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 5) + np.column_stack([square, np.ones(5)]).astype("<f8").tobytes()
    rows = [("two", g.to_wkb(two)), ("big", big), ("z", with_z), ("iso", iso_z), ("none", None), ("bad", b"\x01\x03")]
    got = {r.area: r for r in g.measures(spark.createDataFrame(rows, "area string, geometry binary")).collect()}
    assert (got["two"].polygons, got["two"].rings, got["two"].square_degrees, got["two"].west, got["two"].north) == (2, 3, 31.0, 0.0, 14.0)
    assert {got[k].square_degrees for k in ("big", "z", "iso")} == {16.0} and got["none"].square_miles is None and got["bad"].rings is None


@pytest.mark.parametrize("seed", range(3))
def test_binary_round_trip(seed):
    polygons = [[star(seed, 1, 2, 12, seed), star(seed, 1, 0.5, 7, seed)], [star(50, 1, 2, 5, seed)]]
    back = g.rings_of(g.to_wkb(polygons))
    assert all((a == b).all() for p, q in zip(polygons, back, strict=True) for a, b in zip(p, q, strict=True))
