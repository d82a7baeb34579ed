"""Points in polygons against brute force, at cells of all sizes."""

import math
import random

import pytest

from lotwise.operators import polygons as P

POLYGONS = {
    "square": [(0, 0), (10, 0), (10, 10), (0, 10)],
    "star": [(5 + (4 if k % 2 else 11) * math.cos(k * math.pi / 5), 5 + (4 if k % 2 else 11) * math.sin(k * math.pi / 5)) for k in range(10)],
    "comb": [(0, 0), (20, 0), (20, 8), (18, 8), (18, 2), (14, 2), (14, 8), (12, 8), (12, 2), (8, 2), (8, 8), (6, 8), (6, 2), (2, 2), (2, 8), (0, 8)],
    "bow": [(-5, -5), (5, 5), (5, -5), (-5, 5)],  # crosses itself
    "sliver": [(0, 0), (30, 0.01), (30, 0.02)],
    "line": [(0, 0), (1, 1)],
}


def brute(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.3, 1.0, 7.0, 100.0])
def test_points_against_brute_force(spark, size):
    rnd = random.Random(size)
    points = [(i, rnd.uniform(-12, 32), rnd.uniform(-12, 18)) for i in range(1500)] + [(2000 + i, rnd.uniform(0, 30), rnd.uniform(0, 0.02)) for i in range(200)]
    points += [(3000 + i, float(x), float(y)) for i, (x, y) in enumerate(p for ring in POLYGONS.values() for p in ring)] + [(4000 + i, float(i % 20), float(i // 20)) for i in range(200)] + [(9000, None, 1.0)]
    rings = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring]) for k, ring in POLYGONS.items()], "pid string, ring array<struct<x: double, y: double>>")
    got = sorted((r.id, r.pid) for r in P.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), rings, "pid", size).collect())
    assert got == sorted((i, k) for i, x, y in points if x is not None for k, ring in POLYGONS.items() if len(ring) > 2 and brute(x, y, [(float(a), float(b)) for a, b in ring]))


def test_inner_cells_need_no_ray(spark):
    rings = spark.createDataFrame([("s", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "pid string, ring array<struct<x: double, y: double>>")
    cells = {(r.cx, r.cy): r.border for r in P.polygon_cells(rings, "pid", 1.0).collect()}
    assert all(cells[x, y] is False for x in range(1, 9) for y in range(1, 9)) and cells[0, 5] is True and cells[-1, 0] is True
