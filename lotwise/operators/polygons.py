"""Points in polygons, as a join by grid cells.

A polygon is a ring of points; its cells are those that its edges may touch (border) and those that lie inside between them (inner). A point is joined with
the polygons of its own cell only: in an inner cell it is inside, in a border cell its ray to the right is counted against the edges (even-odd rule). A cell
with very many points is split by adaptive execution like any hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(ring: Column) -> Column:
    """The edges of a ring as an array of (x1, y1, x2, y2); its last point is joined with the first."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def crosses(edge: Column, y: Column) -> Column:
    """Whether an edge reaches over the height ``y``; a height through a point counts for one of its two edges."""
    return (edge["y1"] > y) != (edge["y2"] > y)


def crossing(edge: Column, y: Column) -> Column:
    return (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / (edge["y2"] - edge["y1"]) + edge["x1"]


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of edges is to the right of the point."""
    right = F.filter(edges, lambda e: crosses(e, y) & F.when(crosses(e, y), x < crossing(e, y)).otherwise(False))
    return F.size(right) % 2 == 1


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def polygon_cells(polygons: DataFrame, key: str, size: float, ring: str = "ring") -> DataFrame:
    """Rows ``key``, ``cx``, ``cy`` and ``border`` of the cells of polygons, a row a cell. Edges are cut into pieces no longer than a cell, so each
    touches a few cells; inner cells are the stretches between crossings of a row's middle line."""
    whole = polygons.filter(F.size(ring) >= 3).select(key, edges_of(F.col(ring)).alias("edges"))
    edge = whole.select(key, F.explode("edges").alias("e"))
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("e.x2") - F.col("e.x1")), F.abs(F.col("e.y2") - F.col("e.y1"))) / F.lit(size)), F.lit(1))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")
    piece = edge.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    more = F.lit(size * 1e-9)  # rounding of the pieces' ends
    bounds = {}
    for axis in "xy":
        a, b = at(f"e.{axis}1", f"e.{axis}2", F.col("k")), at(f"e.{axis}1", f"e.{axis}2", F.col("k") + 1)
        bounds[axis] = F.sequence(_cell(F.least(a, b) - more, size), _cell(F.greatest(a, b) + more, size))
    border = piece.withColumn("cx", F.explode(bounds["x"])).withColumn("cy", F.explode(bounds["y"])).select(key, "cx", "cy").distinct()
    ys = F.flatten(F.transform("edges", lambda e: F.array(e["y1"], e["y2"])))
    rows = whole.withColumn("cy", F.explode(F.sequence(_cell(F.array_min(ys), size), _cell(F.array_max(ys), size))))
    middle = (F.col("cy") + F.lit(0.5)) * F.lit(size)
    xs = F.array_sort(F.transform(F.filter("edges", lambda e: crosses(e, middle)), lambda e: crossing(e, middle)))
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.size("xs") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.try_element_at("xs", i + 1).alias("a"), F.try_element_at("xs", i + 2).alias("b")))
    inner = rows.withColumn("xs", xs).withColumn("s", F.explode(stretches)).filter("s.b is not null")
    # cells whose middle lies in the stretch
    first, last = F.ceil(F.col("s.a") / F.lit(size) - 0.5), F.floor(F.col("s.b") / F.lit(size) - 0.5)
    inner = inner.withColumn("first", first).withColumn("last", last).filter("first <= last").select(key, F.explode(F.sequence("first", "last")).alias("cx"), "cy").distinct()
    inner = inner.join(border, [key, "cx", "cy"], "left_anti")
    return border.withColumn("border", F.lit(True)).unionByName(inner.withColumn("border", F.lit(False)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, size: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """The points, a row for each polygon (``key``) that they are in; points in none, or without coordinates, have no row."""
    cells = polygon_cells(polygons, key, size, ring)
    placed = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("cx", _cell(F.col(x), size)).withColumn("cy", _cell(F.col(y), size))
    found = placed.join(cells, ["cx", "cy"])
    sure = found.filter(~F.col("border"))
    near = found.filter("border").join(polygons.select(key, edges_of(F.col(ring)).alias("__edges")), key).filter(inside(F.col("__edges"), F.col(x), F.col(y)))
    return sure.select(*points.columns, key).unionByName(near.select(*points.columns, key))
