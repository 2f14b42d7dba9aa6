"""Metrics of rings and lines, on nested point arrays and on one row per vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = 3.141592653589793


def _steps(points: Column) -> Column:
    """Pairs of successive points."""
    return F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points)).alias("b"))


def line_length(points: Column) -> Column:
    """Length of a polyline of structs (x, y); 0 for one point, null for none."""
    near = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))))
    return F.when(F.size(points) > 1, F.aggregate(near, F.lit(0.0), lambda s, v: s + v)).when(F.size(points) == 1, F.lit(0.0))


def ring_area(points: Column) -> Column:
    """Area of a closed ring (last point = first) by the shoelace formula."""
    cross = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / F.lit(2.0)


def is_closed(points: Column) -> Column:
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return (F.size(points) >= 4) & (a["x"] == b["x"]) & (a["y"] == b["y"])


def linearity(points: Column) -> Column:
    """Distance of the ends over the length; null for a line without length."""
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))) / F.nullif(line_length(points), F.lit(0.0))


def fill_holes(rings: Column, least_area: Column | float) -> Column:
    """The rings of a polygon without holes smaller than the area."""
    return F.filter(rings, lambda r, i: (i == 0) | (ring_area(r) >= least_area))


def bounding_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def simple_metrics(area: Column, perimeter: Column, height: Column, longest_axis: Column, courtyard: Column) -> dict[str, Column]:
    """Closed-form descriptors of a polygon; volume is area by height."""
    volume = area * height
    return {
        "form_factor": (perimeter * height + area) / F.nullif(F.pow(volume, F.lit(2.0) / F.lit(3.0)), F.lit(0.0)),
        "fractal": F.lit(2.0) * F.log(perimeter / F.lit(4.0)) / F.log(area),
        "volume_facade": volume / F.nullif(perimeter * height, F.lit(0.0)),
        "square_compactness": F.pow(F.lit(4.0) * F.sqrt(area) / perimeter, F.lit(2.0)),
        "courtyard": courtyard / area,
        "shape_index": F.sqrt(area / F.lit(PI)) / (F.lit(0.5) * longest_axis),
        "width": F.lit(4.0) * area / perimeter,
        "roundness": F.lit(2.0) * F.sqrt(F.lit(PI) * area) / perimeter,
    }


def elongation(area: Column, perimeter: Column) -> Column:
    """Shorter over longer side, from area and perimeter of the minimum rotated rectangle."""
    root = F.sqrt(F.greatest(F.pow(perimeter, F.lit(2.0)) - F.lit(16.0) * area, F.lit(0.0)))
    side = lambda s: ((perimeter + s) / F.lit(4.0)) / (perimeter / F.lit(2.0) - (perimeter + s) / F.lit(4.0))
    return F.least(side(-root), side(root))


def vertex_metrics(vertices: DataFrame, key: str = "geom_id") -> DataFrame:
    """Area, perimeter and centroid of closed rings given one row per vertex (key, vtx_no, x, y).

    One shuffle by geometry: the next vertex comes from a window and the sums from the same partitioning.
    """
    w = Window.partitionBy(key).orderBy("vtx_no")
    edge = vertices.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).filter("x2 is not null")
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = edge.groupBy(key).agg(
        F.sum(cross).alias("a2"),
        F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y"), F.lit(2.0)))).alias("perimeter"),
        F.sum((F.col("x") + F.col("x2")) * cross).alias("cx"),
        F.sum((F.col("y") + F.col("y2")) * cross).alias("cy"),
        F.count(F.lit(1)).alias("n_edges"),
    )
    return sums.select(key, (F.abs("a2") / F.lit(2.0)).alias("area"), "perimeter", (F.col("cx") / (F.lit(3.0) * F.col("a2"))).alias("cx"), (F.col("cy") / (F.lit(3.0) * F.col("a2"))).alias("cy"), "n_edges")


def corner_angles(vertices: DataFrame, key: str = "geom_id") -> DataFrame:
    """The inner angle in degrees at each vertex of a closed ring, the closing vertex left out."""
    w = Window.partitionBy(key).orderBy("vtx_no")
    last = F.max("vtx_no").over(Window.partitionBy(key))
    open_ = vertices.withColumn("last", last).filter("vtx_no < last").drop("last")
    first = Window.partitionBy(key).orderBy("vtx_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = open_
    for c in ("x", "y"):
        around = around.withColumn(f"{c}0", F.coalesce(F.lag(c).over(w), F.last(c).over(first))).withColumn(f"{c}2", F.coalesce(F.lead(c).over(w), F.first(c).over(first)))
    ux, uy, vx, vy = F.col("x0") - F.col("x"), F.col("y0") - F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    cosine = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    return around.select(key, "vtx_no", "x", "y", F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))).alias("angle"))


def corner_distances(vertices: DataFrame, key: str = "geom_id", straight: float = 170.0) -> DataFrame:
    """(key, mean_distance, deviation) of the corners of each ring from its centroid.

    A ring without corners counts all its vertices, which are as good as on a circle, and deviates by nothing.
    """
    at = corner_angles(vertices, key).join(vertex_metrics(vertices, key).select(key, "cx", "cy"), key)
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))
    corner = F.when(F.col("angle") <= straight, d)
    return at.groupBy(key).agg(F.coalesce(F.avg(corner), F.max(d)).alias("mean_distance"), F.coalesce(F.stddev_pop(corner), F.lit(0.0)).alias("deviation"))


def is_right_angle(angle: Column) -> Column:
    return angle.between(80, 100) | angle.between(260, 280)
