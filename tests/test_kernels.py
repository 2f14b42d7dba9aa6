"""Polygon kernels against definitions, on fixed and random shapes."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pavegraph.functions import shape
from pavegraph.operators import polygons
from pavegraph.sources import catalog, paths

points = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=30)


@settings(max_examples=60, deadline=None)
@given(points)
def test_hull_holds_all_points(p):
    xy = np.array(p, float)
    h = polygons.hull(xy)
    if len(h) < 3:
        return
    d = np.roll(h, -1, 0) - h
    for q in xy:
        assert (d[:, 0] * (q[1] - h[:, 1]) - d[:, 1] * (q[0] - h[:, 0]) >= -1e-9).all()


@settings(max_examples=60, deadline=None)
@given(points)
def test_circle_holds_all_points_and_rests_on_two(p):
    xy = np.array(p, float)
    x, y, r = polygons.circle(xy)
    away = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
    assert (away <= r + 1e-6 * (1 + r)).all()
    if len(np.unique(xy, axis=0)) > 1:
        assert (np.abs(away - r) < 1e-6 * (1 + r)).sum() >= 2


@settings(max_examples=60, deadline=None)
@given(points, st.floats(0.1, 20))
def test_simplified_line_stays_near(p, tolerance):
    xy = np.array(p, float)
    s = polygons.simplify(xy, tolerance)
    assert (s[0] == xy[0]).all() and (s[-1] == xy[-1]).all()
    for q in xy:
        best = np.hypot(*(q - s).T).min()
        for a, b in zip(s, s[1:]):
            d = b - a
            n = d @ d
            t = np.clip((q - a) @ d / n, 0, 1) if n else 0
            best = min(best, np.hypot(*(q - a - t * d)))
        assert best <= tolerance + 1e-9


def test_offset_of_a_square_has_mitred_corners():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    assert abs(polygons.area(polygons.offset(square, 1)[:-1])) == 36
    assert abs(polygons.area(polygons.offset(square, -1)[:-1])) == 4
    assert polygons.offset(square, -3) is None


def test_collinear_vertices_go():
    ring = np.array([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    assert polygons.drop_collinear(ring, 1).tolist() == [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]


def test_degenerate_rings_are_null(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")
    assert [r.box_area for r in polygons.hulls_and_boxes(df).orderBy("id").collect()] == [None, None, None]
    assert df.select(shape.line_length(F.col("ring")).alias("n")).filter("n > 0").count() == 1


def test_source_descriptions(spark):
    text = '{"fullExtent":{"xmin":1.0,"ymin":2.0,"xmax":3.0,"ymax":4.0},"tileInfo":{"lods":[{"level":3},{"level":23}]}}'
    row = catalog.metadata(spark.createDataFrame([("a", text)], "name string, json string")).first()
    assert (row.west, row.north, row.zoom) == (1.0, 4.0, 20)
    xml = "<C xmlns='urn:x'><Layer><Identifier>b-g</Identifier></Layer><Layer><Identifier>c</Identifier></Layer></C>"
    row = spark.createDataFrame([(xml,)], "x string").select(catalog.pick_layer(catalog.layers(F.col("x")), F.array(F.lit("z"))).alias("p")).first()
    assert row.p == "c"
    kinds = spark.createDataFrame([("image/jpeg; q=1",), ("text/html",)], "t string").select(catalog.extension_of(F.col("t")).alias("e")).collect()
    assert [k.e for k in kinds] == ["jpeg", None]


def test_path_without_format_is_null(spark):
    row = spark.createDataFrame([("input/a/b.png",)], "p string").select(paths.parse_path(F.col("p"), "input/{x}/{y}.png", "x").alias("x")).first()
    assert row.x is None


def test_stitching_keeps_tiles_beyond_the_smallest_grid(spark):
    from types import SimpleNamespace

    from pavegraph.plans import tiles

    px = spark.createDataFrame([(t, 1, 2, 3) for t in (0, 639, 640, 1999)], "tile long, r int, c int, v int")
    got = tiles.stitch_pixels(SimpleNamespace(spark=spark, mask_px=lambda: px)).filter("v = 3").collect()
    assert sorted((r.big_col, r.big_row, r.r, r.c) for r in got) == sorted((t // 16 // 4, t % 16 // 4, t % 16 % 4 * 8 + 1, t // 16 % 4 * 8 + 2) for t in (0, 639, 640, 1999))
