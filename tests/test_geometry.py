"""Geometry operators that SQL cannot check, on small fixtures with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pavegraph.functions.shape import line_length
from pavegraph.operators import centerlines, lines, polygonize, topology

PTS = "array<struct<x:double,y:double>>"


def layer(spark, rows, key="line_id", column="pts"):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in pts]) for k, pts in rows], f"{key} long, {column} {PTS}")


def mask(spark, *grids):
    rows = [(t, r, c, int(v)) for t, grid in enumerate(grids) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "tile long, r int, c int, v int")


def test_rings_of_holes_and_corners_that_touch(spark):
    grid = np.full((12, 12), 3)
    grid[1:9, 1:9] = 0
    grid[3:6, 3:6] = 1  # a hole of nine pixels with a road in it
    grid[9, 9] = 0  # touches the sidewalk in a corner only
    got = {(r.v, r.area): r.n for r in polygonize.mask_rings(mask(spark, grid)).withColumn("area", polygonize.rings_area(F.col("rings"))).groupBy("v", "area").agg(F.collect_list(F.size("rings")).alias("n")).collect()}
    assert got == {(0, 55.0): [2], (1, 9.0): [1], (0, 1.0): [1], (3, 79.0): [2]}  # what touches in a corner is one hole
    layers = polygonize.feature_layers(mask(spark, grid)).collect()
    assert [(r.f_type, len(r.rings)) for r in layers] == [("sidewalk", 1)]  # the hole is under 25 pixels, the rest under 20


def test_every_pixel_is_in_one_ring(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 3, (20, 20))
    found = polygonize.mask_rings(mask(spark, grid)).select("v", polygonize.rings_area(F.col("rings")).alias("a")).groupBy("v").agg(F.sum("a").alias("a")).collect()
    assert {r.v: r.a for r in found} == {v: float((grid == v).sum()) for v in range(3)}


def test_merged_line_keeps_its_order_and_forks(spark):
    rows = [(1, [(0, 0), (1, 0)]), (2, [(2, 1), (1, 0)]), (3, [(2, 1), (3, 1)]), (4, [(3, 1), (4, 2)]), (5, [(3, 1), (4, 0)]), (6, [(9, 9), (8, 9), (8, 8)]), (7, [(8, 8), (9, 8), (9, 9)])]
    got = {r.chain: (r.n_lines, [(p.x, p.y) for p in r.pts]) for r in lines.merged_lines(layer(spark, rows)).collect()}
    assert got[1] == (3, [(0, 0), (1, 0), (2, 1), (3, 1)])
    assert got[4][0] == got[5][0] == 1
    assert got[6][0] == 2 and got[6][1][0] == got[6][1][-1] and len(got[6][1]) == 5


def test_extension_stops_at_a_barrier(spark):
    rows = [(1, [(0, 0), (5, 0)]), (2, [(8, -3), (8, 3)]), (3, [(0, 10), (5, 10)]), (4, [(8, 7), (8, 13)])]
    wall = layer(spark, [(9, [(6, 9), (6, 11)])])
    got = {r.line_id: [(round(p.x, 4), round(p.y, 4)) for p in r.pts] for r in lines.extended_lines(layer(spark, rows), 6.0, 4.0, wall).collect()}
    assert got[1] == [(0, 0), (5, 0), (8, 0)] and got[3] == [(0, 10), (5, 10)]
    free = {r.line_id: len(r.pts) for r in lines.extended_lines(layer(spark, rows), 6.0, 4.0).collect()}
    assert free == {1: 3, 2: 2, 3: 3, 4: 2}


def test_noding_gives_all_pieces(spark):
    rows = [(1, [(0, 0), (4, 0)]), (2, [(1, -1), (1, 1)]), (3, [(3, 0), (3, 2)])]
    got = {}
    for r in lines.noded(layer(spark, rows), 4.0).collect():
        got.setdefault(r.line_id, []).append([(p.x, p.y) for p in r.pts])
    assert sorted(got[1]) == [[(0, 0), (1, 0)], [(1, 0), (3, 0)], [(3, 0), (4, 0)]]
    assert sorted(got[2]) == [[(1, -1), (1, 0)], [(1, 0), (1, 1)]] and got[3] == [[(3, 0), (3, 2)]]


def test_network_with_islands(spark):
    walks = layer(spark, [(1, [(0, 0), (20, 0), (30, 0), (40, 0)]), (2, [(0, 20), (20, 20), (30, 20), (40, 20)])])
    crossing = layer(spark, [(5, [(10, 4), (10, 9)])])
    islands = spark.createDataFrame([(1, 12.0, 9.0)], "id long, x double, y double")
    out = lines.walk_network(walks, crossing, 16.0, islands=islands).withColumn("n", F.round(line_length(F.col("pts")), 6)).collect()
    assert sorted((r.f_type, r.n) for r in out) == [("crosswalk", 5.0), ("medians", 2.0), ("medians", round(29**0.5, 6)), ("sidewalk", 40.0), ("sidewalk", 40.0), ("sidewalk_connection", 4.0), ("sidewalk_connection", 9.0)]
    assert {r.line_id: r.open_end for r in lines.end_cases(crossing, 8.0).collect()} == {5: "both"}
    assert topology.segments(crossing).count() == 1


def test_centerlines_of_a_bar_and_a_fork(spark):
    bar = [(0, 0), (30, 0), (30, 4), (0, 4), (0, 0)]
    fork = [(0, 0), (30, 0), (30, 4), (17, 4), (17, 20), (13, 20), (13, 4), (0, 4), (0, 0)]
    found = centerlines.centerlines(layer(spark, [(1, bar), (2, fork)], "geom_id", "ring"), 0.5).withColumn("n", line_length(F.col("pts"))).collect()
    by = {k: sorted(r.n for r in found if r.geom_id == k) for k in (1, 2)}
    assert len(by[1]) == 1 and 25 < by[1][0] < 30
    assert 3 <= len(by[2]) <= 4 and 35 < sum(by[2]) < 46


def test_smoothing_only_touches_zigzags(spark):
    zigzag = [(i, 0.1 * (i % 2)) for i in range(12)]
    out = {r.line_id: len(r.pts) for r in lines.smoothed(layer(spark, [(1, zigzag), (2, zigzag[:5])]), 1.3).collect()}
    assert out == {1: 2, 2: 5}
