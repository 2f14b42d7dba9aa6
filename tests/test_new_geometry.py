"""Centrelines, covers, planar networks, projections and file sinks on odd and on known shapes."""

from __future__ import annotations

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavegraph.functions import projections
from pavegraph.operators import cover, lines, medial
from pavegraph.sources import files, shapefile

RNG = np.random.default_rng(2)


def shut(points) -> np.ndarray:
    return np.array([*points, points[0]], float)


def length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum())


# centrelines


@pytest.mark.parametrize("w, h", [(30, 4), (50, 9), (12, 10)])
def test_centreline_of_a_rectangle(w, h):
    turn = np.array([(0.8, 0.6), (-0.6, 0.8)])
    ring = shut([(0, 0), (w, 0), (w, h), (0, h)]) @ turn
    inner, drawn = medial.centre_lines(ring, h / 10), medial.centre_lines(ring, h / 10, True)
    assert len(inner) == len(drawn) == 1
    assert length(inner[0]) == pytest.approx(w - h, abs=h / 8) and length(drawn[0]) == pytest.approx(w, abs=h / 4)
    assert np.abs((inner[0] @ turn.T)[:, 1] - h / 2).max() < h / 20


def test_centrelines_of_concave_rings():
    bent = shut([(0, 0), (40, 0), (40, 4), (4, 4), (4, 30), (0, 30)])
    found = medial.centre_lines(bent, 0.4)
    assert sum(map(length, found)) == pytest.approx(36 + 26, abs=4)
    cross = shut([(0, 18), (18, 18), (18, 0), (22, 0), (22, 18), (40, 18), (40, 22), (22, 22), (22, 40), (18, 40), (18, 22), (0, 22)])
    arms = medial.centre_lines(cross, 0.5)
    assert sum(map(length, arms)) == pytest.approx(4 * 18, abs=5)
    assert len(medial.centre_lines(shut([(0, 0), (5, 0), (5, 5), (0, 5)]), 0.5)) >= 1
    assert medial.centre_lines(shut([(0, 0), (5, 0), (9, 0)]), 0.5) == []


def test_triangulation_is_delaunay():
    p = RNG.uniform(0, 10, (80, 2))
    tri, centre, r2 = medial.delaunay(p)
    away = ((p[None] - centre[:, None]) ** 2).sum(2)
    assert (away >= r2[:, None] * (1 - 1e-9)).all() and len(tri) > 100


def test_lines_of_every_branch(spark):
    rings = {1: [(0, 0), (1, 0), (1, 1), (0, 1)], 2: [(0, 0), (20, 0), (20, 4), (0, 4)], 3: [(0, 0), (4, 0), (4, 3), (0, 3)], 4: [(0, 0), (30, 0), (30, 6), (6, 6), (6, 30), (0, 30)]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in [*r, r[0]]]) for k, r in rings.items()], "geom_id long, ring array<struct<x:double,y:double>>")
    found = {}
    for r in medial.crosswalk_lines(df).collect():
        found.setdefault((r.geom_id, r.branch), []).append(length(np.array(r.pts)))
    assert sorted(found) == [(2, "middle"), (3, "extend"), (4, "erode")]
    assert found[2, "middle"] == [pytest.approx(20)] and found[3, "extend"] == [pytest.approx(4)]
    assert sum(found[4, "erode"]) == pytest.approx(27 + 27, abs=8)
    side = {r.geom_id: r.branch for r in medial.sidewalk_lines(df).collect()}
    assert side == {2: "long", 4: "long"}
    none = df.filter("geom_id < 0")
    assert medial.crosswalk_lines(none).count() == 0 and medial.sidewalk_lines(none).count() == 0


# covers


def test_cover_against_sampling():
    for k in range(12):
        a = np.sort(RNG.uniform(0, 2 * np.pi, RNG.integers(3, 12)))
        ring = shut((RNG.uniform(-20, 20, 2) + np.stack([np.cos(a), np.sin(a)], 1) * RNG.uniform(2, 25, len(a))[:, None]).tolist())
        found = cover.cover([ring], 2.0, 4)
        tiles = {(x * 2**level + i, y * 2**level + j) for level, x, y in found for i in range(2**level) for j in range(2**level)}
        assert len(tiles) == sum(4**level for level, _, _ in found)  # none twice
        low, high = np.floor(ring.min(0) / 2).astype(int), np.ceil(ring.max(0) / 2).astype(int)
        for x in range(low[0] - 1, high[0] + 1):
            for y in range(low[1] - 1, high[1] + 1):
                at = np.stack(np.meshgrid(np.linspace(x * 2 + 0.01, x * 2 + 1.99, 25), np.linspace(y * 2 + 0.01, y * 2 + 1.99, 25)), -1).reshape(-1, 2)
                if cover._holds([ring], at).any():
                    assert (x, y) in tiles
        grown = [cover._crossed(np.array([t]), 2.0, ring[:-1], ring[1:])[0] or cover._holds([ring], np.array([t]) * 2.0 + 1)[0] for t in tiles]
        assert all(grown)


def test_tiles_on_a_line_of_the_grid_and_holes(spark):
    square, hole = [(0, 0), (16, 0), (16, 16), (0, 16), (0, 0)], [(4, 4), (12, 4), (12, 12), (4, 12), (4, 4)]
    ring = lambda r: [(float(x), float(y)) for x, y in r]
    polygons = spark.createDataFrame([(1, [ring(square), ring(hole)]), (2, None)], "geom_id long, rings array<array<struct<x:double,y:double>>>")
    tiles = spark.createDataFrame([(10 * x + y, x, y) for x in range(-1, 6) for y in range(-1, 6)], "idd long, col long, row long")
    inside = {r.idd for r in cover.tiles_meeting(tiles, polygons, 4.0).collect()}
    want = {10 * x + y for x in range(4) for y in range(4) if not (x in (1, 2) and y in (1, 2))}
    assert inside == want
    assert {r.idd for r in cover.tiles_meeting(tiles, polygons, 4.0, outside=True).collect()} == {r.idd for r in tiles.collect()} - want


# planar networks


def test_lines_on_each_other(spark):
    rows = [(1, [(0, 0), (10, 0)]), (2, [(4, 0), (14, 0)]), (3, [(6, 0), (2, 0)]), (4, [(5, -2), (5, 2)]), (5, [(10, 0), (10, 5)]), (6, [(0, 0), (10, 0)]), (7, [(0, 3), (3, 6)]), (8, [(2, 5), (5, 8)]), (9, [(1, 1)])]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in rows], "line_id long, pts array<struct<x:double,y:double>>")
    got = sorted(tuple(sorted(tuple(p) for p in r.pts)) for r in lines.planar(df, 4.0).collect())
    cuts = [0, 2, 4, 5, 6, 10, 14]
    want = [((float(a), 0.0), (float(b), 0.0)) for a, b in zip(cuts, cuts[1:])] + [((5.0, -2.0), (5.0, 0.0)), ((5.0, 0.0), (5.0, 2.0)), ((10.0, 0.0), (10.0, 5.0))]
    want += [((0.0, 3.0), (2.0, 5.0)), ((2.0, 5.0), (3.0, 6.0)), ((3.0, 6.0), (5.0, 8.0))]
    assert got == sorted(want)


def test_long_lines_lie_in_as_many_cells_as_they_pass(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0), (2, 5.0, 0.0, 5.0, 100.0), (3, 0.0, 3.0, 90.0, 3.0)], "line_id long, ax double, ay double, bx double, by double")
    n = {r.line_id: r["count"] for r in lines.spread(df, 10.0, 0.5).groupBy("line_id").count().collect()}
    assert n[1] < 450 and n[2] <= 24 and n[3] <= 12


# projections


def test_known_points(spark):
    df = spark.createDataFrame([(-73.9857, 40.7484), (151.2153, -33.8568), (3.0, 0.0)], "lon double, lat double")
    z = projections.zone(F.col("lon"))
    x, y = projections.of_zone(z, F.col("lat")).forward(F.col("lon"), F.col("lat"))
    got = df.select(z.alias("z"), x.alias("x"), y.alias("y")).collect()
    assert [r.z for r in got] == [18, 56, 31]
    assert got[2].x == pytest.approx(500_000, abs=1e-6) and got[2].y == pytest.approx(0, abs=1e-6)
    assert got[0].x == pytest.approx(585_628, abs=60) and got[0].y == pytest.approx(4_511_322, abs=60)
    assert got[1].x == pytest.approx(334_873, abs=60) and got[1].y == pytest.approx(6_252_266, abs=60)


# files


def test_files_byte_for_byte(spark, tmp_path):
    rows = [(f"a{k}.bin", bytes(RNG.integers(0, 256, k).tolist())) for k in range(30)] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    folder = str(tmp_path / "files")
    files.write_files(df, folder)
    assert {r.name: bytes(r.content) for r in files.read_files(spark, folder).collect()} == {n: c for n, c in rows if c}  # Spark's reader skips empty files
    assert sum(p.name == "null" for p in (tmp_path / "files").rglob("*")) == 1
    files.write_files(df.filter("name = 'a7.bin'"), folder)
    assert files.read_files(spark, folder).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.write_files(spark.createDataFrame([("x", b"1"), ("../x", b"2")], "name string, content binary"), folder)
    assert files.read_files(spark, folder).count() == 1 and not [p for p in (tmp_path / "files").iterdir() if p.name.startswith("_")]


def test_shapefiles_of_odd_rows(spark, tmp_path, monkeypatch):
    day = datetime.date(2024, 2, 29)
    outer, hole, island = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 20), (21, 20), (21, 21), (20, 20)]
    part = lambda r: [(float(x), float(y)) for x, y in r]
    rows = [(1, "ä" * 100, 1.5, True, day, [part(outer), part(hole), part(island)]), (2, None, None, None, None, None), (-(2**62), "", 1e-300, False, day, [part(outer)[::-1]])]
    schema = "id long, name string, size double, flag boolean, day date, parts array<array<struct<x:double,y:double>>>"
    folder = str(tmp_path / "shp")
    shapefile.write_shapefile(spark.createDataFrame(rows, schema).coalesce(1), folder)
    monkeypatch.setattr(shapefile, "RECORDS", 2)
    got = {r.id: r for r in shapefile.read_shapefile(spark, folder).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {r[0]: r[1:5] for r in rows}
    turn = lambda pts: np.sign(shapefile._area(np.array(pts)))
    assert [turn(p) for p in got[1].parts] == [-1, 1, -1] and got[2].parts is None
    assert [[tuple(p) for p in r] for r in got[-(2**62)].parts] == [part(outer)[::-1]]
    raw = next((tmp_path / "shp").rglob("*.shp")).read_bytes()
    assert struct.unpack(">i", raw[:4])[0] == 9994 and struct.unpack(">i", raw[24:28])[0] * 2 == len(raw) and struct.unpack("<ii", raw[28:36]) == (1000, 5)
    assert struct.unpack("<4d", raw[36:68]) == (0.0, 0.0, 21.0, 21.0)
    with pytest.raises(ValueError):
        shapefile.encoded_value("x" * 300, "C", 254)


def test_network_of_known_lines(spark):
    frame = lambda rows: spark.createDataFrame([([(float(x), float(y)) for x, y in p],) for p in rows], "pts array<struct<x:double,y:double>>")
    side = frame([[(0, 0), (20, 0)], [(10, 0), (30, 0)], [(0, 30), (20, 30)]])
    cross = frame([[(10, 5), (10, 25)], [(10, 5), (10, 25)]])
    found = {}
    for r in lines.network(side, cross.limit(1), 8.0).collect():
        found.setdefault(r.f_type, []).append(length(np.array(r.pts)))
    assert {k: (len(v), sum(v)) for k, v in found.items()} == {"sidewalk": (4, 50.0), "crosswalk": (1, 20.0), "sidewalk_connection": (2, 10.0)}


def test_nearest_lines_far_from_the_origin_tie(spark):
    """A point between two lines that mirror each other is as far from one as from the other."""
    from pavegraph.operators import lines

    far = 12_345.0
    pair = spark.createDataFrame([(k, [(far, 3.0), (far + 2.0 * s, 4.0)]) for k, s in ((1, 1), (2, -1))], "line_id long, pts array<struct<x:double,y:double>>")
    at = spark.createDataFrame([(k, far, 3.0 + k / 7) for k in range(1, 8)], "id long, x double, y double")
    found = lines.nearest_on_lines(at, pair, 12.0, digits=13).groupBy("id").count().collect()
    assert {r["count"] for r in found} == {2}
