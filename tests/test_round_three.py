"""Faults of the third round: what grew faster than the tables, and what the driver or one task had to hold."""

from __future__ import annotations

import zlib

import numpy as np

from pavegraph.operators import cover, dissolve, polygons, spatial, topology
from pavegraph.sources import files, images


def points(spark, n, seed, side):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(0, side, (n, 2)), 1))], "id long, x double, y double")


def test_ancestors_of_tiles_are_never_broadcast(spark):
    """F1, F32: a file's size tells nothing of its tiles' ancestors."""
    tiles = spark.range(64).selectExpr("id as idd", "id div 8 as col", "id % 8 as row")
    ring = [(1.0, 1.0), (40.0, 1.0), (40.0, 20.0), (1.0, 20.0), (1.0, 1.0)]
    layer = spark.createDataFrame([(1, [ring])], "geom_id long, rings array<array<struct<x:double,y:double>>>")
    met = cover.meeting(tiles, layer, 8.0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.idd for r in met.collect()) == [c * 8 + r for c in range(5) for r in range(3)]
    marked = cover.tiles_marked(tiles, layer, 8.0)
    assert "Broadcast" not in marked._jdf.queryExecution().executedPlan().toString() and marked.filter("inside").count() == 15


def test_squares_larger_than_a_polygon_are_not_tried(monkeypatch):
    tried = []
    crossed = cover._crossed
    monkeypatch.setattr(cover, "_crossed", lambda cells, size, a, b: tried.append(size) or crossed(cells, size, a, b))
    ring = np.array([(1.0, 1.0), (40.0, 1.0), (40.0, 20.0), (1.0, 20.0), (1.0, 1.0)])
    cover.cover([ring], 8.0, 12)
    assert max(tried) == 16.0


def test_nearest_in_crowded_cells(spark, monkeypatch):
    """smaller cells first, with ties, and points that find nothing near."""
    left, right = points(spark, 150, 1, 10.0), points(spark, 600, 2, 10.0).union(spark.createDataFrame([(1000, 14.9, 5.0)], "id long, x double, y double"))
    far = left.union(spark.createDataFrame([(1000, 17.0, 5.0), (1001, 30.0, 5.0)], "id long, x double, y double"))
    seen = []
    plain = spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, r: seen.append(r) or plain(a, b, r))
    got = {(r.left_id, r.right_id) for r in spatial.nearest_within(far, right, 5.0).collect()}
    assert min(seen) < 5.0
    a, b = ([tuple(r) for r in df.collect()] for df in (far, right))
    want = set()
    for i, x, y in a:
        d = [(round(((x - p) ** 2 + (y - q) ** 2) ** 0.5, 9), j) for j, p, q in b]
        want |= {(i, j) for e, j in d if e == min(d)[0] and e <= 5.0}
    assert got == want


def test_counts_within_a_distance_need_no_pairs(spark, monkeypatch):
    """crowded squares are dealt into parts whose counts add up."""
    monkeypatch.setattr(spatial, "GROUP", 50)
    left, right = points(spark, 200, 3, 20.0), points(spark, 400, 4, 20.0)
    a, b = ([tuple(r) for r in df.collect()] for df in (left, right))
    want = {i: n for i, x, y in a if (n := sum(((x - p) ** 2 + (y - q) ** 2) ** 0.5 <= 3.0 for _, p, q in b))}
    assert {r.left_id: r.n for r in spatial.count_within(left, right, 3.0).collect()} == want


def test_few_rows_are_dealt_out(spark):
    """Kernels ran in the one task that a small file is."""
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 0.0)]
    one = spark.createDataFrame([(k, ring) for k in range(40)], "id long, ring array<struct<x:double,y:double>>").coalesce(1)
    assert polygons.enclosing_circles(one).rdd.getNumPartitions() > 1
    assert polygons.box_rings(polygons.hull_rings(one)).rdd.getNumPartitions() == polygons.hull_rings(one).rdd.getNumPartitions()


def test_runs_of_cells_and_their_parts(spark, monkeypatch):
    """rows of runs in place of cells, over the borders of groups too."""
    monkeypatch.setattr(dissolve, "WIDTH", 8)
    monkeypatch.setattr(dissolve, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rings = []
    for x, y, w, h in rng.integers(1, 18, (14, 4)).tolist():
        w, h = w % 7 + 1, h % 7 + 1
        rings.append([(x - 9.0, y - 9.0), (x - 9.0 + w, y - 9.0), (x - 9.0 + w / 2, y - 9.0 + h), (x - 9.0, y - 9.0)])
    layer = spark.createDataFrame([("a", r) for r in rings], "f_type string, ring array<struct<x:double,y:double>>").cache()
    held = set()
    for r in rings:
        for cx in range(-40, 60):
            for cy in range(-40, 60):
                px, py = (cx + 0.5) / 2, (cy + 0.5) / 2
                if sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:])) % 2:
                    held.add((cx, cy))
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    wide = {(x + i, y + j) for x, y in held for i, j in near}
    back = {c for c in wide if all((c[0] + i, c[1] + j) in wide for i, j in near)}
    cells = lambda runs: sorted((r.cx, r.cy) for r in dissolve.cells_of(runs).collect())
    runs = dissolve.runs(layer, 0.5)
    assert cells(runs) == sorted(held)
    assert cells(dissolve.wider(runs, 1)) == sorted(wide)
    assert cells(dissolve.narrower(dissolve.wider(runs, 1), 1)) == sorted(back)
    want = sorted(tuple(r) for r in dissolve.dissolved(dissolve.rasterised(layer, 0.5)).collect())
    assert sorted(tuple(r) for r in dissolve.run_parts(runs).collect()) == want


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """the driver had an entry for every file."""
    monkeypatch.setattr(files, "BATCH_FILES", 3)
    rows = spark.range(40).selectExpr("concat(id, '.bin') as name", "cast(if(id % 4 = 0, '', concat('x', id)) as binary) as content")
    files.write_files(rows, str(tmp_path / "out"))
    read = files.read_files(spark, str(tmp_path / "out"))
    assert "FileScan" not in read._jdf.queryExecution().toString()
    assert sorted((r.name, bytes(r.content).decode()) for r in read.collect()) == sorted((f"{k}.bin", f"x{k}") for k in range(40) if k % 4)


def test_png_filters():
    rng = np.random.default_rng(6)
    px = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    assert (images.unpng(images.png(px)) == px).all()
    raw, up, out = px.astype(int).reshape(5, 12), np.zeros(12, int), b""
    for kind, row in enumerate(raw):
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, up[:-3]]
        guess = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
        best = np.where((guess[0] <= guess[1]) & (guess[0] <= guess[2]), left, np.where(guess[1] <= guess[2], up, corner))
        out += bytes([kind]) + ((row - (0, left, up, (left + up) // 2, best)[kind]) % 256).astype(np.uint8).tobytes()
        up = row
    plain = images.png(px)
    at = plain.index(b"IDAT")
    body = zlib.compress(out)
    made = plain[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0" + plain[plain.index(b"IEND") - 4 :]
    assert (images.unpng(made) == px).all() and images.unpng(b"no image") is None


def test_rays_meet_lines_in_wide_cells(spark, monkeypatch):
    """lines had a row for every cell of a few units that they go through."""
    sizes = []
    plain = topology._met_by_rays
    monkeypatch.setattr(topology, "_met_by_rays", lambda a, b, size: sizes.append(size) or plain(a, b, size))
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0)]), (2, [(9.0, -50.0), (9.0, 50.0)])], "line_id long, pts array<struct<x:double,y:double>>")
    assert [(r.line_id, r.which, r.dist) for r in topology.extension_hits(lines, 6.0, 4.0).collect()] == [(1, "end", 5.0)]
    assert sizes == [18.0]


def test_stitched_grid_is_that_of_the_sql(spark):
    """a larger table has more tiles than the grid; ``stitch_pixels_whole`` has them all."""
    from pavegraph.plans.catalogue import QUERIES

    folder = "/root/testdata/sf0.1"
    assert QUERIES["stitch_pixels"](spark, folder).count() == 640 * 64
    whole = QUERIES["stitch_pixels_whole"](spark, folder)
    last = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("max(vec_id) as m").first().m
    assert whole.count() == (last // 64 + 1) * 64 * 64
