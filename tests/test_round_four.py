"""Faults of the findings of round three: steps that took Python's time for every polygon, and what one row had to hold."""

from __future__ import annotations

import time

import numpy as np
import pytest

from pavegraph.functions.storage import dealt
from pavegraph.operators import arrangement, medial, overlay, polygons, topology

RINGS = "rings array<array<struct<x:double,y:double>>>"


def shut(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def test_cells_are_solved_at_once():
    """thousands of cells by one run of the same few array steps."""
    cells, size = 4000, 2 * 256_000_000
    ring = np.array([(11, 11), (41, 11), (41, 21), (21, 21), (21, 31), (11, 31)]) * 1001
    sides = np.hstack([ring, np.roll(ring, -1, 0)])
    e = np.concatenate([sides, sides + 8008])
    cell = np.repeat(np.arange(cells), len(e))
    began = time.perf_counter()
    where, closed, length, points = arrangement.boundaries(np.tile(e, (cells, 1)), np.tile([[1, 0]], (len(cell), 1)), cell, size, np.zeros((cells, 2), np.int64), overlay.RULES["union"])
    assert time.perf_counter() - began < 10
    assert where.tolist() == list(range(cells)) and closed.all() and len(set(length.tolist())) == 1
    assert (points.reshape(cells, -1, 2) == points[: length[0]]).all()


def test_a_part_beside_the_foot_of_another(spark):
    """of two sides that leave one corner upwards, the eastern one is the one that is seen from the east."""
    rows = [("a", [shut([(10, 10), (15, 20), (5, 20)])]), ("a", [shut([(20, 10), (22, 10), (22, 12), (20, 12)])])]
    found = overlay.dissolved(spark.createDataFrame(rows, f"f_type string, {RINGS}")).collect()
    assert sorted(r.area for r in found) == pytest.approx([4.0, 50.0])


def test_strips_of_many_lines_at_once():
    row = np.repeat([0, 1, 2, 3], [3, 2, 2, 5])
    p = np.array([(0, 0), (4, 0), (4, 3), (1, 1), (1, 1), (0, 0), (5, 0), (0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float)
    rows, length, _ = overlay._strips(row, p, np.array([1.0, 1.0, -1.0, 1.0]), False)
    assert sorted(rows.tolist()) == [0] * 3 + [2] + [3] * 7 and set(length.tolist()) == {5}


def test_outlines_are_triangulated_together(monkeypatch):
    """as if each were alone, and in a fraction of the time."""
    rng = np.random.default_rng(4)
    sets = [rng.uniform(0, 50, (n, 2)) for n in (3, 0, 40, 12, 2, 40, 1, 90)]
    for together in (1, 100, 65_536):
        monkeypatch.setattr(medial, "TOGETHER", together)
        for p, (tri, centre, r2) in zip(sets, medial.delaunays(sets)):
            assert len({tuple(sorted(t)) for t in tri.tolist()}) == len(tri) and (len(tri) > 0) == (len(p) > 2)
            for t, c, r in zip(tri, centre, r2):
                d = ((p - c) ** 2).sum(1)
                assert np.allclose(d[t], r) and (d > r * (1 - 1e-9)).all()
    many = [np.random.default_rng(k).uniform(0, 50, (60, 2)) for k in range(1500)]
    began = time.perf_counter()
    assert len(medial.delaunays(many)) == 1500 and time.perf_counter() - began < 6


def test_many_rows_are_dealt_into_more_tasks(spark):
    """what a task has to sort does not grow with the table."""
    assert dealt(spark.range(10), rows=20_000_000).rdd.getNumPartitions() == 40


def circle(x, y, r, n):
    a = np.arange(n) * 2 * np.pi / n + 0.1
    return shut(np.round(np.stack([x + r * np.cos(a), y + r * np.sin(a)], 1), 6).tolist())


def test_rings_do_not_travel_with_their_holes(spark):
    """thousands of holes in one long ring, islands in holes, a neighbour whose box holds some of them."""
    rows = [("a", circle(0, 0, 1000, 20_000), 3e6), ("b", circle(0, 0, 900, 50), 2.5e6), ("a", circle(0, 0, 300, 40)[::-1], -2.7e5), ("a", circle(0, 0, 200, 30), 1.2e5)]
    at = [(x, y) for x in range(-960, 961, 32) for y in range(-960, 961, 32)]
    where = [(x, y, np.hypot(x, y)) for x, y in at]
    rows += [("a", circle(x, y, 5, 4)[::-1], -50.0) for x, y, d in where if d < 190 or 310 < d < 990]
    rows += [("b", circle(x + 7, y, 5, 4)[::-1], -50.0) for x, y, d in where if d < 800]
    began = time.perf_counter()
    found = overlay.nested(spark.createDataFrame(rows, "f_type string, ring array<struct<x:double,y:double>>, area double")).collect()
    assert time.perf_counter() - began < 45
    want = {"a": sorted([1 + sum(d < 190 for *_, d in where), 2 + sum(310 < d < 990 for *_, d in where)]), "b": [1 + sum(d < 800 for *_, d in where)]}
    assert {k: sorted(len(r.rings) for r in found if r.f_type == k) for k in ("a", "b")} == want


def test_least_boxes_of_many_rings_at_once(spark):
    """as of each ring alone, with rings without area between them."""
    rng = np.random.default_rng(6)
    rings = [rng.uniform(0, 20, (n, 2)) for n in (3, 5, 0, 5, 2, 9, 3, 5)]
    for p, box, line in zip(rings, polygons.rotated_boxes(rings), polygons.mid_axes_of(rings)):
        assert (box is None) == (line is None) == (len(p) < 3)
        if box is not None:
            sides = np.hypot(*(box[1] - box[0])), np.hypot(*(box[2] - box[1]))
            angles = np.linspace(0, np.pi / 2, 2000)
            spans = [np.ptp(p @ np.array([np.cos(a), np.sin(a)])) * np.ptp(p @ np.array([-np.sin(a), np.cos(a)])) for a in angles]
            assert sides[0] * sides[1] <= min(spans) + 1e-9
            assert np.hypot(line[2] - line[0], line[3] - line[1]) == pytest.approx(max(sides))
    df = spark.createDataFrame([(1, circle(0, 0, 2, 4)), (2, None), (3, [(0.0, 0.0), (1.0, 1.0)])], "geom_id long, ring array<struct<x:double,y:double>>")
    found = {r.geom_id: r.hull for r in polygons.hull_rings(df).collect()}
    assert len(found[1]) == 5 and found[2] is None and found[3] is None
    many = [rng.uniform(0, 20, (7, 2)) for _ in range(20_000)]
    began = time.perf_counter()
    assert len(polygons.mid_axes_of(many)) == 20_000 and time.perf_counter() - began < 2.5


def test_centrelines_of_many_rings_at_once():
    """as of each ring alone, loops and squares between them, in a fraction of the time."""
    slit = shut([(0, 0), (20, 0), (20, 20), (0, 20), (0, 0.01), (4, 4), (4, 16), (16, 16), (16, 4), (4.01, 3.99)])
    rings = [slit, shut([(0, 0), (5, 0), (5, 5), (0, 5)]), shut([(0, 0), (5, 0), (9, 0)]), shut([(0, 0), (30, 0), (30, 6), (6, 6), (6, 30), (0, 30)])]
    rings = [np.array(r) + (300.0 * k, 0) for k, r in enumerate([*rings, *rings[::-1]])]
    gap = np.linspace(0.4, 0.8, len(rings))
    row, length, points = medial.centre_lines_of(np.array(list(map(len, rings))), np.concatenate(rings), gap, True)
    found = np.split(points, np.cumsum(length)[:-1])
    alone = [(k, line) for k, ring in enumerate(rings) for line in medial.centre_lines(ring, gap[k], True)]
    assert row.tolist() == [k for k, _ in alone] and all(np.allclose(a, b) for a, (_, b) in zip(found, alone))
    assert sorted(set(row.tolist())) == [0, 1, 3, 4, 6, 7]
    n = 3000
    many = np.concatenate([np.array(shut([(0, 0), (w, 0), (w, 4), (6, 4), (6, 20), (0, 20)])) + (100 * w, 0) for w in np.linspace(20, 40, n)])
    began = time.perf_counter()
    row, _, _ = medial.centre_lines_of(np.full(n, 7), many, np.full(n, 1.0), True)
    assert time.perf_counter() - began < 5 and len(set(row.tolist())) == n


def test_hulls_of_many_rings_at_once():
    """as of each ring alone."""
    rng = np.random.default_rng(8)
    rings = [rng.integers(0, 9, (n, 2)).astype(float) for n in [0, 1, 2, 3, 80, *rng.integers(3, 12, 400)]]
    assert all(a.tolist() == b.tolist() for a, b in zip(polygons.hulls(rings), map(polygons.hull, rings)))
    many = [rng.uniform(0, 20, (7, 2)) for _ in range(20_000)]
    began = time.perf_counter()
    polygons.hulls(many)
    assert time.perf_counter() - began < 0.6


def test_rays_meet_lines_in_buckets_of_cells(spark):
    """the nearest line ahead of each end, in cells of few lines and of many."""
    rng = np.random.default_rng(9)
    for plane, n in ((2000.0, 1500), (30.0, 300)):
        a = rng.uniform(0, plane, (n, 2))
        ends = np.stack([a, a + rng.uniform(-8, 8, (n, 2))], 1)
        lines = spark.createDataFrame([(k, [tuple(map(float, p)) for p in pts]) for k, pts in enumerate(ends)], "line_id long, pts array<struct<x:double,y:double>>")
        found = {(r.line_id, r.which): r.dist for r in topology.extension_hits(lines, 12.0, 8.0).collect()}
        want = {}
        p, r = ends[:, 0], ends[:, 1] - ends[:, 0]
        for k in range(n):
            for which, at, back in (("start", 0, 1), ("end", 1, 0)):
                u = (ends[k, at] - ends[k, back]) / np.hypot(*(ends[k, at] - ends[k, back])) * 12
                q = p - ends[k, at]
                det = u[0] * r[:, 1] - u[1] * r[:, 0]
                t, s = (q[:, 0] * r[:, 1] - q[:, 1] * r[:, 0]) / np.where(det, det, np.nan), (q[:, 0] * u[1] - q[:, 1] * u[0]) / np.where(det, det, np.nan)
                hit = (t > 0) & (t <= 1) & (s >= 0) & (s <= 1) & (np.arange(n) != k)
                if hit.any():
                    want[k, which] = t[hit].min() * 12
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(d, abs=1e-2) for k, d in want.items())


def test_several_overlays_of_one_arrangement(spark):
    """as each by itself, with a null key and a text that looks like the marks between them."""
    rng = np.random.default_rng(11)
    rows = [(k, [shut([(x, y), (x + 90, y + 10), (x + 40, y + 70)])]) for k in ("a=b", None, "") for x, y in rng.uniform(0, 300, (6, 2))]
    a, b = (overlay.directed(spark.createDataFrame(part, f"f_type string, {RINGS}"), "f_type") for part in (rows[::2], rows[1::2]))
    hows = ("union", "intersection", "difference", "symmetric")
    total = lambda rows: sorted(((r.f_type is None, r.f_type or "", round(r.area, 6), len(r.ring)) for r in rows))
    found = overlay.overlays(a, b, hows).collect()
    for how in hows:
        assert total(r for r in found if r.how == how) == total(overlay.overlay(a, b, how).collect())


def test_lines_of_a_square_are_joined_by_arrays():
    """rings of many lines that are parted in any order, two that touch at a point, and a line that goes on elsewhere."""
    import pyarrow as pa

    a = np.linspace(0, 2 * np.pi, 121)
    ring = np.rint(np.stack([np.cos(a), np.sin(a)], 1) * 1e4).astype(np.int64) * 2
    ring[-1] = ring[0]
    parts = [ring[k : k + 41] + (100_000 * j, 0) for j in range(6_000) for k in (0, 40, 80)]
    one, other = np.array([(0, 0), (9, 1), (1, 9), (0, 0)]), np.array([(0, 0), (-9, -1), (-1, -9), (0, 0)])
    lines = [("r", p) for p in parts] + [("t", p) for q in (one, other) for p in (q[:2], q[1:3], q[2:])] + [("o", one[:2]), ("o", one[1:3])]
    lines = [lines[k] for k in np.random.default_rng(1).permutation(len(lines))]
    t = pa.table({"f_type": [k for k, _ in lines], "cx": [0] * len(lines), "cy": [0] * len(lines), "closed": [False] * len(lines), "pts": overlay.lists(np.array([len(p) for _, p in lines]), np.concatenate([p for _, p in lines]))})
    began = time.perf_counter()
    found = overlay._joined(t)
    assert time.perf_counter() - began < 0.8
    kinds = sorted((k, shut_, len(p)) for k, shut_, p in zip(found["f_type"].to_pylist(), found["closed"].to_pylist(), found["pts"].to_pylist()))
    assert kinds == [("o", False, 3), *[("r", True, 121)] * 6_000, ("t", True, 4), ("t", True, 4)]


def test_rings_are_clipped_many_at_once():
    """corners on the box, a concave ring that comes apart, one outside, one inside, one without points."""
    from pavegraph.operators import lines

    rings = [shut([(0, 0), (10, 0), (10, 10), (0, 10)]), [], shut([(20, 0), (30, 0), (30, 9)]), shut([(-8, 2), (8, 2), (8, 4), (-4, 4), (-4, 6), (8, 6), (8, 8), (-8, 8)]), shut([(1, 1), (2, 1), (1, 2)])]
    length = np.array(list(map(len, rings)))
    points = np.concatenate([np.array(r).reshape(-1, 2) for r in rings])
    for axis, sign, edge in ((0, 1, 0.0), (0, -1, 6.0), (1, 1, 0.0), (1, -1, 10.0)):
        length, points = lines._cut_off(length, points, sign * (points[:, axis] - edge))
    found = np.split(points, np.cumsum(length)[:-1])
    assert [abs(polygons.area(f)) if len(f) else 0 for f in found] == pytest.approx([60, 0, 0, 24, 0.5])
    assert all((f[0] == f[-1]).all() for f in found if len(f))


def test_shapes_are_decoded_many_at_once():
    """as each by itself, those without geometry too."""
    from pavegraph.sources import shapefile

    rng = np.random.default_rng(3)
    rows = [[shut(rng.uniform(0, 9, (n, 2))) for n in ns] for ns in ((3,), (4, 3, 5), (), (6, 3))]
    bodies = [shapefile.encoded_shape([[{"x": x, "y": y} for x, y in ring] for ring in parts], "polygon")[0] for parts in rows]
    assert shapefile.decoded_shapes(bodies).to_pylist() == [shapefile.decoded_shape(raw) for raw in bodies]
    assert shapefile.decoded_shapes([]).to_pylist() == []
