"""Exact overlay against sampling, closed formulas and odd shapes."""

from __future__ import annotations

import numpy as np
import pytest

from pavegraph.operators import overlay

RNG = np.random.default_rng(5)


def star(k: int) -> np.ndarray:
    """A ring of up to eight corners, concave as a rule."""
    a = np.sort(RNG.uniform(0, 2 * np.pi, k))
    return RNG.uniform(8, 72, 2) + np.stack([np.cos(a), np.sin(a)], 1) * RNG.uniform(1, 9, k)[:, None]


def windings(ring: np.ndarray, at: np.ndarray) -> np.ndarray:
    w = np.zeros(len(at), int)
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        side = (b[0] - a[0]) * (at[:, 1] - a[1]) - (b[1] - a[1]) * (at[:, 0] - a[0])
        w += ((a[1] <= at[:, 1]) & (b[1] > at[:, 1]) & (side > 0)).astype(int) - ((b[1] <= at[:, 1]) & (a[1] > at[:, 1]) & (side < 0)).astype(int)
    return w


def frame(spark, rings, by="f_type"):
    rows = [(k, [[(float(x), float(y)) for x, y in [*r, r[0]]] for r in (ring if isinstance(ring, list) else [ring])]) for k, ring in rings]
    kind = "string" if any(isinstance(k, str) for k, _ in rings) else "long"
    return spark.createDataFrame(rows, f"{by} {kind}, rings array<array<struct<x:double,y:double>>>")


def area(df) -> float:
    return sum(r.area for r in df.collect())


@pytest.mark.parametrize("cell", [17.0, 200.0])
def test_rules_against_sampling(spark, cell):
    a, b = [star(RNG.integers(3, 9)) for _ in range(40)], [star(RNG.integers(3, 9)) for _ in range(30)]
    step = 0.04
    at = np.stack(np.meshgrid(np.arange(-2, 82, step) + 0.0123, np.arange(-2, 82, step) + 0.0171), -1).reshape(-1, 2)
    turned = lambda rings: [r if (np.roll(r[:, 0], -1) * r[:, 1] - r[:, 0] * np.roll(r[:, 1], -1)).sum() < 0 else r[::-1] for r in rings]
    w, v = (sum(windings(r, at) for r in turned(rings)) for rings in (a, b))
    left, right = (overlay.directed(frame(spark, [("x", r) for r in rings]), "f_type") for rings in (a, b))
    for how, want in {"union": (w > 0) | (v > 0), "intersection": (w > 0) & (v > 0), "difference": (w > 0) & (v <= 0), "symmetric": (w > 0) != (v > 0)}.items():
        rows = overlay.overlay(left, right, how, cell=cell).collect()
        assert abs(sum(r.area for r in rows) - want.sum() * step * step) < 1.0
        for r in rows:  # simple rings, closed, inside on the left
            pts = [tuple(p) for p in r.ring]
            assert pts[0] == pts[-1] and len(set(pts)) == len(pts) - 1


def test_rings_that_touch_at_a_point_come_apart(spark):
    square = lambda x, y, s=1.0: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    ring_of_eight = [square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1) and (x, y) != (2, 2)]
    rows = overlay.dissolved(frame(spark, [("x", r) for r in [*ring_of_eight, square(5, 5), square(6, 6), square(64, 0), square(63, 0)]])).collect()
    shells, holes = sorted(r.area for r in rows if r.area > 0), [r.area for r in rows if r.area < 0]
    assert shells == pytest.approx([1, 1, 2, 8]) and holes == pytest.approx([-1])
    assert sorted(len(r.ring) for r in rows if r.area > 0) == [5, 5, 5, 7]  # points on a side are gone
    polygons = overlay.nested(overlay.dissolved(frame(spark, [("x", r) for r in ring_of_eight]))).collect()
    assert [len(p.rings) for p in polygons] == [2] and polygons[0].area == pytest.approx(7)


def test_holes_clockwise_rings_copies_and_empty_layers(spark):
    outer, inner = np.array([(0, 0), (40, 0), (40, 40), (0, 40)]), np.array([(10, 10), (30, 10), (30, 30), (10, 30)])
    df = frame(spark, [("a", [outer, inner]), ("a", [outer[::-1], inner[::-1]]), ("b", outer), (None, inner)])
    total = {r.f_type: r.a for r in overlay.dissolved(df, cell=16.0).groupBy("f_type").agg({"area": "sum"}).withColumnRenamed("sum(area)", "a").collect()}
    assert total == {"a": pytest.approx(1200), "b": pytest.approx(1600), None: pytest.approx(400)}
    assert overlay.dissolved(df.filter("f_type = 'z'")).count() == 0
    flat = frame(spark, [("a", np.array([(0, 0), (5, 0), (9, 0)])), ("a", np.array([(1, 1), (1, 1), (1, 1)]))])
    assert overlay.dissolved(flat).count() == 0


def test_mending(spark):
    tie, star5 = np.array([(0, 0), (9, 6), (9, 0), (0, 6)]), np.array([(np.cos(a), np.sin(a)) for a in np.arange(5) * 4 * np.pi / 5]) * 10
    spike = np.array([(0, 0), (4, 0), (4, 4), (8, 4), (4, 4), (0, 4)])
    rows = overlay.mended(frame(spark, [(1, tie), (2, star5), (3, spike)], "geom_id"), "geom_id").collect()
    of = lambda k: sorted(r.area for r in rows if r.geom_id == k)
    assert of(1) == pytest.approx([13.5, 13.5]) and len(of(2)) == 5 and of(3) == pytest.approx([16])


def test_mending_a_ring_of_ten_thousand_points(spark):
    import time

    a = np.linspace(0, 2 * np.pi, 10_001)[:-1]
    ring = np.stack([np.cos(a), np.sin(a)], 1) * (100 + 10 * np.sin(a * 700))[:, None]
    ring[[40, 41]] = ring[[41, 40]]
    began = time.perf_counter()
    rows = overlay.mended(frame(spark, [(1, ring)], "geom_id"), "geom_id").collect()
    assert time.perf_counter() - began < 60
    assert sum(r.area for r in rows) == pytest.approx(np.pi * 100 * 100, rel=0.01)


def test_buffers_of_concave_rings_and_lines(spark):
    horseshoe = np.array([(0, 0), (10, 0), (10, 8), (7, 8), (7, 3), (3, 3), (3, 8), (0, 8)])
    rings = overlay.directed(frame(spark, [("x", horseshoe)]), "f_type")
    assert area(overlay.grown(rings, 1.0)) == pytest.approx(12 * 10 - 2 * 5, abs=1e-4)
    assert area(overlay.grown(rings, 2.0)) == pytest.approx(14 * 12, abs=1e-4)  # the gap closes
    assert area(overlay.shrunk(rings, 1.0)) == pytest.approx(8 * 1 + 2 * 1 * 5, abs=1e-4)
    assert area(overlay.shrunk(rings, 2.0)) == 0
    line = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 6.0)]
    df = spark.createDataFrame([(1, line), (2, [(1.0, 1.0), (1.0, 1.0)]), (3, None)], "line_id long, pts array<struct<x:double,y:double>>")
    found = overlay.line_buffers(df, 1.0).collect()
    assert {r.line_id for r in found} == {1} and sum(r.area for r in found) == pytest.approx(12 * 2 + 2 * 6, abs=1e-4)
    sharp = np.array([(0, 0), (100, 0), (0, 1)])  # its mitre would be 200 long
    assert max(p.x for r in overlay.grown(overlay.directed(frame(spark, [("x", sharp)]), "f_type"), 1.0).collect() for p in r.ring) < 102


def test_corners_just_under_a_line_between_cells_stay():
    """Their lines pass from cell to cell twice, half a grain beside each other."""
    from pavegraph.operators.overlay import _uncut

    way = [(2, 1), (27_000_000, 11_000_000), (0, 22_000_000), (0, 1)]
    assert sorted(_uncut(way)) == [(0, 0), (0, 22_000_000), (27_000_000, 11_000_000)]
