"""Queries over whole tables against brute force."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

from pavegraph.plans.catalogue import QUERIES
from pavegraph.plans.fixtures import Views

DATA = "/root/testdata/sf0.001"


def test_components_of_all_tiles(spark):
    px = {(r.tile, r.r, r.c): r.v for r in Views(spark, DATA).mask_px().collect()}
    want, left = Counter(), set(px)
    while left:
        todo, part = [left.pop()], []
        while todo:
            t, r, c = todo.pop()
            part.append((t, r, c))
            for n in ((t, r + 1, c), (t, r - 1, c), (t, r, c + 1), (t, r, c - 1)):
                if n in left and px[n] == px[t, r, c]:
                    left.remove(n)
                    todo.append(n)
        rows, columns = [p[1] for p in part], [p[2] for p in part]
        want[part[0][0], px[part[0]], len(part), min(rows), max(rows), min(columns), max(columns)] += 1
    got = QUERIES["mask_components_whole"](spark, DATA).collect()
    assert max(r.tile for r in got) > 100
    assert Counter((r.tile, r.v, r.area, r.top, r.bottom, r["left"], r["right"]) for r in got) == want


def test_crossings_of_all_lines(spark):
    import random

    from pavegraph.plans import networks

    rng = random.Random(3)
    lines = [(i, [(float(rng.randrange(200)), float(rng.randrange(200))) for _ in range(rng.randint(1, 4))]) for i in range(40)]
    view = SimpleNamespace(street=lambda: spark.createDataFrame(lines, "line_id long, pts array<struct<x: double, y: double>>"))

    def cross(p, q, r, s):
        det = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
        if not det:
            return False
        t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / det
        u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / det
        return 0 <= t <= 1 and 0 <= u <= 1

    met = {(i, j) for i, a in lines for j, b in lines if i != j and any(cross(*x, *y) for x in zip(a, a[1:]) for y in zip(b, b[1:]))}
    assert {r.line_id: r.n_lines for r in networks.line_crossings_whole(view).collect()} == Counter(i for i, _ in met)


def test_segmented_area_of_all_parts(spark):
    keys = [r.p_partkey for r in Views(spark, DATA).table("part").select("p_partkey").collect()]
    want = Counter(0 if (i + k) % 5 == 0 else 1 if k % 2 == 0 else 3 for k in keys for i in range(16))
    assert max(keys) > 63
    assert {r.v: r.pixels for r in QUERIES["segmented_area_whole"](spark, DATA).collect()} == want
