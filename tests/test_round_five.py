"""What the review of the fourth round brought up."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavegraph.operators import lines as operators
from pavegraph.operators import overlay, topology


@pytest.mark.parametrize("upright", [False, True])
def test_bow_ties_that_cross_on_a_line_between_cells_come_apart(spark, upright):
    """Their middle lies on the line, or half a unit off it; all places along it, and many slopes."""
    rows = [(256.0 * 53 - dx, 256.0 * 2 - h / 2, float(w), float(h)) for w, h in ((2, 2), (2, 10), (5, 6), (7, 4), (8, 10), (10, 10), (14, 8), (18, 10)) for dx in range(w + 1)]
    corners = [(0, 0), (1, 1), (0, 1), (1, 0), (0, 0)] if upright else [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]
    ties = [(k, [[(x + a * w, y + b * h) for a, b in corners]]) for k, (x, y, w, h) in enumerate(rows)]
    found = overlay.mended(spark.createDataFrame(ties, "id long, rings array<array<struct<x:double,y:double>>>"), "id", cell=256.0)
    got = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("area").alias("least"), F.round(F.sum("area"), 3).alias("area")).collect()
    assert sorted((r.id, r.n, r.least > 0, r.area) for r in got) == [(k, 2, True, w * h / 2) for k, (_, _, w, h) in enumerate(rows)]


def every_pair(rays, lines, size):
    """What ``_met_by_rays`` may leave out nothing of that counts: each ray with each segment of other lines."""
    a = topology.segments(rays).selectExpr("line_id as left_id", "ax as x1", "ay as y1", "bx as x2", "by as y2")
    b = topology.segments(lines).selectExpr("line_id as right_id", "ax as x3", "ay as y3", "bx as x4", "by as y4")
    return a.join(b, F.col("left_id.own") != F.col("right_id")).localCheckpoint()


def crowds():
    """(name, lines): on a lattice, off it, far from the origin, with touches at and beside the ends, and named by texts."""
    rng = np.random.default_rng(4)
    lattice = rng.integers(0, 40, (700, 3, 2)).astype(float)
    yield "lattice", [(k, pts.tolist()) for k, pts in enumerate(lattice)]
    yield "anywhere", [(k, pts.tolist()) for k, pts in enumerate(rng.uniform(0, 50, (500, 2, 2)))]
    yield "far", [(k, (pts + (7e6, -3e6)).tolist()) for k, pts in enumerate(rng.uniform(0, 60, (300, 2, 2)))]
    ends = rng.uniform(0, 40, (150, 2, 2))
    beside = np.stack([ends[:, 1] + rng.uniform(-1, 1, (150, 2)) * 3e-6, ends[:, 1] + rng.uniform(-9, 9, (150, 2))], 1)
    across = np.stack([ends[:, 1] - (1.5, 2.5), ends[:, 1] + (1.5, 2.5)], 1)
    yield "touches", [(f"l{k}", pts.tolist()) for k, pts in enumerate(np.concatenate([ends, beside, across]))]
    yield "sparse", [(k, pts.tolist()) for k, pts in enumerate(rng.uniform(0, 300, (400, 1, 2)) + rng.uniform(-9, 9, (400, 2, 2)))]


@pytest.mark.parametrize("name, rows", list(crowds()))
def test_rays_meet_only_what_may_come_first(spark, monkeypatch, name, rows):
    """where lines are crowded a ray meets hundreds of them, all of which were handed on."""
    lines = spark.createDataFrame([(k, [tuple(p) for p in pts]) for k, pts in rows], f"line_id {'string' if name == 'touches' else 'long'}, pts array<struct<x:double,y:double>>").cache()
    handed, plain = [], topology._met_by_rays

    def met(rays, lines, size):
        found = plain(rays, lines, size).cache()
        handed.append((found.count(), rays.count()))
        return found

    monkeypatch.setattr(topology, "_met_by_rays", met)
    got = sorted(map(tuple, topology.extension_hits(lines, 6.0, 4.0).collect()))
    monkeypatch.setattr(topology, "_met_by_rays", every_pair)
    assert got == sorted(map(tuple, topology.extension_hits(lines, 6.0, 4.0).collect()))
    assert len(got) > 10 and handed[0][0] < 6 * handed[0][1]


def test_lines_in_a_crowd_are_extended_by_few_rows(spark, monkeypatch):
    """each line is drawn out to what it meets first, without all that it meets beyond being handed on."""
    pts = np.random.default_rng(8).integers(0, 30, (400, 2, 2)).astype(float)
    lines = spark.createDataFrame([(k, [tuple(p) for p in line]) for k, line in enumerate(pts.tolist())], "line_id long, pts array<struct<x:double,y:double>>").cache()
    handed, plain = [], topology._met_by_rays

    def met(rays, lines, size):
        found = plain(rays, lines, size).cache()
        handed.append((found.count(), rays.count()))
        return found

    monkeypatch.setattr(topology, "_met_by_rays", met)
    grown = sorted((r.line_id, [tuple(p) for p in r.pts]) for r in operators.extended_lines(lines, 6.0, 4.0).collect())
    monkeypatch.setattr(topology, "_met_by_rays", every_pair)
    assert grown == sorted((r.line_id, [tuple(p) for p in r.pts]) for r in operators.extended_lines(lines, 6.0, 4.0).collect())
    assert sum(len(p) > 2 for _, p in grown) > 50 and handed[0][0] < 6 * handed[0][1]


@pytest.mark.parametrize("name, reader", [("image_round_trip", "read_pngs"), ("file_round_trip", "read_written")])
def test_files_are_written_and_read_in_turns(spark, monkeypatch, name, reader):
    """a large table had a file for every row at once, each of which takes a block of the disk and an entry of its own."""
    from pathlib import Path

    from pavegraph.functions.storage import shared_dir
    from pavegraph.plans.catalogue import QUERIES
    from pavegraph.sources import files, images

    monkeypatch.setattr(files, "TURN_FILES", 200, raising=False)
    there, plain = [], getattr(images, reader)

    def read(session, folder):
        there.append(sum(f.is_file() and not f.name.startswith(".") for f in Path(folder.removeprefix("file:")).rglob("*")))
        return plain(session, folder)

    monkeypatch.setattr(images, reader, read)
    folder = "/root/testdata/sf0.001"
    sinks = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("sink-*")}
    before = sinks()
    got = {r.image for r in QUERIES[name](spark, folder).select("image").collect()}
    keys = [r.k for r in spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey as k").collect()]
    kept, end = (keys, "png") if name == "image_round_trip" else ([k for k in keys if k % 4 < 2], "npy")
    assert got == {f"{k % 64}_{k // 64}_{k}.{end}" for k in kept}
    assert sum(there) == len(kept) > 600 and max(there) < 300
    assert sinks() == before
