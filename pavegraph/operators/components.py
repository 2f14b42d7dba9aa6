"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.storage import discard, table
from .arrangement import least_labels


#: Links, there and back, of whole numbers that one task solves: some 50 MB.
SMALL_LINKS = 1_000_000


def _solved(links: DataFrame) -> DataFrame:
    """``components`` of a bounded number of links between whole numbers, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if held:
            nodes, at = np.unique(np.concatenate(held, 1), return_inverse=True)
            at = at.reshape(2, -1)
            roots = nodes[least_labels(len(nodes), at[0], at[1])]
            for start in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[start : start + 100_000]), pa.array(roots[start : start + 100_000])], names=["node", "root"])

    return table(links.coalesce(1).mapInArrow(run, "node long, root long"))


def components(links: DataFrame, small: int = 0) -> DataFrame:
    """(node, root) of every node with a link (a, b); root is the smallest node of its component.

    Up to ``small`` links of whole numbers, which are counted, are solved by one task; all others in rounds.

    Each round takes the smallest label among a node and its neighbours, then follows labels to their own labels, so
    the rounds grow with the logarithm of a component's diameter. Minima are taken before the shuffle, and every round
    reads the tables that the one before wrote, so lost executors cost one round at most. Joins read shuffled tables as
    they are, so Spark may split a node with very many links, or a root with very many nodes, over several tasks.
    """
    both = table(links.select("a", "b").union(links.select("b", "a")).distinct())
    if small and both.schema["a"].dataType == LongType() and both.count() <= small:
        found = _solved(both)
        discard(both)
        return found
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = table(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        hopped = table(new.join(up, "root").select("node", F.least("root", "up").alias("root"), "was"))
        moved = hopped.filter("root != was").limit(1).count()
        discard(labels, new)
        labels = hopped.select("node", "root")
        labels._stored_at = hopped._stored_at
        if not moved:
            discard(both)
            return labels


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b) between nodes; only the links are gone through again."""
    root_of = lambda side: (F.col(side) == F.col("node"), F.coalesce("root", side).alias(side))
    on, a = root_of("a")
    left = links.join(roots, on, "left").select(a, "b")
    on, b = root_of("b")
    up = components(left.join(roots, on, "left").select("a", b).filter("a != b"))
    tops = up.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    moved = roots.join(tops, roots["root"] == tops["_old"], "left").select("node", F.coalesce("_new", "root").alias("root"))
    fresh = up.join(roots, "node", "left_anti").select("node", "root")
    out = table(moved.union(fresh))
    discard(up)
    return out
