"""Exchange of packed arrays between blocks of documents and buckets of hashes.

Both substring operators ask, for very many hashed places, which hashes stand in more than one place. A place per row
would drown in row overhead, so documents are dealt into blocks of bounded size, each block sends its distinct hashes
to buckets as packed arrays, and each bucket answers the blocks with the hashes that are shared. Whatever number of
documents of a block share a hash, it travels once, so no key is hotter than the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for

#: Bytes of text in a block, about, and distinct hashes that a bucket gets, at most about, of an input of up to
#: GROW_BYTES. Both grow with the root of a larger input, so that bodies exchanged do not get ever smaller, up to
#: GROW_MOST times.
BLOCK_BYTES = 5 << 20
BUCKET_HASHES = 400_000
GROW_BYTES = 1 << 30
GROW_MOST = 8

PACKED = "bucket int, block int, body binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("body", pa.binary())])


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None) -> tuple[DataFrame, int, float]:
    """(block, uid, id, text) dealt by block, the bytes of all texts, and how much blocks and buckets grow.

    Every later step on blocks shares this shuffle. Blocks are counted by bytes of text, so long texts make more of them.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    grow = min(GROW_MOST, max(1.0, (n_bytes / GROW_BYTES) ** 0.5))
    n = blocks_for(n_bytes, int((block_bytes or BLOCK_BYTES) * grow))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid", "id"), F.lit(n)).cast("int"))
    return rows.select("block", "uid", "id", "text").repartition("block"), n_bytes, grow


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKED_ARROW.types)], schema=PACKED_ARROW)


def shared_hashes(sent: DataFrame, hot_blocks: int | None = None, hot_contents: int | None = None) -> DataFrame:
    """(bucket, block, body): for each block, the hashes it sent that it sent twice or that another block sent too.

    Hashes that more than ``hot_blocks`` blocks sent, or that were sent with more than ``hot_contents`` contents, added up
    over the blocks, come in rows of their own, whose bucket is negative. What a body sent is, ``send`` says.
    """

    def decide(table: pa.Table) -> pa.Table:
        blocks, bodies = table.column("block").to_numpy(), [np.frombuffer(b, np.uint64) for b in table.column("body").to_pylist()]
        heads = [(int(b[0]), int(b[1])) for b in bodies]
        several = [b[2 : 2 + n] for b, (n, _) in zip(bodies, heads)]
        once = [b[2 + n + w :] for b, (n, w) in zip(bodies, heads)]
        everything = np.sort(np.concatenate([*several, *several, *once]))
        twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
        hot = np.empty(0, np.uint64)
        if hot_blocks is not None and len(bodies) > hot_blocks:
            values, counts = np.unique(np.concatenate([*several, *once]), return_counts=True)
            hot = values[counts > hot_blocks]
        if hot_contents is not None:
            weights = [b[2 + n : 2 + n + w] for b, (n, w) in zip(bodies, heads)]
            n_once = sum(map(len, once))
            if int(np.concatenate(weights).sum()) + n_once > hot_contents:
                values, which = np.unique(np.concatenate([*several, *once]), return_inverse=True)
                counts = np.bincount(which, np.concatenate([*weights, np.ones(n_once, np.uint64)]).astype(float), len(values))
                hot = np.union1d(hot, values[counts > hot_contents])
        bucket = table.column("bucket")[0].as_py()
        rows = []
        for block, a, b in zip(blocks.tolist(), several, once):
            hit = np.r_[a, b[isin_sorted(b, twice)]]
            warm = hit[~isin_sorted(hit, hot)]
            if len(warm):
                rows.append((bucket, block, warm.tobytes()))
            if len(warm) < len(hit):
                rows.append((-1 - bucket, block, hit[isin_sorted(hit, hot)].tobytes()))
        return packed(rows)

    return sent.groupBy("bucket").applyInArrow(decide, PACKED)


def send(block: int, hashes: np.ndarray, n_buckets: int, route: np.ndarray | None = None, content: np.ndarray | None = None) -> pa.Table:
    """The packed rows by which a block asks for its hashes, each distinct one once.

    Equal hashes meet in a bucket only if their ``route``, a second hash, leads them there too. A body is 64-bit numbers:
    how many hashes the block has in several places, how many counts follow them, those hashes, for each of them the
    number of distinct ``content`` (only if that is given), and the hashes in one place.
    """
    bucket = buckets_of(hashes if route is None else route, n_buckets)
    order = np.lexsort((hashes, bucket) if content is None else (content, hashes, bucket))
    values, bucket = hashes[order], bucket[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (bucket[1:] != bucket[:-1])][: len(values)]
    at = np.flatnonzero(new)
    several = np.diff(np.r_[at, len(values)]) > 1
    weights = np.empty(0, np.uint64)
    if content is not None and len(at):
        told = content[order]
        weights = np.add.reduceat((new | np.r_[True, told[1:] != told[:-1]]).astype(np.uint64), at)
    values, bucket = values[at], bucket[at]
    rows = []
    edges = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:]):
        v, s = values[a:b], several[a:b]
        w = weights[a:b][s] if len(weights) else weights
        rows.append((int(bucket[a]), block, np.r_[np.uint64(s.sum()), np.uint64(len(w)), v[s], w, v[~s]].tobytes()))
    return packed(rows)


def received(table: pa.Table, hot: bool = False) -> np.ndarray:
    """All (hot or other) hashes that the buckets answered to one block, sorted."""
    bodies = [b for k, b in zip(table.column("bucket").to_pylist(), table.column("body").to_pylist()) if (k < 0) is hot]
    return np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in bodies])) if bodies else np.empty(0, np.uint64)


def received_by_bucket(table: pa.Table) -> dict[int, np.ndarray]:
    return {k: np.sort(np.frombuffer(b, np.uint64)) for k, b in zip(table.column("bucket").to_pylist(), table.column("body").to_pylist())}


def isin_routed(hashes: np.ndarray, route: np.ndarray, n_buckets: int, answers: dict[int, np.ndarray]) -> np.ndarray:
    """Whether the bucket that each hash was sent to has answered with it."""
    bucket = buckets_of(route, n_buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.r_[np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
    out = np.zeros(len(hashes), bool)
    for a, b in zip(edges[:-1], edges[1:]):
        mine = order[a:b]
        if (answered := answers.get(int(bucket[mine[0]]))) is not None:
            out[mine] = isin_sorted(hashes[mine], answered)
    return out


def isin_sorted(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def per_block(rows: DataFrame, answers: DataFrame | None, f: Callable, schema: str) -> DataFrame:
    """``f(block, table of documents, answered hashes)`` for each block, with the answers to it if there are any to come."""
    if answers is None:
        return rows.groupBy("block").applyInArrow(lambda key, t: f(key[0].as_py(), t, None), schema)

    def run(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        return f(key[0].as_py(), docs, got)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
