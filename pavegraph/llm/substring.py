"""Removal of repeated word windows by difference-cover anchors.

A difference cover D of period V holds two members at every distance modulo V. Runs of K words are hashed only where
their place in the document is in D modulo V; of two equal windows of K + V - 1 words, wherever they stand, some shift
puts both starts on places of D, so they share an aligned anchor. Only windows around shared anchors are then extended
to full length and compared: by a 64-bit hash, in a bucket that a second, independent hash of the window names. There
are buckets in proportion to the text, so that the bits of both together grow with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BUCKET_HASHES, PACKED, blocked, isin_routed, isin_sorted, packed, per_block, received, received_by_bucket, send, shared_hashes
from .common import blocks_for
from .hashing import OTHER, Words, groups, rolled, utf8

WINDOW = 35
#: A perfect difference set: all differences of its members modulo 21 are different. Fixed values.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
#: Bytes of text for each anchor, at least about: a word and its space are six, and five of 21 words begin one.
ANCHOR_BYTES = 20


class Placed:
    """Words of several texts with each word's place in its text and the words of its text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray) -> None:
        self.words = Words(offsets, data)
        n = np.diff(self.words.first)
        self.size = np.repeat(n, n)
        self.place = np.arange(len(self.size)) - np.repeat(self.words.first[:-1], n)

    def hashes(self, k: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of runs of ``k`` that lie in texts of ``room`` words or more, and the hashes of all starts."""
        h = rolled(self.words.hashes, k)
        ok = (self.size[: len(h)] >= room) & (self.place[: len(h)] + k <= self.size[: len(h)])
        return np.flatnonzero(ok), h

    def routes(self, k: int) -> np.ndarray:
        """A second hash of all runs of ``k`` words."""
        return rolled(self.words.hashes, k, OTHER)


def _chunks(table: pa.Table):
    column = table.column("text").combine_chunks()
    offsets, data = utf8(column if isinstance(column, pa.Array) else column.chunk(0))
    for first, last in groups(offsets):
        own = offsets[first : last + 1] - offsets[first]
        yield first, last, own, data[offsets[first] : offsets[last]]


def _anchors(p: Placed, window: int) -> tuple[np.ndarray, np.ndarray]:
    starts, h = p.hashes(window - PERIOD + 1, window)
    starts = starts[np.isin(p.place[starts] % PERIOD, COVER)]
    return starts, h[starts]


def repeated_windows(rows: DataFrame, n_buckets: int, window: int = WINDOW) -> DataFrame:
    """For each block, the hashes of its windows that stand in more than one place."""

    def ask(block: int, docs: pa.Table, _) -> pa.Table:
        found = [_anchors(Placed(own, data), window)[1] for *_, own, data in _chunks(docs)]
        return send(block, np.concatenate(found), n_buckets) if found else packed([])

    def extend(block: int, docs: pa.Table, got: pa.Table) -> pa.Table:
        shared, found, routes = received(got), [], []
        for *_, own, data in _chunks(docs) if len(shared) else ():
            p = Placed(own, data)
            starts, h = _anchors(p, window)
            starts = starts[isin_sorted(h, shared)]
            full, h = p.hashes(window, window)
            edge = np.zeros(len(p.place) + 1, np.int64)
            np.add.at(edge, starts - np.minimum(PERIOD - 1, p.place[starts]), 1)
            np.add.at(edge, starts + 1, -1)
            full = full[edge.cumsum()[full] > 0]
            if len(full):
                found.append(h[full])
                routes.append(p.routes(window)[full])
        return send(block, np.concatenate(found), n_buckets, np.concatenate(routes)) if found else packed([])

    anchors = shared_hashes(per_block(rows, None, ask, PACKED))
    return shared_hashes(per_block(rows, anchors, extend, PACKED))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, block_bytes: int | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, with ``keep_text``, the words kept as text.

    Words are runs without ASCII white space, unchanged. A word goes if a window of ``window`` words over it stands
    anywhere else too, in this or another document or row; all windows are judged on the input. Null and empty texts
    have no words, and the digest of the empty string. Repeated rows repeat each other. Other columns are ignored; an
    empty table gives no rows. ``window`` must exceed the cover's period of 21.
    """
    if window <= PERIOD:
        raise ValueError("the window must be longer than the cover's period")
    rows, n_bytes, grow = blocked(docs, id_col, text_col, block_bytes)
    n_buckets = blocks_for(n_bytes // ANCHOR_BYTES, int(BUCKET_HASHES * grow))
    repeated = repeated_windows(rows, n_buckets, window)
    names = [id_col, "n_words", "n_removed", "kept_sha256", *["text"] * keep_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]

    def finish(_: int, docs_: pa.Table, got: pa.Table) -> pa.Table:
        answers, out = received_by_bucket(got), []
        shared = np.unique(np.concatenate([*answers.values()])) if answers else np.empty(0, np.uint64)
        ids = docs_.column("id").to_pylist()
        for first, last, own, data in _chunks(docs_):
            p = Placed(own, data)
            full, h = p.hashes(window, window)
            hit = full[isin_sorted(h[full], shared)]
            if len(hit):
                hit = hit[isin_routed(h[hit], p.routes(window)[hit], n_buckets, answers)]
            edge = np.zeros(len(p.place) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = edge.cumsum()[:-1] > 0
            raw = data.tobytes()
            for k in range(last - first):
                a, b = p.words.first[k], p.words.first[k + 1]
                words, mine = raw[own[k] : own[k + 1]].split(), gone[a:b]
                removed = int(mine.sum())
                kept = b" ".join(words if not removed else [w for w, g in zip(words, mine.tolist()) if not g])
                out.append((ids[first + k], len(words), removed, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * keep_text))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)], names=names)

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return per_block(rows, repeated, finish, schema)
