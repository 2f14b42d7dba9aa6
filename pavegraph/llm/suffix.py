"""Removal of byte strings that stand earlier in the corpus, by suffix arrays of shards.

Each window of LENGTH bytes chooses an anchor, the K bytes of lowest hash in it, so that equal windows choose equal
anchors. Windows that share an anchor place form a fragment; fragments whose anchor stands in one place only hold no
repeated window and go no further. The others are dealt to shards by anchor, where equal fragments fall together and
the rest is sorted: the shard's suffix array is induced, its permuted common prefixes part the suffixes into classes of
equal windows, and all but the earliest of each class are removed. Of equal fragments of a block only the earliest goes to
a shard, as the others are later than it: so a shard gets no more of a passage than there are blocks, however many copies.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BUCKET_HASHES, PACKED, blocked, buckets_of, isin_sorted, packed, per_block, received, send, shared_hashes
from .common import blocks_for
from .hashing import BASE, BYTE, groups, rolled, utf8
from .sais import common_prefixes, suffix_array

LENGTH = 100
ANCHOR = 32
#: Bytes of text for each anchor, about: half the places that a window can choose from.
ANCHOR_BYTES = 35
#: Fragments with a shared anchor in a shard, at most about, were all anchors shared.
SHARD_FRAGMENTS = 100_000
#: An anchor that more blocks than this share deals out its windows one by one, by their own hash.
HOT_BLOCKS = 1_000
#: So does one with more fragments than this, each different one of a block counted, as they would meet in one shard.
HOT_FRAGMENTS = 50_000
#: Longer texts are taken in pieces that overlap by a window.
PIECE = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
NO_ID = -(2**63)


def _pieces(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place in the row, offsets and bytes of texts or of pieces of long ones."""
    column = table.column("text").combine_chunks()
    offsets, data = utf8(column if isinstance(column, pa.Array) else column.chunk(0))
    for first, last in groups(offsets):
        own = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        if last - first > 1 or len(part) <= PIECE:
            yield np.arange(first, last), np.zeros(last - first, np.int64), own, part
            continue
        for at in range(0, max(1, len(part) - LENGTH + 1), PIECE):
            piece = part[at : at + PIECE + LENGTH - 1]
            yield np.array([first]), np.array([at]), np.array([0, len(piece)]), piece


class Fragments:
    """Runs of windows with one anchor: first and last window start, anchor hash, and the text they are in."""

    def __init__(self, own: np.ndarray, data: np.ndarray) -> None:
        n = len(data)
        self.low = self.high = self.text = np.empty(0, np.int64)
        self.hash = self.content = np.empty(0, np.uint64)
        if n < LENGTH:
            return
        self.values = BYTE[data]
        h = rolled(self.values, ANCHOR)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        span, low = LENGTH - ANCHOR + 1, key
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[span - size : span - size + n - LENGTH + 1])
        ends = np.repeat(own[1:], np.diff(own))[: len(low)]
        starts = np.flatnonzero(ends - np.arange(len(low)) >= LENGTH)
        if not len(starts):
            return
        anchor = (low[starts] & PLACE).astype(np.int64)
        first = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]
        self.low, self.high = starts[first], starts[np.r_[first[1:], len(starts)] - 1]
        self.hash = h[anchor[first]]
        whole = rolled(self.values, LENGTH)  # a fragment is covered by its first and its last window
        self.content = whole[self.low] * BASE + whole[self.high] + (self.high - self.low).astype(np.uint64)
        self.text = np.searchsorted(own, self.low, "right") - 1


def _ask(n_buckets: int):
    def ask(block: int, docs: pa.Table, _) -> pa.Table:
        found = [(f.hash, f.content) for f in (Fragments(own, data) for *_, own, data in _pieces(docs))]
        if not found:
            return packed([])
        hashes, contents = (np.concatenate(c) for c in zip(*found))
        return send(block, hashes, n_buckets, content=contents)

    return ask


def _merged(uid: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Runs of bytes, those that touch or overlap in a text as one."""
    order = np.lexsort((low, uid))
    uid, low, high = uid[order], low[order], high[order]
    _, text = np.unique(uid, return_inverse=True)
    far = np.int64(high.max() + 1)
    reach = np.maximum.accumulate(high + text * far) - text * far
    new = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (low[1:] > reach[:-1])])
    return np.stack([uid[new], low[new], reach[np.r_[new[1:], len(uid)] - 1]]).astype(np.int64).tobytes()


def _cut_out(n_shards: int):
    """Sends each shared fragment's bytes once for the block, with its earliest place there.

    Its other places in the block are later than that, so their bytes go whatever the shard finds; the block has them
    sent back to itself by a bucket that is no shard.
    """

    def cut_out(block: int, docs: pa.Table, got: pa.Table) -> pa.Table:
        warm, hot = received(got), received(got, hot=True)
        ids, uids = docs.column("id").fill_null(NO_ID).to_numpy(), docs.column("uid").to_numpy()
        index: dict[tuple[int, bytes], int] = {}
        places: list[tuple[np.ndarray, ...]] = []
        for row, base, own, data in _pieces(docs) if len(warm) + len(hot) else ():
            f = Fragments(own, data)
            raw = data.tobytes()
            spots = [(f.low[k], f.high[k] + LENGTH, f.hash[k], f.text[k]) for k in np.flatnonzero(isin_sorted(f.hash, warm))]
            burning = np.flatnonzero(isin_sorted(f.hash, hot))
            if len(burning):
                whole = rolled(f.values, LENGTH)
                spots += [(s, s + LENGTH, whole[s], f.text[k]) for k in burning for s in range(f.low[k], f.high[k] + 1)]
            if spots:
                low, high, key, text = (np.array(c) for c in zip(*spots))
                which = [index.setdefault((h, raw[a:b]), len(index)) for h, a, b in zip(key.tolist(), low.tolist(), high.tolist())]
                places.append((np.array(which), ids[row[text]], uids[row[text]], base[text] + low - own[text]))
        if not index:
            return packed([])
        which, id_, uid, at = (np.concatenate(c) for c in zip(*places))
        hashes = np.array([h for h, _ in index], np.uint64)
        bodies = [b for _, b in index]
        sizes = np.array([len(b) for b in bodies], np.int64)
        order = np.lexsort((at, uid, id_, which))
        first = np.r_[True, which[order][1:] != which[order][:-1]]
        lead, rest = order[first], order[~first]
        shard = buckets_of(hashes, n_shards)
        rows = []
        if len(rest):
            rows.append((n_shards + block, block, _merged(uid[rest], at[rest], at[rest] + sizes[which[rest]])))
        by = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by], np.arange(n_shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            mine = by[edges[s] : edges[s + 1]]
            spot = lead[mine]
            rows.append((int(s), block, pickle.dumps((hashes[mine], sizes[mine], b"".join([bodies[k] for k in mine.tolist()]), id_[spot], uid[spot], at[spot]), 5)))
        return packed(rows)

    return cut_out


def later_windows(contents: list[bytes], rank: np.ndarray) -> list[tuple[int, int, int]]:
    """(content, from, to): bytes of windows that also stand in a content of lower ``rank``.

    No content holds a window twice, as both would choose their anchor at one distance, but all its windows share one.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\x00".join(contents) + b"\x00", np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    text = code[raw]
    text[starts + sizes] = 0
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    here = np.arange(len(text)) - starts[owner]
    order = suffix_array(text)
    prefix = common_prefixes(text, order, LENGTH)
    window = sizes[owner] - here >= LENGTH
    new = (prefix[order] < LENGTH) | ~window[order]
    first = np.flatnonzero(new)
    key = (rank[owner] << np.int64(34)) + here
    least = np.minimum.reduceat(key[order], first)
    later = np.zeros(len(text), bool)
    later[order] = key[order] > least[np.cumsum(new) - 1]
    later &= window
    edges = np.flatnonzero(np.diff(np.r_[False, later, False]))
    return [(int(owner[a]), int(here[a]), int(here[b - 1]) + LENGTH) for a, b in zip(edges[::2], edges[1::2])]


def _decide(table: pa.Table, n_shards: int) -> pa.Table:
    """For each block, (uid, from, to) of the bytes to remove; what blocks have found out themselves goes back as it is."""
    if table.column("bucket")[0].as_py() >= n_shards:
        return table
    blocks = table.column("block").to_numpy()
    index: dict[tuple[int, bytes], int] = {}
    spots: list[tuple[np.ndarray, ...]] = []
    for block, body in zip(blocks.tolist(), table.column("body").to_pylist()):
        hashes, sizes, raw, id_, uid, at = pickle.loads(body)
        ends = np.cumsum(sizes)
        own = [index.setdefault((h, raw[b - n : b]), len(index)) for h, b, n in zip(hashes.tolist(), ends.tolist(), sizes.tolist())]
        spots.append((np.array(own), id_, uid, at, np.full(len(at), block)))
    which, id_, uid, at, block = (np.concatenate(c) for c in zip(*spots))
    contents = [c for _, c in index]
    sizes = np.array([len(c) for c in contents], np.int64)
    order = np.lexsort((at, uid, id_, which))
    first = np.ones(len(order), bool)
    first[1:] = which[order][1:] != which[order][:-1]
    gone = [(block[k], uid[k], at[k], at[k] + sizes[which[k]]) for k in (order[~first],)]
    lead = order[first]  # by content
    shared = Counter(h for h, _ in index)
    several = np.array([k for k, (h, _) in enumerate(index) if shared[h] > 1], np.int64)
    if len(several):
        mine = lead[several]
        turn = np.lexsort((at[mine], uid[mine], id_[mine]))
        rank = np.empty(len(mine), np.int64)
        rank[turn] = np.arange(len(mine))
        found = later_windows([contents[k] for k in several.tolist()], rank)
        if found:
            c, a, b = (np.array(x) for x in zip(*found))
            k = mine[c]
            gone.append((block[k], uid[k], at[k] + a, at[k] + b))
    block, uid, low, high = (np.concatenate(c) for c in zip(*gone))
    by = np.argsort(block, kind="stable")
    edges = np.r_[np.flatnonzero(np.diff(block[by], prepend=-1)), len(by)]
    shard = table.column("bucket")[0].as_py()
    return packed([(shard, int(block[by[a]]), np.stack([uid[by[a:b]], low[by[a:b]], high[by[a:b]]]).astype(np.int64).tobytes()) for a, b in zip(edges[:-1], edges[1:])])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, block_bytes: int | None = None, hot_blocks: int = HOT_BLOCKS, hot_fragments: int = HOT_FRAGMENTS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the bytes kept as text.

    Every byte goes that is covered by a 100-byte string of the same text's UTF-8 that also starts earlier: in a row of
    smaller id, or earlier in the same text; overlaps count, and strings are judged on the input. Null counts as empty.
    Rows of equal id follow each other in reading order, a null id comes first. Removed runs that cut a character leave
    replacement marks in the kept text, not in its digest. Other columns are ignored; an empty table gives no rows.
    """
    rows, n_bytes, grow = blocked(docs, id_col, text_col, block_bytes)
    anchors = n_bytes // ANCHOR_BYTES
    asked = per_block(rows, None, _ask(blocks_for(anchors, int(BUCKET_HASHES * grow))), PACKED)
    n_shards = blocks_for(anchors, SHARD_FRAGMENTS)
    sent = per_block(rows, shared_hashes(asked, hot_blocks, hot_fragments), _cut_out(n_shards), PACKED)
    decided = sent.groupBy("bucket").applyInArrow(lambda t: _decide(t, n_shards), PACKED)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * keep_text]
    types = [pa.int64()] * 4 + [pa.string()] * (1 + keep_text)

    def finish(_: int, table: pa.Table, got: pa.Table) -> pa.Table:
        column = table.column("text").combine_chunks()
        offsets, data = utf8(column if isinstance(column, pa.Array) else column.chunk(0))
        edge = np.zeros(len(data) + 1, np.int32)
        bodies = [np.frombuffer(b, np.int64).reshape(3, -1) for b in got.column("body").to_pylist()]
        if bodies:
            uid, low, high = np.concatenate(bodies, axis=1)
            uids = table.column("uid").to_numpy()
            order = np.argsort(uids)
            row = order[np.searchsorted(uids[order], uid)]
            np.add.at(edge, offsets[row] + low, 1)
            np.add.at(edge, offsets[row] + high, -1)
        gone = edge.cumsum()[:-1] > 0
        out = []
        for k, doc in enumerate(table.column("id").to_pylist()):
            a, b = offsets[k], offsets[k + 1]
            mine = gone[a:b]
            removed = int(mine.sum())
            kept = data[a:b][~mine].tobytes() if removed else data[a:b].tobytes()
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0
            out.append((doc, int(b - a), removed, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * keep_text))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)], names=names)

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    return per_block(rows, decided, finish, schema)
