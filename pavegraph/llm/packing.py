"""Best-fit packing of tokenised documents into fixed-length sequences, by patterns fitted with least squares.

Only a histogram of piece lengths, whose size is bounded by the sequence length, reaches the driver. There all patterns
of two and three lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative
least squares and rounded down to what is there; what the fit leaves is packed best fit first, again as patterns with
counts. Executors then number the pieces of each length and look up sequence and offset from the number.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, small_batches, table

#: Pieces of one length are numbered in groups of about this many rows.
GROUP_ROWS = 20_000
#: From this character on the fast encoder leaves a text to the library, as their Unicode tables may differ.
FIRST_RARE = "ɐ"
#: The pre-tokenizer's pattern with possessive runs. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteEncoder:
    """Token ids of the byte-level BPE in a ``tokenizers`` file.

    Texts of Latin letters go through a faster encoder of the same vocabulary, all others through the library, which is
    only loaded then; both give the same ids.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.special = set(special)
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if text.isascii() or max(text) < FIRST_RARE:
            return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.special), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: whole ones, but for a first one that takes the remainder."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for k, doc in enumerate(ids):
                raw = encode(texts[k].as_py()).astype("<u4", copy=False).tobytes() + tail
                whole = memoryview(raw)
                rows += [(doc, i, s, n, zlib.crc32(whole[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(pieces_of(len(raw) // 4, size))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return narrow.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fill_patterns(size: int) -> np.ndarray:
    """All patterns of two or three lengths that fill a sequence; rows of three, 0 for no third."""
    a = np.arange(1, size)
    two = np.stack([a, size - a, 0 * a], 1)[a >= size - a]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = size - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    return np.concatenate([two, np.stack([x[ok], y[ok], z[ok]], 1)])


def least_squares(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - h|^2, by accelerated projected gradient.

    Column j of A counts the lengths of pattern j. Only patterns whose lengths all occur are given.
    """
    size = len(histogram)
    flat = patterns.T
    total = lambda x: sum(np.bincount(c, x, size) for c in flat)
    back = lambda r: sum(r[c] for c in flat)
    h = histogram.astype(float)
    h[0] = 0
    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue of A'A gives the step
        r = total(v)
        r[0] = 0
        v = back(r)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        r = total(y) - h
        r[0] = 0
        new = np.maximum(0, y - back(r) / (1.05 * norm))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns with their repeat counts that use up a histogram of lengths (index = length, size = last index)."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    if left[size]:
        out.append(([size], int(left[size])))
        left[size] = 0
    patterns = fill_patterns(size)
    for _ in range(4):
        usable = patterns[((left[patterns] > 0) | (patterns == 0)).all(1)]
        if not len(usable):
            break
        fitted = least_squares(usable, left)
        placed = 0
        for j in np.argsort(-fitted, kind="stable"):
            if fitted[j] < 0.5:
                break
            parts = [int(p) for p in usable[j] if p]
            n = min(int(np.ceil(fitted[j] - 0.5)), *(int(left[p]) // parts.count(p) for p in set(parts)))
            if n > 0:
                out.append((parts, n))
                placed += n
                for p in parts:
                    left[p] -= n
        if placed * 50 < left.sum():
            break
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:  # best fit for what is left: the longest first, then always the longest that still fits
        parts, room, used = [], size, {}
        for x in reversed(lengths):
            k = min(room // x, int(left[x]))
            if k:
                parts += [x] * k
                used[x] = k
                room -= k * x
            if not room:
                break
        n = min(int(left[x]) // k for x, k in used.items())
        out.append((parts, n))
        for x, k in used.items():
            left[x] -= n * k
            if not left[x]:
                lengths.remove(x)
    return out


def lookup(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """By length, then number within the length: first sequence, places in a sequence and offset of the first place."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, n in patterns:
        at = 0
        for length in dict.fromkeys(parts):
            k = parts.count(length)
            low = used.get(length, 0)
            rows.append((length, low, k, sequence, at))
            used[length] = low + n * k
            at += k * length
        sequence += n
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table_[:, 0] << 48) + table_[:, 1], "low": table_[:, 1], "places": table_[:, 2], "sequence": table_[:, 3], "offset": table_[:, 4]}


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and ``end_id``. Documents over ``size`` tokens are cut into pieces of ``size``, the first
    of which takes the remainder. Null and empty texts are one token long. Repeated rows are packed each for itself;
    other columns are ignored. An empty table gives no rows.
    """
    pieces = table(token_pieces(docs, tokenizer, size, end_id, id_col, text_col))
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    groups = blocks_for(int(histogram.sum()), GROUP_ROWS)
    where = lookup(plan(histogram))
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = (
        grouped.groupBy("length", "grp")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "grp", (F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n")).alias("before"))
    )
    numbered = (
        grouped.withColumn("k", F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece")))
        .join(before, ["length", "grp"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(where["key"], (length << 48) + number, "right") - 1
            turn = number - where["low"][row]
            sequence = where["sequence"][row] + turn // where["places"][row]
            offset = where["offset"][row] + turn % where["places"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
