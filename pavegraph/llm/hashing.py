"""Vectorised hashes over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
np.seterr(over="ignore")  # arithmetic modulo 2^64 is meant
_random = np.random.default_rng(20_240_601)
#: A random number for each byte, and the odd base of the polynomial.
BYTE = _random.integers(0, 2**64, 256, np.uint64)
BASE = U(0x9E3779B97F4A7C15)
#: Another odd base, for hashes independent of the first.
OTHER = U(0xD6E8FEB86659FD93)
#: Bytes of texts that are hashed together.
STEP = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column without nulls, not copied."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def groups(offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``step`` bytes together; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        yield first, min(last, n)
        first = last


def powers(n: int) -> np.ndarray:
    return np.concatenate([[U(1)], np.full(max(0, n - 1), BASE).cumprod(dtype=np.uint64)])[:n] if n else np.empty(0, np.uint64)


class Words:
    """The words (runs without ASCII white space) of several texts: byte spans, hashes and the first word of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> None:
        data = LOWER[data] if lower else data
        inside = ~SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][(offsets[:-1] < len(data))]
        begins[edges] |= inside[edges]
        self.starts = np.flatnonzero(begins)
        which = np.cumsum(begins) - 1
        where = np.flatnonzero(inside)
        word = which[where]
        place = where - self.starts[word]
        value = BYTE[data[where]] * powers(int(place.max()) + 1 if len(place) else 0)[place]
        first = np.searchsorted(word, np.arange(len(self.starts)))
        self.ends = self.starts + np.diff(np.r_[first, len(word)])
        self.hashes = mix(np.add.reduceat(value, first)) if len(first) else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the count at the end


def rolled(values: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each run of ``k`` numbers, by its first place; by doubling, so any k takes few passes."""
    out, length, power = None, 0, None
    block, size = values, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, length, power = block, size, base
            else:
                n = len(values) - length - size + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = out[:n] * base + block[length : length + n]
                length += size
        rest >>= 1
        if rest:
            n = len(block) - size
            if n <= 0:
                return np.empty(0, np.uint64)
            block = block[:n] * base + block[size : size + n]
            size, base = size * 2, base * base
    return mix(out)
