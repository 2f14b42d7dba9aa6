"""Token counts for a piece vocabulary by rank-synchronous array merging.

Pre-tokens (a run of space marks with the characters up to the next mark) of a batch are held as arrays, one per
length. In each round every sequence of an array merges its pair of lowest rank, leftmost first, and so all of them get
one symbol shorter together; sequences with no pair left leave the array with their count. A long pre-token is an array
of its own, which merges all places of the lowest rank in one round, as long as the new symbol takes part in no pair of
lower rank than its own: what is left over of the rank would then be next in turn anyway. A pre-token seen before in the
same task is looked up.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Over this many symbols a pre-token is an array of its own.
LONG = 256
#: Pre-tokens that a task remembers; then it starts afresh.
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)


class PieceVocabulary:
    """Pieces with ranks; symbols are numbered by piece, characters outside the vocabulary from ``size`` on."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark inside; pre-tokens would not be independent")
        self.ids = {p: i for i, p in enumerate(pieces)}
        order = np.argsort(-np.array([model.get_score(i) for i in plain]), kind="stable")
        self.rank = np.empty(len(pieces), np.int32)
        self.rank[order] = np.arange(len(pieces), dtype=np.int32)
        self.size = len(pieces)
        self.span = self.size + 1
        keys, merged = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    merged.append(i)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.of_point = np.full(0x110000, self.size, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        #: Merged symbols that a pair of lower rank than their own begins or ends with.
        self.hasty = np.zeros(self.size + 1, bool)
        below = self.rank[self.merged]
        for side in (self.keys // self.span, self.keys % self.span):
            self.hasty[side[self.rank[side] > below]] = True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each merged pair; NONE where the pair is no piece."""
        key = a.astype(np.int64) * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        symbol = np.where(found, self.merged[at], 0)
        return np.where(found, self.rank[symbol], NONE), symbol

    def count_long(self, symbols: np.ndarray) -> int:
        """Symbols left of one long sequence."""
        symbols = symbols.copy()
        ranks, merged = self.pairs(symbols[:-1], symbols[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if self.hasty[merged[at[0]]]:
                at = at[:1]
            else:  # of pairs that overlap in a row, every other one from the left
                new = np.diff(at, prepend=-2) > 1
                row = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - row) % 2 == 0]
            symbols[at] = merged[at]
            symbols = np.delete(symbols, at + 1)
            ranks, merged = np.delete(ranks, at), np.delete(merged, at)
            made = at - np.arange(len(at))
            for side in (made - 1, made):
                side = side[(side >= 0) & (side < len(ranks))]
                ranks[side], merged[side] = self.pairs(symbols[side], symbols[side + 1])
        return len(symbols)

    def counts(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token; an unknown character counts as its bytes."""
        if not tokens:
            return []
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(lengths) - lengths
        symbols = self.of_point[points]
        more = np.where(symbols == self.size, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        out = np.add.reduceat(more, starts)
        for k in np.flatnonzero(lengths > LONG):
            out[k] += self.count_long(symbols[starts[k] : starts[k] + lengths[k]])
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:]):
            where = order[first:last]
            if (length := lengths[where[0]]) <= LONG:
                out[where] += self._merge(symbols[starts[where][:, None] + np.arange(length)])
        return out.tolist()

    def _merge(self, rows: np.ndarray) -> np.ndarray:
        """Symbols left in each row of equally long sequences."""
        left = np.full(len(rows), 1, np.int64)
        live = np.arange(len(rows))
        ranks, symbols = self.pairs(rows[:, :-1], rows[:, 1:])
        while (length := rows.shape[1]) > 1 and len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            go = ranks[each, at] != NONE
            left[live[~go]] = length
            if not go.all():
                rows, ranks, symbols, live, at = rows[go], ranks[go], symbols[go], live[go], at[go]
                each = each[: len(rows)]
                if not len(rows):
                    break
            rows[each, at] = symbols[each, at]
            keep = np.ones(rows.shape, bool)
            keep[each, at + 1] = False
            rows = rows[keep].reshape(len(rows), length - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks, symbols = ranks[keep].reshape(len(rows), length - 2), symbols[keep].reshape(len(rows), length - 2)
            for side in (at - 1, at):  # the pairs that end and begin with the new symbol
                ok = (side >= 0) & (side < length - 2)
                r, s = each[ok], side[ok]
                ranks[r, s], symbols[r, s] = self.pairs(rows[r, s], rows[r, s + 1])
        return left


@functools.cache
def vocabulary(model_path: str) -> PieceVocabulary:
    return PieceVocabulary(model_path)


class Counter:
    """Counts tokens of whole texts; remembers pre-tokens between calls."""

    def __init__(self, model_path: str) -> None:
        self.vocabulary = vocabulary(model_path)
        self.known: dict[str, int] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens of a text, without the one mark that begins each; runs of marks stay in front of their word."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" in words:
            words = [w[1:].replace(" ", MARK) for w in re.findall(r" +[^ ]*", " " + text)]
        return words

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.vocabulary.counts([MARK + w for w in new])))
        return [sum(map(known.__getitem__, words)) for words in split]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens. Strings that look like special tokens are ordinary text. Nothing
    is truncated; other columns are ignored. No shuffle: each scan task counts its own rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                n = counter(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
