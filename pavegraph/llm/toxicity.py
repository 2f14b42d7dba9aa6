"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a learned lexicon, how near its words stand to the second person, capitals, punctuation
and obfuscation rates. The lexicon holds words and word beginnings that go with the label, by a lower bound of their log
odds. Fitting sees at most ``SAMPLE_ROWS`` labelled rows, in folds: a row's features use a lexicon, and its calibration
score a model, that never saw it. Scoring reads whole texts where they are scanned, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Labelled rows that fitting sees at most, those of lowest hash; a documented bound of the sample.
SAMPLE_ROWS = 20_000
FOLDS = 5
#: Word beginnings of these lengths count as lexicon terms too.
BEGINNINGS = (4, 5, 6)
#: Words around a lexicon word in which the second person counts.
NEAR = 5
#: Words that a task remembers with their weight; then it starts afresh.
REMEMBERED = 100_000
#: Texts whose terms a task counts together before it hands them on.
COUNTED_TEXTS = 50
#: Second-person words of the corpus languages. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[^\W\d_])(?=[\w@$!]*[0-9@$!])[\w@$!]*[^\W\d_](?![\w@$!])")
CAPS = re.compile(r"\b[A-Z]{3,}\b")
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
FEATURES = ("weight_density", "hit_density", "weight_max", "weight_top", "hits", "near_you", "near_density", "you_density", "capitals", "caps_words", "exclaims", "questions", "punctuation", "digits", "mixed", "hidden_hits", "word_length", "log_words")


@dataclass
class Lexicon:
    """Weights of words (``=word``) and word beginnings."""

    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max(get("=" + word, 0.0), *(get(word[:n], 0.0) for n in BEGINNINGS)) if len(word) > 3 else get("=" + word, 0.0)

    def of(self, words: list[str]) -> list[float]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.weight(w)
        return list(map(known.__getitem__, words))


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {"=" + w for w in words} | {w[:n] for n in BEGINNINGS for w in words if len(w) >= n}


def features_of(text: str, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES for one whole text; all zero for a text without characters."""
    words = WORD.findall(text.lower())
    weights = lexicon.of(words)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(weights) if w > 0] if any(weights) else []
    you = SECOND_PERSON.intersection(words)
    n_you = sum(w in you for w in words) if you else 0
    near = sum(any(w in you for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits) if you else 0
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(byte.sum()))
    capitals, letters = int(byte[65:91].sum()), int(byte[65:91].sum() + byte[97:123].sum())
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    digits = int(byte[48:58].sum())
    mixed = MIXED.findall(text) if digits or byte[64] or byte[36] or byte[33] else []
    hidden = sum(lexicon.weight(m.lower().translate(LOOKALIKE)) > 0 for m in mixed)
    top = sorted((weights[i] for i in hits), reverse=True)[:3]
    return [
        sum(weights) / n,
        len(hits) / n,
        top[0] if top else 0.0,
        sum(top),
        float(len(hits)),
        float(near),
        near / n,
        n_you / n,
        capitals / max(1, letters),
        len(CAPS.findall(text)) / n if capitals > 2 else 0.0,
        int(byte[33]) / size,
        int(byte[63]) / size,
        marks / size,
        digits / size,
        len(mixed) / n,
        float(hidden),
        sum(map(len, words)) / n,
        float(np.log1p(len(words))),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # a feature that is 0 for most rows keeps an edge at 0, and others between its larger values
        self.edges = [np.unique(np.r_[e, 0.0, np.quantile(v, np.linspace(0, 1, self.bins)[1:-1])]) if len(v := x[x[:, j] > 0, j]) else e for j, e in enumerate(self.edges)]
        b, width = self._binned(x), max(len(e) for e in self.edges) + 1
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        d = x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            which, cut, leaf = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64), np.zeros(2**self.depth)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = (node - first)[:, None] * d * width + np.arange(d) * width + b
                gs = np.bincount(key.ravel(), np.repeat(g, d), many * d * width).reshape(many, d, width).cumsum(2)
                hs = np.bincount(key.ravel(), np.repeat(h, d), many * d * width).reshape(many, d, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = -1
                best = gain.reshape(many, -1).argmax(1)
                for k in range(many):
                    if gain[k].ravel()[best[k]] > 1e-6:
                        which[first + k], cut[first + k] = divmod(int(best[k]), width)
                w = which[node]
                right = np.where(w >= 0, b[np.arange(len(y)), w] > cut[node], False)
                node = 2 * node + 1 + right
            at = node - (2**self.depth - 1)
            leaf = -self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.ridge)
            self.trees.append((which, cut, leaf))
            score = score + leaf[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out, each = np.full(len(x), self.base), np.arange(len(x))
        for which, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                w = which[node]
                node = 2 * node + 1 + np.where(w >= 0, b[each, w] > cut[node], False)
            out += leaf[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on score, by pooling adjacent violators; two virtual rows keep it off 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # value, weight, first and last score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v2, w2, _, last = blocks.pop()
            v1, w1, first, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, last])
    pulled = [(v * w + 0.5) / (w + 1) for v, w, *_ in blocks]
    values = np.maximum.accumulate(np.array(pulled)) if pulled else np.array([])
    return np.array([p for b in blocks for p in b[2:]]), np.repeat(values, 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    rate: float

    def fresh(self) -> Model:
        """The model for one task: what it remembers of words goes with the task, not with the broadcast."""
        return replace(self, lexicon=Lexicon(self.lexicon.weights))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of the label for each text; the label's rate if there was nothing to learn from."""
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        raw = self.trees.score(np.array([features_of(t, self.lexicon) for t in texts]))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def fold_of(column):
    return F.pmod(F.xxhash64(column, F.lit("fold")), F.lit(FOLDS)).cast("int")


def lexicon_from(counts: list[tuple[str, float, float]], toxic: float, clean: float) -> Lexicon:
    """Weights by a lower bound of the log odds; terms of fewer than two labelled rows carry none."""
    out = []
    for term, a, b in counts:
        if a >= 2:
            low = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if low > 0.5:
                out.append((float(low), term))
    return Lexicon({t: w for w, t in sorted(out, reverse=True)})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of which rows with crc32(doc_id) % 5 = 0 are never seen."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("y"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .withColumn("fold", fold_of("doc_id"))
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    sample = table(found.groupBy("doc_id", "y", "fold").agg(F.min("text").alias("text")))
    sizes = {(r["fold"], r["y"] > 0): r["n"] for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [sum(n for (_, t), n in sizes.items() if t is c) for c in (False, True)]
    rate = total[1] / max(1, sum(total))
    if min(total) < 2:
        return Model(Lexicon({}), None, (np.zeros(1), np.zeros(1)), rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_TEXTS):
                seen: Counter = Counter()
                for r in batch.slice(start, COUNTED_TEXTS).to_pylist():
                    seen.update((t, 2 * r["fold"] + (r["y"] > 0)) for t in terms_of(r["text"]))
                terms, slots = zip(*seen) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(slots, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "slot", "n"])

    slots = [F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(2 * FOLDS)]
    toxic, clean = (sum(F.col(f"s{2 * k + c}") for k in range(FOLDS)) for c in (1, 0))
    best = (
        sample.mapInArrow(count, "term string, slot int, n long")
        .groupBy("term")
        .agg(*slots)
        .filter((toxic >= 2) & (toxic * (total[0] + 1) > 1.5 * (clean + 0.5) * (total[1] + 1)))
        .orderBy("term")
        .collect()
    )  # terms of several toxic rows of the sample, which is bounded
    rows = [(r["term"], np.array([[r[f"s{2 * k + c}"] for k in range(FOLDS)] for c in (0, 1)], float)) for r in best]
    by_fold = np.array([[sizes.get((k, c), 0) for k in range(FOLDS)] for c in (False, True)], float)

    def without(k: int | None) -> Lexicon:
        kept = [i for i in range(FOLDS) if i != k]
        return lexicon_from([(t, n[1, kept].sum(), n[0, kept].sum()) for t, n in rows], by_fold[1, kept].sum(), by_fold[0, kept].sum())

    weights = [without(k).weights for k in range(FOLDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexica = [Lexicon(w) for w in weights]
        for batch in batches:
            rows = [(features_of(text, lexica[fold]), y > 0, fold) for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")))]
            x, y, fold = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_()), pa.array(fold, pa.int32())], names=["x", "y", "fold"])

    seen = sample.mapInArrow(describe, "x array<double>, y boolean, fold int").toPandas()  # at most sample_rows of a few numbers
    x, y, fold = np.array(seen["x"].tolist()), seen["y"].to_numpy(float), seen["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k]) if (fold != k).any() else 0
    return Model(without(None), Trees().fit(x, y), isotonic(raw, y), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as bounded as the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.fresh()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                p = m.score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their (zero) features. Labels: the largest of repeated ones counts, null ones
    are ignored; of repeated rows of a document one text, the least, is learnt from; with fewer than two rows of either label every score is the label's rate (0 without labels). Inputs
    are the text alone; other columns are ignored. An empty table gives no rows.
    """
    return score(docs, fit(docs, labels, sample_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows not predicted toxic, with all their columns."""
    model = fit(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.fresh()
        at = fields.fieldNames().index("text")
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array(m.score([t or "" for t in part.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(run, fields)
