"""Near-duplicate classes by weighted minwise hashing with darts.

Each shingle is a region whose width is its weight and whose length is a rank axis. Hashes of the shingle and of unit
cells in its region place darts there as a Poisson process; a dart has a rank and one of K coordinates. A text keeps
the earliest dart of each coordinate, so two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. About K ln K darts are thrown for a text however many shingles it has. Bands of coordinates are joined;
every join is verified on the texts themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, merged
from .common import discard, small_batches, table, without
from .hashing import U, Words, groups, mix, rolled, utf8

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 5
#: Texts and bytes of a band that are compared with as many seekers in one task, about, and shingles in a matrix.
PART_TEXTS = 400
PART_BYTES = 4 << 20
COLUMNS = 4096
#: Bytes of texts that are signed together; each takes darts for every shingle, some hundred bytes a byte of text.
SIGN_BYTES = 1 << 18
#: Chances of 0, 1, 2, ... darts in a cell, summed up.
POISSON = np.cumsum([0.36787944117144233 / f for f in (1.0, 1.0, 2.0, 6.0, 24.0, 120.0, 720.0, 5040.0, 40320.0, 362880.0)])


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


class Shingles:
    """Distinct shingles of several texts with their counts; a text of fewer words than a shingle, but not none, is one."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, width: int = SHINGLE) -> None:
        words = Words(offsets, data, lower=True)
        n_words = np.diff(words.first)
        runs = rolled(words.hashes, width)
        count = np.where(n_words >= width, n_words - width + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        key = runs[np.arange(len(doc)) - begin[doc] + words.first[doc]] if len(doc) else np.empty(0, np.uint64)
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):  # hashes of what there is, told apart by the number of words
            part = np.array([rolled(words.hashes[words.first[k] : words.first[k + 1]], int(n_words[k]))[0] + U(n_words[k]) for k in short], np.uint64)
            key, doc = np.r_[key, mix(part)], np.r_[doc, short]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.key, self.doc = key[at], doc[at]
        self.count = np.diff(np.r_[at, len(key)])
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))


def dart_signatures(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) dart numbers, 0 for a text without shingles. ``doc`` is sorted; weights are positive."""
    total = np.bincount(doc, weight, n_docs)
    out = np.zeros((n_docs, k), np.uint64)
    want = k * np.log(k) + 2 * k
    open_ = np.flatnonzero(total > 0)
    low = np.zeros(n_docs)  # ranks below were thrown before
    high = np.zeros(n_docs)
    high[open_] = np.ceil(want / total[open_] * 8) / 8
    best = np.full((n_docs, k), np.inf)
    while len(open_):
        part = np.isin(doc, open_) if len(open_) < n_docs else slice(None)
        e, w, d = key[part], weight[part], doc[part]
        ranks = (np.ceil(high[d]) - np.floor(low[d])).astype(np.int64)
        cells = ranks * np.ceil(w).astype(np.int64)
        which = np.repeat(np.arange(len(e)), cells)
        at = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        rank = (np.floor(low[d])[which] + at % ranks[which]).astype(np.uint64)
        column = (at // ranks[which]).astype(np.uint64)
        cell = mix(e[which] + mix(rank * U(0x9E3779B97F4A7C15) + column * U(0xC2B2AE3D27D4EB4F) + U(1)))
        darts = np.searchsorted(POISSON, unit(cell), "right")
        of = np.repeat(np.arange(len(cell)), darts)
        dart = mix(cell[of] + (np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64) * U(0x165667B19E3779F9))
        when = rank[of] + unit(dart)
        across = column[of] + unit(mix(dart + U(2)))
        owner = d[which[of]]
        ok = (when < high[owner]) & (when >= low[owner]) & (across < w[which[of]])
        owner, when, dart = owner[ok], when[ok], dart[ok]
        slot = owner * k + (mix(dart + U(3)) % U(k)).astype(np.int64)
        order = np.lexsort((dart, when, slot))
        slot, when, dart = slot[order], when[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, when, dart = slot[first], when[first], dart[first]
        earlier = when < best.ravel()[slot]
        best.ravel()[slot[earlier]] = when[earlier]
        out.ravel()[slot[earlier]] = dart[earlier]
        open_ = open_[np.isinf(best[open_]).any(axis=1)]  # a coordinate without a dart: throw further out
        low[open_] = high[open_]
        high[open_] = 2 * high[open_]
    return out


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of coordinates."""
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15), (len(signatures), 1))
    for r in range(rows):
        h = mix(h + parts[:, :, r])
    return h


def signatures(docs: DataFrame, weighting: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, same, bands): ``same`` names equal texts; ``bands`` is null for a text without words. ``docs``: (id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for first, last in groups(offsets, SIGN_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                s = Shingles(own, data[offsets[first] : offsets[last]])
                weight = s.count.astype(float) if weighting == "count" else np.ones(len(s.key))
                found = bands_of(dart_signatures(s.key, weight, s.doc, last - first, bands * rows), bands, rows).view(np.int64)
                values = pa.array(found.ravel())
                some = np.diff(s.first) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * bands), values, mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), lists], names=["id", "same", "bands"])

    return docs.select("id", F.unhex(F.md5("text")).alias("same"), "text").mapInArrow(sign, "id long, same binary, bands array<long>")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighting: str) -> float:
    """Similarity of two shingle sets (sorted keys, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if weighting == "count":
        shared = int(np.minimum(a[1][i], b[1][j]).sum())
        return shared / max(1, int(a[1].sum() + b[1].sum()) - shared)
    return len(both) / max(1, len(a[0]) + len(b[0]) - len(both))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, weighting: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar enough; ``texts``: (id, text)."""
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(0).to_pylist()
                offsets, data = utf8(part.column(3))
                s = Shingles(offsets, data)
                keep = []
                for k, a in enumerate(ids):
                    if last is None or a != last_id:
                        t = Shingles(*utf8(part.column(2).slice(k, 1)))
                        last_id, last = a, (t.key, t.count)
                    at = slice(s.first[k], s.first[k + 1])
                    keep.append(jaccard(last, (s.key[at], s.count[at]), weighting) >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(check, "a long, b long")


def compared(t: pa.Table, similarity: float, weighting: str) -> pa.Table:
    """Links (a, b) among the texts of one part: every seeker against every text of another component.

    ``t``: id, root, seek, text. Similarities come from products of shingle matrices. Components that a link joins are
    one from then on, so there are fewer links than texts, and never pairs.
    """
    column = t.column("text").combine_chunks()
    offsets, data = utf8(column if isinstance(column, pa.Array) else column.chunk(0))
    s = Shingles(offsets, data)
    ids, label = t.column("id").to_numpy(), t.column("root").to_numpy().copy()
    seekers = np.flatnonzero(t.column("seek").to_numpy(zero_copy_only=False))
    _, shingle, n = np.unique(s.key, return_inverse=True, return_counts=True)
    often = n[shingle] > 1  # others are in no intersection
    number = np.cumsum(n > 1) - 1
    doc, value = s.doc[often], number[shingle[often]]
    weight = (s.count[often] if weighting == "count" else np.ones(len(doc))).astype(np.float32)
    size = np.bincount(s.doc, s.count if weighting == "count" else None, len(ids)).astype(float)
    shared = np.zeros((len(seekers), len(ids)), np.float32)
    order = np.argsort(value, kind="stable")
    doc, value, weight = doc[order], value[order], weight[order]
    place = np.full(len(ids), -1)
    place[seekers] = np.arange(len(seekers))
    for first in range(0, int(value[-1]) + 1 if len(value) else 0, COLUMNS):
        cut_ = slice(*np.searchsorted(value, (first, first + COLUMNS)))
        levels = np.unique(weight[cut_])
        for low, high in zip(np.r_[0, levels[:-1]], levels):  # min(x, y) as a sum over levels
            right = np.zeros((len(ids), COLUMNS), np.float32)
            on = weight[cut_] >= high
            right[doc[cut_][on], value[cut_][on] - first] = 1
            shared += (high - low) * (right[seekers] @ right.T)
    total = size[seekers][:, None] + size[None, :] - shared
    near = (shared >= similarity * total - 1e-9) & (label[seekers][:, None] != label[None, :]) & (shared > 0)
    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = seekers[i], j
        if label[a] != label[b]:
            out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
            label[label == label[b]] = label[a]
    columns = list(zip(*out)) or [[], []]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def seekers_round(open_: DataFrame, texts: DataFrame, similarity: float, weighting: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and the (band, id) that are done: compared with all texts of their band.

    ``open_``: (band, id, root) of the bands that still hold several components; ``texts``: (id, text, size). All
    but the texts of a band's largest component are its seekers. A band is dealt into parts of bounded texts and bytes, and
    so many of its seekers as fill a part go to each of them, the others to later rounds. Rows are in proportion to
    ``open_`` in every round, whatever the size of a band.
    """
    sized = open_.join(texts.select("id", "size"), "id")
    by_root = sized.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    main = F.max_by(F.struct("root", "n", "size"), F.struct("n", "root"))
    bands = by_root.groupBy("band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), main.alias("main"))
    share = lambda n, size: F.greatest(F.lit(1), F.ceil(n / PART_TEXTS), F.ceil(size / PART_BYTES)).cast("int")
    bands = bands.select(
        "band",
        F.col("main.root").alias("main"),
        share(F.col("n"), F.col("size")).alias("parts"),
        share(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("turns"),
    )
    mine = sized.join(bands, "band").withColumn("seek", (F.col("root") != F.col("main")) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("turns")) == 0))
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    dealt = table(mine.select("band", "id", "root", "seek", F.explode(F.when(F.col("seek"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part")))
    useful = dealt.filter("seek").select("band", "part").distinct()  # a hash may give a turn no seeker
    rows = dealt.join(useful, ["band", "part"], "left_semi").join(texts.select("id", "text"), "id").select("band", "part", "id", "root", "seek", "text")
    links = table(rows.groupBy("band", "part").applyInArrow(lambda t: compared(t, similarity, weighting), "a long, b long"))
    return links, dealt.filter("seek").select("band", "id").distinct()


def joined_classes(meetings: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, weighting: str) -> DataFrame:
    """``roots`` after comparing all texts of different components that share a band; ``meetings``: (band, id, leader).

    Rounds go on until no band holds two components with texts that were not compared; a leader was compared before.
    """
    left = meetings.filter("id != leader").select("band", "id")
    for turn in itertools.count():
        labelled = table(left.join(roots, left["id"] == roots["node"], "left").select("band", "id", F.coalesce("root", "id").alias("root")))
        mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
        open_ = table(labelled.join(mixed, "band", "left_semi"))
        discard(labelled)
        if not open_.limit(1).count():
            return roots
        links, done = seekers_round(open_, texts, similarity, weighting, turn)
        if links.limit(1).count():
            roots = merged(roots, links)
        left = open_.select("band", "id").join(done, ["band", "id"], "left_anti")
    return roots


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set", bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), n_copies (rows with its very text), class_size.

    A class is a connected component of texts whose 5-word shingle sets have Jaccard ``similarity`` or more; words are
    runs without ASCII white space, A-Z lower-cased. Equal texts are one class, empty and null ones too; a text without
    words is like no other. Rows that share an id count as one document; a row without id is one of the equal texts, and
    its class has no id if all of its rows lack one. Other columns are ignored; an empty table gives no rows.

    Links are found in rounds, so that no group emits its pairs: first each band's texts are compared with one leader;
    then, in bands that still hold several components, the texts outside the largest one are compared with all others.
    Nothing that could join two classes is left out, and the rows of every round are in proportion to the texts.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = table(signatures(narrow, weighting, bands, rows))
    key = lambda same: F.coalesce("id", F.xxhash64(same))  # noqa: E731  never null
    copies = signed.groupBy("same").agg(F.min("id").alias("id"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("n_copies"))
    copies = table(copies.withColumn("key", key("same")))
    banded = copies.select(F.col("key").alias("id"), F.explode("bands").alias("band"))
    turn = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    shared = banded.groupBy("band").agg(F.min(turn).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.col("leader.id").alias("leader"))
    meetings = table(banded.join(shared, "band").select("band", "id", "leader"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    first = table(meetings.filter("id != leader").select(*pair("id", "leader")).distinct())
    nameless = narrow.filter("id is null").select(key(F.unhex(F.md5("text"))).alias("id"), "text").dropDuplicates(["id"])
    wanted = meetings.select("id").distinct()
    texts = narrow.filter("id is not null").union(nameless).join(wanted, "id", "left_semi").dropDuplicates(["id", "text"])
    texts = table(texts.withColumn("size", F.octet_length("text")))
    links = table(verified(first, texts, similarity, weighting))
    roots = joined_classes(meetings, components(links), texts, similarity, weighting)
    discard(meetings, first, texts, links)
    member = copies.join(roots, copies["key"] == roots["node"], "left").select("same", "id", "n_copies", F.coalesce("root", "key").alias("root"))
    classes = member.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n_copies").alias("class_size"))
    named = member.select("same", "n_copies", "root").join(classes, "root").select("same", "class_id", "n_copies", "class_size")
    return signed.select(F.col("id").alias(id_col), "same").join(named, "same").select(id_col, "class_id", "n_copies", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each class, that with the smallest id, with all its columns; rows without id stay."""
    drop = near_classes(docs, id_col=id_col, **options).filter(F.col(id_col) != F.col("class_id")).select(id_col)
    return without(docs, drop, id_col)
