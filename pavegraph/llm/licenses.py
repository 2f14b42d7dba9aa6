"""License scans: an exact set-similarity join of blocks of text with the sentences of licenses.

Texts are coded once: the places of all words that some template has. Counted over all documents, these words get one
global order, rare ones first. A template that shares enough words with a block shares one of its first few, its
prefix; so only blocks with a prefix word meet templates, through an index of prefixes. Lengths and places in the order
rule out pairs that cannot reach the threshold any more, and the rest are compared whole. Nothing that meets the
threshold is lost, but for a template whose words are part of a wider one that the same block meets: "CC BY" says
nothing where "CC BY-NC" stands.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A block is two strides of words, so that any run of up to STRIDE words is whole in one block.
STRIDE = 32
#: Index entries that are broadcast; an index of more is joined by shuffle.
BROADCAST_ENTRIES = 200_000
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, share of its words that a block must have, sentence), of at most STRIDE words. Notices must be there whole, as
#: they differ from each other in a word or two. Sentences of public licenses.
TEMPLATES = (
    ("agpl", 1.0, "GNU Affero General Public License"),
    ("apache", 1.0, "Licensed under the Apache License, Version 2.0"),
    ("apache", 0.8, "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", 0.8, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("apache", 0.8, "See the License for the specific language governing permissions and limitations under the License"),
    ("artistic", 1.0, "under the terms of the Artistic License"),
    ("boost", 1.0, "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", 1.0, "Redistribution under the BSD 2-Clause License"),
    ("bsd", 1.0, "Licensed under the BSD 3-Clause License"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", 0.8, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", 0.8, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("bsd", 0.8, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", 1.0, "Creative Commons Attribution 4.0 International License"),
    ("cc-by", 1.0, "Licensed under CC BY 4.0"),
    ("cc-by-nc", 1.0, "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", 1.0, "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", 1.0, "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", 1.0, "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", 1.0, "Licensed under CC BY-SA 4.0"),
    ("cc0", 1.0, "CC0 1.0 Universal"),
    ("eclipse", 1.0, "under the terms of the Eclipse Public License"),
    ("gpl", 1.0, "licensed under the GNU General Public License, version"),
    ("gpl", 0.8, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", 0.8, "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", 1.0, "GNU Lesser General Public License"),
    ("mit", 1.0, "Released under the MIT License"),
    ("mit", 1.0, "Licensed under the MIT License"),
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.8, "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"),
    ("mit", 0.8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", 1.0, "subject to the terms of the Mozilla Public License"),
    ("unlicense", 0.8, "This is free and unencumbered software released into the public domain"),
    ("zlib", 0.8, "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable"),
)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(LOWER))


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[str]
    least: int

    @classmethod
    def of(cls, label: str, share: float, sentence: str, stride: int = STRIDE) -> Template:
        words = words_of(sentence)
        if not 0 < len(words) <= stride:
            raise ValueError(f"a template has 1 to {stride} words: {sentence}")
        return cls(label, frozenset(words), max(1, math.ceil(share * len(set(words)) - 1e-9)))


def _places(words: list[str], phrases: Sequence[tuple[list[str], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    joined, out = " " + " ".join(words) + " ", []
    for phrase, label in phrases:
        want = " " + " ".join(phrase) + " "
        at = joined.find(want)
        while at >= 0:
            out.append((joined.count(" ", 0, at), label))
            at = joined.find(want, at + 1)
    return out


def coded_texts(docs: DataFrame, vocabulary: dict[str, int], phrases, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, n_words, n_base, first_word, last_word, base, places, tokens): places and numbers of the words in ``vocabulary``."""
    kind = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    split = [(words_of(p), label) for p, label in phrases]
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base", "places", "tokens"]
    kinds = [*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, out = batch.slice(start, 200), []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    found = _places(words, split)
                    starts = [at for at, _ in found]
                    known = [(i, vocabulary[w]) for i, w in enumerate(words) if w in vocabulary]
                    out.append((len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({x for _, x in found}), [i for i, _ in known], [t for _, t in known]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["uid", "id", *names])

    return narrow.mapInArrow(code, f"uid long, id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, places array<int>, tokens array<int>")


def blocks_of(coded: DataFrame, rank: np.ndarray, prefix: np.ndarray, stride: int = STRIDE) -> DataFrame:
    """(uid, ranks): the template words of each block, in the global order, of blocks with a word of a ``prefix``."""
    span = len(rank)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, sets = [], []
            for uid, n_words, places, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                ranks = rank[tokens.values.to_numpy()]
                if not prefix[ranks].any():
                    continue
                half, last = places.values.to_numpy() // stride, max(0, -(-n_words // stride) - 2)
                block = np.concatenate([np.minimum(half, last), np.maximum(half - 1, 0)]).astype(np.int64)
                key = np.unique(block * span + np.concatenate([ranks, ranks]))
                edges = np.flatnonzero(np.diff(key // span, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:]):
                    words = key[a:b] % span
                    if prefix[words].any():
                        uids.append(uid)
                        sets.append(words)
            for start in range(0, len(uids), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(uids[start : start + 10_000], pa.int64()), pa.array(sets[start : start + 10_000], pa.list_(pa.int32()))], names=["uid", "ranks"])

    return coded.filter(F.size("tokens") > 0).select("uid", "n_words", "places", "tokens").mapInArrow(cut, "uid long, ranks array<int>")


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, float, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` has (label, template, overlap, size) of every template that some block meets, at its best. The score is
    the largest share of a template's words found, 1 where a phrase stands, 0 if nothing is found. Null and empty texts
    have no words, no labels and score 0; rows without id and repeated rows are each scanned; other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    built = [Template.of(*t) for t in templates]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(t.words for t in built))))}
    coded = table(coded_texts(docs, vocabulary, phrases, id_col, text_col))
    counts = np.zeros(len(vocabulary), np.int64)
    for r in coded.select(F.explode("tokens").alias("t")).groupBy("t").count().collect():  # at most one row a word of the templates
        counts[r.t] = r["count"]
    rank = np.empty(len(vocabulary), np.int32)
    rank[np.lexsort((np.arange(len(vocabulary)), counts))] = np.arange(len(vocabulary), dtype=np.int32)
    prefix, index, sets = np.zeros(len(vocabulary), bool), [], []
    for k, t in enumerate(built):
        ordered = sorted(int(rank[vocabulary[w]]) for w in t.words)
        wider = [(sorted(int(rank[vocabulary[w]]) for w in u.words), u.least) for u in built if t.words < u.words]
        sets.append((k, t.label, len(ordered), t.least, ordered, wider))
        for i, r in enumerate(ordered[: len(ordered) - t.least + 1]):
            prefix[r] = True
            index.append((r, i, k))
    by_word = spark.createDataFrame(index, "rank int, i int, template int")
    whole = spark.createDataFrame(sets, "template int, label string, size int, least int, words array<int>, wider array<struct<words:array<int>,least:int>>")
    entries = by_word.join(F.broadcast(whole), "template")  # made of the templates, which the caller holds
    hint = F.broadcast if len(index) <= BROADCAST_ENTRIES else (lambda df: df)
    probes = blocks_of(coded, rank, prefix).select("uid", "ranks", F.posexplode("ranks").alias("j", "rank"))
    may = (F.size("ranks") >= F.col("least")) & (F.least(F.col("size") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("least"))
    pairs = probes.join(hint(entries), "rank").filter(may)
    met = pairs.withColumn("overlap", F.size(F.array_intersect("ranks", "words"))).filter("overlap >= least").filter("not exists(wider, w -> size(array_intersect(ranks, w.words)) >= w.least)")
    best = met.groupBy("uid", "template").agg(F.first("label").alias("label"), F.max("overlap").alias("overlap"), F.first("size").alias("size"))
    found = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("label", "template", "overlap", "size"))).alias("matches"), F.max(F.col("overlap") / F.col("size")).alias("share"))
    none = F.array().cast("array<struct<label:string,template:int,overlap:int,size:int>>")
    both = coded.drop("places", "tokens").join(found, "uid", "left").withColumn("matches", F.coalesce("matches", none))
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "matches.label")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "matches",
    )
