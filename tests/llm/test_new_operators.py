"""Whitening, prefix tries and license scans against plain versions, over the whole tables and over odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pavegraph.llm import licenses, prefix_trie, queries, whitening

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows, schema):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return store


# 11 whitening


def plain_whitening(vectors: list[list[float]], k: int):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = ((n * x - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return deviation, centred @ parts / np.sqrt(values), values / np.trace(cov)


def compare_whitening(got, ids, vectors, k):
    deviation, want, explained = plain_whitening(vectors, k)
    of = defaultdict(dict)
    for r in got:
        of[r.vec_id][r.component] = r
    for i, d in zip(ids, deviation):
        assert sorted(of[i]) == list(range(1, k + 1)) and all(r.deviation == d and r.n == len(ids) for r in of[i].values())
    w = np.array([[of[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-8
    assert np.allclose([of[ids[0]][c].explained for c in range(1, k + 1)], explained, rtol=1e-8)
    assert all(r.identity_error < 1e-6 for r in got)


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    compare_whitening(queries.op11_whiten(spark, DATA).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_whitening_leaves_out_bad_vectors(stored):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 5))).tolist()
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [-math.inf] * 5, [1.0, 2.0]]
    rows = [(i, v, "a", 1, 2.0) for i, v in enumerate(good + bad)]
    df = stored(rows, "vec_id long, embedding array<double>, id string, n int, y double")
    got = whitening.component_rows(whitening.whiten(df, k=5)).collect()
    assert {r.vec_id for r in got} == set(range(60))
    compare_whitening(got, list(range(60)), good, 5)
    fit = whitening.fit_whitening(df)
    assert fit.passes == 1 and fit.n == 60 and fit.dim == 5


def test_whitening_of_repeated_and_nameless_rows(stored):
    v = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.5, 0.5]]
    df = stored([(1, v[0]), (1, v[1]), (None, v[2]), (4, v[3])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted(r.deviation for r in got) == sorted(plain_whitening(v, 2)[0])
    assert sum(r.vec_id is None for r in got) == 1


def test_whitening_without_variance_and_without_rows(stored):
    df = stored([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.component_rows(whitening.whiten(df)).collect()
    assert len(rows) == 10 and all((r.whitened is None) == (r.component == 2) for r in rows)
    assert {r.explained for r in rows if r.component == 2} == {0.0} and all(r.identity_error < 1e-9 for r in rows)
    flat = whitening.whiten(stored([(1, [2.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert flat[0].deviation == 0 and flat[0].whitened == [None, None] and flat[0].identity_error is None
    assert whitening.whiten(df.filter("vec_id < 0")).count() == 0
    assert whitening.component_rows(whitening.whiten(df.filter("vec_id < 0"))).count() == 0


def test_whitening_of_huge_entries_is_exact(stored):
    v = [[1e30, 0.0], [-1e30, 1.0], [2.0**40, 3.0]]
    got = whitening.whiten(stored([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    at = [[max(-(2**52), min(2**52, math.floor(64 * max(min(c, 2.0**46), -(2.0**46))))) for c in x] for x in v]
    sums = [sum(c) for c in zip(*at)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((3 * a - s) ** 2 for a, s in zip(x, sums)) for i, x in enumerate(at)}


def test_range_finder_ends_early_where_the_spectrum_falls():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for values, full in ((4.0 ** -np.arange(80), False), (np.linspace(2, 1, 80), True)):
        cov = q * values @ q.T
        found, vectors, passes, expanded = whitening.components(lambda b, cov=cov: cov @ b, 80, 8)
        assert expanded == full and passes <= whitening.PASSES + 1
        assert np.allclose(found, values[:8], rtol=0, atol=1e-12)
        assert np.abs(np.abs((vectors * q[:, :8]).sum(0)) - 1).max() < 1e-9


# 12 prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    new = {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + vs[h:] for c, vs in own.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, vs in new.items():
        for d in range(len(vs) + 1):
            members[tuple(vs[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def odd_turns():
    rng = random.Random(1)
    rows = []
    for c in [*range(-150, 250), 1000, 1001]:
        for i in range(rng.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, rng.choice([None, i, i, i]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "é😀"])))
    rows += [(None, 1, "u", "x")] * 3
    rows += [(500 + i, j, "u", "hot") for i in range(60) for j in range(7)]
    rows += [(700, i, "u", "z") for i in range(700)] + [(701, i, "u", "z") for i in range(300)] + [(700, 701, "q", "end")]
    return rows


@pytest.mark.parametrize("local_turns", [400_000, 300, 40])
def test_trie_of_odd_rows(stored, local_turns):
    rows = odd_turns()
    df = stored([(*r, 7, "n", "k") for r in rows], "conv_id long, turn long, role string, text string, ids int, n string, key string")
    nodes, words = prefix_trie.prefix_trie(df, local_turns)
    assert sorted(map(tuple, nodes.select(*TRIE).collect()), key=str) == plain_trie(rows)
    if local_turns == 300:
        texts = prefix_trie.node_texts(nodes, words, df).collect()
        assert len(texts) == nodes.count() and all((r.text is None) == (r.depth == 0) for r in texts)
        assert {(r.depth, r.role, r.text) for r in texts if r.conv_id == 700 and r.depth == 701} == {(701, "q", "end")}


def test_trie_without_rows(stored):
    df = stored(odd_turns(), "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df.filter("conv_id is null"))[0].count() == 0


def test_trie_of_one_turnless_conversation(stored):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    df = stored([(c, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie.prefix_trie(df)[0].select(*TRIE).collect()] == plain_trie([(c, 1, "u", "x")])


# 13 license scans


def plain_scan(text):
    words = licenses.words_of(text or "")
    places = []
    for phrase, label in licenses.PHRASES:
        p = licenses.words_of(phrase)
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    step, found, share = licenses.STRIDE, set(), 0.0
    templates = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    for b in range(max(1, -(-len(words) // step) - 1)):
        block = set(words[b * step : (b + 2) * step])
        met = [t for t in templates if len(block & t.words) >= t.least]
        for t in met:
            if not any(t.words < u.words for u in met):
                found.add(t.label)
                share = max(share, len(block & t.words) / len(t.words))
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else share


LICENSE_TEXTS = [
    None,
    "",
    " \n\t ",
    "Released under the MIT License.",
    "mit, LICENSE mit-license; the mit licence",
    "Licensed under CC BY-NC 4.0.",
    "licensed under CC BY 4.0 and elsewhere licensed under CC BY-NC 4.0",
    "GNU Lesser General Public License",
    "word " * 31 + "Licensed under the Apache License, Version 2.0" + " word" * 5_000 + " Apache License",
    "word " * 33 + licenses.TEMPLATES[9][2] + " word" * 70 + " " + licenses.TEMPLATES[28][2].replace("charge", "cost"),
    "Redistribution and use in source and binary forms, with changes",
    "The above copyright notice and this permission notice shall be included somewhere in all copies of the Software",
    "MİT LICENSE é" * 3,
]


def test_scan_of_odd_texts(stored):
    rows = [(i, t, "a", 1, 2) for i, t in enumerate(LICENSE_TEXTS)] + [(3, LICENSE_TEXTS[3], "a", 1, 2), (None, LICENSE_TEXTS[5], "a", 1, 2)]
    df = stored(rows, "doc_id long, text string, uid string, n_words int, labels int")
    got = licenses.license_scan(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[:8]) for r in got), key=key) == sorted(((i, *plain_scan(t)) for i, t, *_ in rows), key=key)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[5] == "cc-by-nc" and labels[7] == "gpl,lgpl" and labels[9] == "bsd,mit" and labels[0] == ""
    assert licenses.license_scan(df.filter("doc_id < 0")).count() == 0


def test_scan_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[1:]) for r in queries.op13_licenses(spark, DATA).collect()}
    assert got == {i: plain_scan(t) for i, t in texts.items()}
