"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pavegraph.llm import blocks, decontam, exact, extract, minhash, packing, substring, suffix, tokens, toxicity, warc

random.seed(5)
SYLLABLES = ["th", "er", "on", "an", "re", "ti", "es", "ou", "ña", "ß", "é"]
WORDS = ["".join(random.choices(SYLLABLES, k=random.randint(1, 4))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text: str, every: int) -> str:
    words = text.split(" ")
    words[::every] = [w + "x" for w in words[::every]]
    return " ".join(words)


BASE = prose(220, 1)
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, edited(BASE, 60)),
    (4, edited(BASE, 55) + " tail"),
    (5, None),
    (6, ""),
    (7, "   \n\t "),
    (8, prose(3, 2)),
    (9, "THE " + BASE.upper() + " the"),
    (10, prose(60, 3) + " " + " ".join(BASE.split(" ")[30:90]) + "\n" + prose(50, 4)),
    (11, ("abc " * 400) + prose(30, 5)),
    (12, prose(9_000, 6)),
    (13, "x" * 20_000),
    (14, prose(120, 7) + " 😀 한국어 <s></s><|endoftext|> \x00 ▁▁a"),
    (15, prose(5, 8) + " id1ot YOU!!"),
    (16, prose(220, 1) + " "),
    (17, prose(40, 9)),
    (17, prose(40, 9)),
    (None, prose(40, 10)),
]
SCHEMA = "doc_id long, text string, id string, uid string, block string, n string, rank string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return _table(spark, ROWS, "docs")


def _table(spark, rows, name, schema=SCHEMA):
    import tempfile

    path = f"{tempfile.mkdtemp()}/{name}"
    width = schema.count(",") + 1
    spark.createDataFrame([(*r, *"abcdefgh"[: width - len(r)]) for r in rows], schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.filter("doc_id = -1")


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def text(t):
    return t or ""


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# 1 packing


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64).collect()
    pieces = Counter()
    for doc, t in ROWS:
        ids = np.array([*library.encode(text(t), add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or min(64, len(ids))
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], [*range(first, len(ids) + 1, 64)])):
            pieces[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_once(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(rng.integers(1, 129, 3_000) if seed else np.full(500, 70), minlength=129)
    used = np.zeros(129, int)
    for parts, n in packing.plan(h):
        assert sum(parts) <= 128 and n > 0
        np.add.at(used, parts, n)
    assert (used == h).all()
    if seed:
        assert sum(n for _, n in packing.plan(h)) <= 1.02 * (h * np.arange(129)).sum() / 128 + 1


# 2 and 4 substrings


def brute_words(rows, window):
    runs, words = Counter(), [re.findall(r"[^\x20\x09-\x0D]+", text(t)) for _, t in rows]
    for w in words:
        runs.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = defaultdict(list)
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc].append((len(w), len(gone), sha(kept.encode())))
    return out


@pytest.mark.parametrize("window", [22, 35])
def test_substring_dedup(docs, none, window):
    got = by_id(substring.substring_dedup(docs, window, block_bytes=4_000, keep_text=True))
    want = brute_words(ROWS, window)
    assert {k: sorted((r.n_words, r.n_removed, r.kept_sha256) for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(r.n_removed for v in got.values() for r in v) > 0
    assert all(sha(r.text.encode()) == r.kept_sha256 for v in got.values() for r in v)
    assert substring.substring_dedup(none).count() == 0


def brute_bytes(rows):
    seen, out = set(), defaultdict(list)
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = text(t).encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc].append((len(b), sum(gone), spans, sha(kept)))
    return out


@pytest.mark.parametrize("hot", [1_000, 1])
def test_suffix_dedup(docs, none, hot):
    got = by_id(suffix.suffix_dedup(docs, block_bytes=4_000, hot_blocks=hot))
    assert {k: sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in brute_bytes(ROWS).items()}
    assert suffix.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_one_phrase_in_very_many_surroundings(spark):
    phrase = "the same forty letters stand everywhere!"
    rows = [(k, prose(30, 500 + k) + phrase + prose(30, 900 + k)) for k in range(60)]
    rows += [(100 + k, "x" + rows[k][1][20:] * 2) for k in range(0, 60, 3)] + [(200 + k, rows[7][1]) for k in range(40)]
    docs = _table(spark, rows, "long")
    for few in (3, 10**6):
        got = by_id(suffix.suffix_dedup(docs, block_bytes=4_000, hot_fragments=few))
        assert {k: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in v] for k, v in got.items()} == brute_bytes(rows)


def test_hot_hashes_are_counted_by_contents():
    hashes, contents = np.array([5] * 6 + [6] * 6 + [7], np.uint64), np.array([1, 2, 3, 4, 5, 5] + [1] * 6 + [1], np.uint64)
    body = np.frombuffer(blocks.send(3, hashes, 1, content=contents).column("body")[0].as_py(), np.uint64)
    assert body.tolist() == [2, 2, 5, 6, 5, 1, 7]


def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1 << 10)
    docs = _table(spark, [(1, prose(3_000, 20)), (2, prose(200, 21) + prose(3_000, 20)[700:9_000])], "long")
    n = by_id(suffix.suffix_dedup(docs))
    assert n[1][0].n_removed == 0 and n[2][0].n_removed >= 8_300 - 2


# 3 toxicity


def test_toxicity(spark, docs, none):
    rows = [(i, prose(40, 100 + i) + (" you utter moronx pathetic" if i % 4 == 0 else "")) for i in range(240)]
    corpus = _table(spark, rows + ROWS, "toxic")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(corpus, labels)
    result = [r for r in got.collect()]
    assert len(result) == len(rows) + len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in result)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in result)
    known = {i for i, _ in ROWS}
    held = [r for r in result if r.held_out and r.doc_id not in known]
    assert len(held) > 20 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9
    kept = toxicity.drop_toxic(corpus, labels)
    assert kept.columns == corpus.columns and kept.count() == sum(r.predicted == 0 for r in result)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("doc_id = -1")).collect()} == {0.0}


def plain_features(t, weights):
    words = re.findall(r"[^\W\d_]+", t.lower())

    def weight(w):
        found = [weights.get("=" + w, 0.0)]
        return max(found + [weights.get(w[:n], 0.0) for n in (4, 5, 6)]) if len(w) > 3 else found[0]

    each = [weight(w) for w in words]
    n, raw = max(1, len(words)), t.encode()
    you = [w in toxicity.SECOND_PERSON for w in words]
    hits = [i for i, x in enumerate(each) if x > 0]
    near = sum(1 for i in hits if any(you[max(0, i - 5) : i + 6]))
    mixed = [m for m in re.findall(r"[\w@$!]+", t) if re.search(r"[^\W\d_]", m) and re.search(r"[0-9@$!]", m)]
    mixed = [m.rstrip("0123456789_@$!") for m in mixed if re.search(r"[^\W\d_]", m)]
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    top = sorted((each[i] for i in hits), reverse=True)[:3]
    return {
        "weight_density": sum(each) / n,
        "hit_density": len(hits) / n,
        "weight_max": max(top, default=0.0),
        "weight_top": sum(top),
        "hits": len(hits),
        "near_you": near,
        "near_density": near / n,
        "you_density": sum(you) / n,
        "capitals": sum(65 <= b <= 90 for b in raw) / max(1, letters),
        "exclaims": t.count("!") / max(1, len(raw)),
        "questions": t.count("?") / max(1, len(raw)),
        "punctuation": sum(chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in raw) / max(1, len(raw)),
        "digits": sum(48 <= b <= 57 for b in raw) / max(1, len(raw)),
        "word_length": sum(map(len, words)) / n,
        "log_words": np.log1p(len(words)),
    }


def test_features_equal_plain_ones():
    weights = {"=moronx": 2.0, "scum": 1.5, "pathe": 0.7, "=du": 0.2}
    texts = ["", "You utter MORONX!! pathetic scumx?", "du bist 3 scummy, tu es b4d m0ron", prose(60, 900) + " you " + prose(3, 901) + " moronx " + prose(30, 902), "ÄÖ ß 😀 a_b (x) [y]", None]
    for t in texts:
        got = dict(zip(toxicity.FEATURES, toxicity.features_of(text(t), toxicity.Lexicon(weights))))
        for name, value in plain_features(text(t), weights).items():
            assert abs(got[name] - value) < 1e-12, (t, name)


def test_trees_score_by_walking_them():
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    x[:, 1] = np.where(x[:, 1] < 0.8, 0, x[:, 1])
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    for row, got in zip(x, trees.score(x)):
        total = trees.base
        for which, cut, leaf in trees.trees:
            node = 0
            for _ in range(trees.depth):
                w = which[node]
                right = w >= 0 and sum(row[w] > e for e in trees.edges[w]) > cut[node]
                node = 2 * node + 1 + int(right)
            total += leaf[node - (2**trees.depth - 1)]
        assert abs(got - total) < 1e-9
    assert np.mean((trees.score(x) > 0) == (y > 0)) > 0.97


def test_isotonic_steps_are_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    s = np.round(rng.random(60), 2)
    y = (rng.random(60) < s).astype(float)
    values = sorted(set(s))
    sums, counts = np.array([y[s == v].sum() for v in values]), np.array([(s == v).sum() for v in values])
    best = np.array([max(min(sums[j : k + 1].sum() / counts[j : k + 1].sum() for k in range(i, len(values))) for j in range(i + 1)) for i in range(len(values))])
    out = np.zeros(len(values))
    for v in np.unique(best.round(12)):  # blocks of one value, drawn a little to the middle
        mine = best.round(12) == v
        out[mine] = (sums[mine].sum() + 0.5) / (counts[mine].sum() + 1)
    out = np.maximum.accumulate(out)
    knots, heights = toxicity.isotonic(s, y)
    assert np.allclose(np.interp(values, knots, heights), out)


def test_scores_never_see_held_out_labels(spark):
    corpus = _table(spark, [(i, prose(30, 300 + i) + (" scumx" if i % 3 == 0 else "")) for i in range(120)], "held")
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (dict((r.doc_id, r.score) for r in toxicity.toxicity(corpus, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


# 5 exact


@pytest.mark.parametrize("block", [16, 1024])
def test_exact_dedup(docs, none, block):
    norm = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), text(t))
    groups = defaultdict(list)
    for doc, t in ROWS:
        groups[norm(t)].append(doc)
    got = exact.exact_dedup(docs, block_bytes=block).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), sha(t.encode())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_dedup(none).count() == 0


def test_hot_blocks_and_pairs_get_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "SAMPLED", 1)
    monkeypatch.setattr(exact, "HOT_LEAST", 3)
    copies = [prose(90, 70), prose(90, 70)[:64] + prose(40, 71), "", prose(200, 72)]
    rows = [(i, copies[i % 4] if i % 3 else prose(20, 800 + i)) for i in range(90)]
    got = exact.exact_dedup(_table(spark, rows, "hot"), block_bytes=32).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, max(ids[t]), len(ids[t]), i == max(ids[t])) for i, t in rows}


# 6 extraction


def page(body, tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>home</a></nav>{body}<footer>foot &copy;</footer>{tail}"


PAGES = [
    (1, "http://a.example/1", page("<div class='ad'>buy</div><article><h1>T&amp;t</h1><p><b>one<br><p>two <i>t</i>hree</p><div class='comments'>no</div></article>"), "T&t one two three"),
    (2, "http://a.example/2", None, ""),
    (3, None, "", ""),
    (4, "//b.example", "plain &lt;text&gt;\n\n here", "plain <text> here"),
    (5, "nonsense", page("<main><article>a<form>f</form></article><aside>s</aside><p>b</p></main>", ""), "a b"),
    (6, "http://c.example/", "<article>cut <script>off", "cut"),
    (7, "http://c.example/", "<article>" + "<p>w</p>" * 3_000, " ".join(["w"] * 3_000)),
    (7, "http://c.example/", "<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
]


def test_extraction(spark):
    pages = _table(spark, [(i, u, h) for i, u, h, _ in PAGES], "pages", "page_id long, url string, html string, host string, low string, text string")
    got = extract.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter((i, u, t, len(t)) for i, u, _, t in PAGES)
    assert extract.extract(pages.filter("page_id = -1")).count() == 0


def test_repeated_branches_outside_main_content_go(spark):
    rows = [(i, f"http://d.example/{i}", f"<div class='x'>same {i % 2} line</div><div class='y'>{prose(20, i)}</div>") for i in range(40)]
    pages = _table(spark, rows, "site", "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract(pages).collect()} == {i: prose(20, i) for i in range(40)}
    copied = [(i, "http://d.example/", "<article><p>copied text</p></article>") for i in range(40)]
    assert {r.text for r in extract.extract(_table(spark, copied, "copies", "page_id long, url string, html string")).collect()} == {"copied text"}


def test_pages_count_once_for_a_path(spark):
    cells = "<table><tr>" + "<td>yes</td>" * 8 + "</tr></table>"
    rows = [(0, "http://one.example/", cells)]
    rows += [(i, f"http://many.example/{i}", "<table>" + "".join(f"<tr><td>{(i >> k) & 1}</td></tr>" for k in range(6)) + f"</table><p><b>note</b> {prose(9, i)}</p>") for i in range(1, 41)]
    pages = _table(spark, rows, "cells", "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert got.pop(0) == " ".join(["yes"] * 8)
    assert got == {i: " ".join(str((i >> k) & 1) for k in range(6)) + f" note {prose(9, i)}" for i in range(1, 41)}
    assert extract.style_tree(pages.selectExpr("'h' as host", "html")).agg({"pages": "max"}).first()[0] == 41


def test_repeated_branches_inside_main_content_go_and_text_outside_stays(spark):
    box = "<div class='box'>written by the staff of this site, all rights are with them</div>"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='wrap'>same<div role='main'>{}</div></div>"):
        rows = [(i, f"http://e.example/{i}", "<div class='top'>hello</div>" + around.format(f"<p>{prose(9, i)}</p>{box}") + f"<div class='more'>{prose(9, 100 + i)}</div>") for i in range(40)]
        pages = _table(spark, rows, "inside", "page_id long, url string, html string")
        assert {r.page_id: r.text.removeprefix("same ") for r in extract.extract(pages).collect()} == {i: f"{prose(9, i)} {prose(9, 100 + i)}" for i in range(40)}
    copied = [(i, "http://e.example/", f"<div class='wrap'><article><p>copied</p>{box}</article></div><aside>{i}</aside>") for i in range(40)]
    assert all(r.text.startswith("copied written") for r in extract.extract(_table(spark, copied, "inside", "page_id long, url string, html string")).collect())
    assert extract.main_text("<article class='comments'>no</article><article class='post'>yes</article>") == "yes"


def test_names_are_a_prior(spark):
    article = "<article><p>{}</p><p class='notice'>{}</p><div class='related work'>{}</div><div class='ad'>{}</div></article><div class='widget'>{}</div><p>{}</p>"
    few = [(k, f"http://few{k}.example/", article.format(*(prose(6, 10 * k + j) for j in range(6)))) for k in range(3)]
    many = [(100 + k, "http://many.example/", article.format(prose(6, 9000 + k), "mind the gap", prose(6, 9500 + k), "buy now", prose(6, 8000 + k), prose(6, 7000 + k))) for k in range(60)]
    crowd = [(1000 + k, "http://crowd.example/", f"<div class='widget'>{prose(6, 20_000 + k)}</div><div class='promo'>all the same</div><p>{k}</p>") for k in range(2 * extract.NAMED_PAGES)]
    got = {r.page_id: r.text for r in extract.extract(_table(spark, few + many + crowd, "named", "page_id long, url string, html string")).collect()}
    for k, _, _ in few:  # nothing but the names to go by
        assert got[k] == " ".join(prose(6, 10 * k + j) for j in (0, 1, 2, 5))
    for k in range(60):  # a notice that is the same everywhere goes, one that differs stays
        assert got[100 + k] == " ".join(prose(6, 1000 * j + k) for j in (9,)) + f" {prose(6, 9500 + k)} {prose(6, 7000 + k)}"
    for k in range(2 * extract.NAMED_PAGES):  # enough pages outweigh a name
        assert got[1000 + k] == f"{prose(6, 20_000 + k)} {k}"


def test_the_tree_removes_branches_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tree = extract.style_tree(pages.select(extract.host_of(F.col("url")).alias("host"), "html"))
    gone = extract.unimportant(tree)
    assert gone.count() >= tree.select("host").distinct().count()
    bare = [extract.main_text(r.html or "") for r in pages.orderBy("page_id").collect()]
    kept = [r.text for r in extract.extract(pages).orderBy("page_id").collect()]
    assert all(len(a) > len(b) for a, b in zip(bare, kept))


def brute_facts(e, path, main, found):
    """Text, content and presentation of every path of a page, by recursion and with plain strings."""
    own, styles = [], []
    for c in e.children:
        if isinstance(c, str):
            own += [" ".join(c.split())] if c.strip() else []
        elif c.tag not in extract.RAW and not c.noise:
            styles.append(c.style)
            inside = (*path, c.style)
            inner = brute_facts(c, inside, main or (inside if c.main else ()), found)
            own += [inner] if inner else []
    if own and e.tag in extract.BLOCK:
        found.setdefault(path, (main, [], []))[1].append(tuple(own))
        found[path][2].append(tuple(styles))
    return tuple(own)


def brute_extract(pages):
    facts = defaultdict(list)
    for host, html in pages:
        found = {}
        brute_facts(extract.parse(html), ("html",), (), found)
        for path, (main, content, shown) in found.items():
            facts[host, path].append((main, tuple(content), tuple(shown)))

    def entropy(values):
        n = Counter(values)
        return -sum(k / len(values) * np.log(k / len(values)) for k in n.values()) / np.log(len(values)) if len(values) > 1 else 1.0

    weight = {}
    for key, seen in facts.items():
        both = 0.8 * entropy([c for _, c, _ in seen]) + 0.2 * entropy([p for *_, p in seen])
        weight[key] = (both * len(seen) + 8) / (len(seen) + 8)

    def low(host, path):
        if (host, path) not in weight:
            return False
        main = facts[host, path][0][0]
        if path == main or weight[host, path] >= 0.5 - 1e-12:
            return False
        return not main or 2 * weight[host, path] < 0.5 * weight[host, main]

    def text_in(e, host, path, gone):
        out = ""
        for c in e.children:
            if isinstance(c, str):
                out += "" if gone else c
            elif c.tag not in extract.RAW and not c.noise:
                inside = (*path, c.style)
                inner = text_in(c, host, inside, low(host, inside) or gone and not c.main)
                out += f" {inner} " if c.tag in extract.BLOCK else inner
            else:
                out += " " if c.tag in extract.BLOCK else ""
        return out

    return [" ".join(text_in(extract.parse(html), host, ("html",), False).split()) for host, html in pages]


def test_style_tree_equals_a_plain_one(spark):
    rng, pages = random.Random(8), []
    for host, n in (("one", 1), ("two", 2), ("five", 5), ("ten", 10), ("many", 45)):
        for i in range(n):
            cells = "".join(f"<td>{rng.randrange(3)}</td>" for _ in range(rng.randrange(4)))
            parts = [
                f"<div class='top'>the same {i % 2} on pages</div>",
                f"<div class='menu{i}x'><p>go</p></div>",
                f"<article><h1>{prose(3, i)}</h1><p>{prose(12, 10 * i)} <b>x</b></p><div class='by'>written by the staff</div><ul><li>{rng.choice('ab')}</li><li>all rights</li></ul></article>",
                f"<table><tr>{cells}</tr></table>" if rng.random() < 0.7 else "<p>none</p>",
                f"<div class='tail'>{'end' if rng.random() < 0.9 else prose(4, i)}</div>",
            ]
            pages.append((host, "".join(p for p in parts if rng.random() < 0.85)))
    table = _table(spark, [(i, f"http://{h}/", t) for i, (h, t) in enumerate(pages)], "plain", "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(table).collect()}
    want = brute_extract(pages)
    assert [got[i] for i in range(len(pages))] == want
    kept = [extract.main_text(t) for _, t in pages]
    inside = [a != b and "written by the staff" in b for a, b in zip(want, kept)]
    assert sum(inside) > 20 and sum(a != b for a, b in zip(want, kept)) > 30  # the tree decides, inside articles too


def test_deep_pages(spark):
    deep = "<div>" * 50_000 + "core" + "</div>" * 50_000
    odd = "<b>" * 20_000 + "<p>x" * 3 + "</i>" * 20_000 + "</p>" * 20_000
    rows = [(1, "http://a/", deep), (2, "http://a/", odd), (3, "http://b/", "<span>" * 30_000 + "end")]
    table = _table(spark, rows, "deep", "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract(table).collect()} == {1: "core", 2: "x x x", 3: "end"}


# 7 near duplicates


def shingles(t):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text(t))]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if text(rows[i][1]) == text(rows[j][1]) or both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[find(i)] = find(j)
    out = defaultdict(set)
    for i, (doc, _) in enumerate(rows):
        out[find(i)].add(doc)
    return {frozenset(v) for v in out.values()}


def classes(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.class_id].add(r.doc_id)
    return {frozenset(v) for v in out.values()}


def test_near_duplicates(spark, docs, none):
    assert classes(minhash.near_classes(docs)) == brute_classes(ROWS)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert minhash.near_classes(none).count() == 0


def test_rows_without_id_keep_the_links_of_their_text(spark):
    other, third = prose(200, 50), prose(200, 51)
    rows = [(None, BASE), (5, BASE), (3, BASE), (7, edited(BASE, 60)), (None, other), (None, other), (9, edited(other, 60)), (None, third), (None, edited(third, 60)), (20, prose(100, 52))]
    docs = _table(spark, rows, "nameless")
    found = minhash.near_classes(docs)
    assert classes(found) == brute_classes(rows)
    got = Counter((r.doc_id, r.class_id, r.n_copies, r.class_size) for r in found.collect())
    assert got == Counter([(None, 3, 3, 4), (5, 3, 3, 4), (3, 3, 3, 4), (7, 3, 1, 4), (None, 9, 2, 3), (None, 9, 2, 3), (9, 9, 1, 3), (None, None, 1, 2), (None, None, 1, 2), (20, 20, 1, 1)])
    assert {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()} == {3, 9, 20, None}


def test_group_of_near_copies_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_TEXTS", 10)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    base, rng = prose(150, 40).split(" "), random.Random(1)
    rows = []
    for i in range(70):
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert classes(minhash.near_classes(_table(spark, rows, "near"))) == brute_classes(rows)


@pytest.mark.parametrize("part_bytes", [1 << 22, 3_000])
def test_no_link_is_lost_among_texts_that_are_unlike_their_leader(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(minhash, "PART_TEXTS", 20)
    monkeypatch.setattr(minhash, "PART_BYTES", part_bytes)
    rng, words = random.Random(2), prose(120, 41).split(" ")
    families = []
    for _ in range(12):  # families share so much that bands chain them, but not enough to be near
        w = words[:]
        for k in rng.sample(range(len(w)), 6):
            w[k] = f"f{rng.randrange(10**6)}"
        families.append(w)
    rows = []
    for i in range(150):
        w = families[i % 12][:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1_000 + i, prose(60, 700 + i)) for i in range(60)]
    got = classes(minhash.near_classes(_table(spark, rows, "chains")))
    assert got == brute_classes(rows) and 12 < len(got) < 180


def test_darts_estimate_weighted_similarity():
    key = np.arange(1, 400, dtype=np.uint64)
    w = np.ones(399)
    w2 = w.copy()
    w2[:100] = 3
    sig = minhash.dart_signatures(np.r_[key, key], np.r_[w, w2], np.r_[np.zeros(399, int), np.ones(399, int)], 2, 600)
    assert abs((sig[0] == sig[1]).mean() - w.sum() / w2.sum()) < 0.07
    assert (minhash.dart_signatures(key[:1], w[:1], np.zeros(1, int), 2, 64)[1] == 0).all()


# 8 decontamination

ITEMS = [(1, " ".join(BASE.split(" ")[40:60])), (2, prose(12, 50)), (3, "Short one"), (4, None), (5, " .;"), (10, " ".join(BASE.split(" ")[45:58]).upper()), (2, prose(12, 50)), (None, prose(11, 51))]


def brute_hits(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text(t)))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc, t in rows:
        w, hit, named = split(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    named |= found
        out[doc, len(w), len(hit), len(named), sha(",".join(sorted(named)).encode()), bool(hit)] += 1
    return out


def test_decontamination(spark, docs, none):
    rows = [*ROWS, (20, prose(30, 60) + " short ONE " + prose(12, 50)), (21, prose(5, 61) + " " + prose(11, 51)), (22, prose(11, 50))]
    corpus = _table(spark, rows, "leaks")
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    got = decontam.decontaminate(corpus, bench)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == brute_hits(rows, ITEMS)
    kept = decontam.drop_contaminated(corpus, bench)
    assert kept.columns == corpus.columns and kept.count() == got.filter("not contaminated").count()
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(docs, bench.filter("item_id = -1")).filter("contaminated or n_hit > 0").count() == 0


def test_decontamination_with_few_terms_and_many_windows(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, line(40)) for i in range(60)] + [(100, "a"), (101, "b b")]
    rows = [(i, line(80)) for i in range(30)] + [(50 + i, "x " + items[i][1] + " y") for i in range(5)] + [(90, "b"), (91, None)]
    corpus, bench = _table(spark, rows, "few"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(corpus, bench)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == brute_hits(rows, items)


def brute_near(rows, items, within):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text(t).lower())
    docs = [(doc, split(t)) for doc, t in rows]
    cf = Counter(w for _, d in docs for w in d)
    out = set()
    for item, t in items:
        w = split(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            terms = set(w[i : i + k])
            rare = min(terms, key=lambda x: (cf[x], x.encode()))
            out |= {(doc, str(item), p) for doc, d in docs for p, x in enumerate(d) if x == rare and terms <= set(d[max(0, p - within) : p + within + 1])}
    return out


def test_proximity_equals_brute_force(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(WORDS[:25]) for _ in range(n))
    rows, items = [(i, line(120)) for i in range(40)] + [(70, None)], [(i, line(rng.choice([1, 2, 3, 4, 12]))) for i in range(30)]
    corpus, bench = _table(spark, rows, "close"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.proximity_matches(corpus, bench, within=15).collect()}
    assert got == brute_near(rows, items, 15) and len(got) > 20
    counts = {r.doc_id: r.n_near for r in decontam.decontaminate(corpus, bench).collect()}
    near = brute_near(rows, items, 20)
    assert counts == {doc: len({i for d, i, _ in near if d == doc}) for doc, _ in rows}


def test_proximity(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    near = " ".join(["filler"] + words[::-1] + ["end"])
    far = " ".join(w + " " + " ".join(["gap"] * 9) for w in words)
    docs = _table(spark, [(1, near), (2, far), (3, None)], "prox")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r.doc_id for r in decontam.proximity_matches(docs, bench).collect()} == {1}


# 9 WARC

WEB = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ \r\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (7, "u", "same"), (7, "u", "same"), (None, "u", "<p>x</p>")]


def test_warc_round_trip(spark):
    pages = _table(spark, WEB, "web", "page_id long, url string, html string, sha string, row string")
    got = warc.round_trip(spark, pages).collect()
    first, want = {}, Counter()
    for i, _, h in sorted(WEB, key=lambda r: (r[0] is None, r[0] or 0)):
        b = text(h).encode()
        seen = b in first
        want[i, len(b), warc.base32_sha1(b), "revisit" if seen else "response", first[b] if seen else None] += 1
        first.setdefault(b, i)
    assert Counter(tuple(r) for r in got) == want
    assert warc.round_trip(spark, pages.filter("page_id = -1")).count() == 0


def test_warc_keeps_payloads_and_finds_faults(spark, tmp_path):
    pages = _table(spark, WEB[:6], "web2", "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_warc(pages, path, min_revisit_bytes=100)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).collect()}
    assert got == {i: text(h) for i, _, h in WEB[:6]}
    record = b"".join(r + warc.END for r in warc.records_of(1, 0, "u", b"y" * 50_000, warc.base32_sha1(b"y" * 50_000), None))
    assert [f["warc-type"] for f in warc.parse_warc(iter([record[:100], record[100:]]))] == ["response"] + ["continuation"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_warc(iter([record[:-3]])))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabcdefg\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"abc" * 9_000, 100)) == b"abc" * 9_000


# 10 token counts


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter(tuple(r) for r in tokens.token_counts(docs, path, limit=1_000).collect())
    n = [len(model.encode(text(t))) for _, t in ROWS]
    assert got == Counter((i, len(text(t).encode()), k, k > 1_000) for (i, t), k in zip(ROWS, n))
    assert tokens.token_counts(none, path).count() == 0


def test_token_counts_of_random_strings():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Counter(path), random.Random(3)
    texts = ["".join(rng.choices("abe the inß▁  \n한é😀①<s>tion", k=rng.randint(0, 900))) for _ in range(300)]
    texts += ["".join(rng.choices(letters, k=2_000)) for letters in ("ab", "aeinrst", "the ing".replace(" ", ""), "x", "er", "=-", "éß", "0123456789", "abcdefghijklmnopqrstuvwxyz") for _ in range(4)]
    assert counter(texts) == [len(model.encode(t)) for t in texts]
