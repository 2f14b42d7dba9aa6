"""The pipeline against its stages' brute-force versions, each judged on what the stage before kept."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pavegraph.llm import queries, toxicity

from .test_edges import BASE, ROWS, brute_classes, brute_hits, edited, prose, text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    unique = [(i, t) for i, t in ROWS if i is not None and i != 17]
    rows = unique + [(100 + i, prose(40, 500 + i) + (" you moronx pathetic scumx" if i % 4 == 0 else "")) for i in range(120)] + [(300, BASE.upper()), (301, edited(BASE, 50))]
    spark.createDataFrame([(i, t, "en", "s", len(text(t))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 503)[:150]), (2, prose(60, 3)[20:140])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_run(spark, folder, tmp_path):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs, now = read("documents"), kept(read("documents"))
    columns = docs.columns
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "toxicity":
            wrong = {r.doc_id for r in toxicity.toxicity(read("documents"), read("labels")).collect() if r.predicted}
            want = {i: t for i, t in now.items() if i not in wrong}
            assert 20 <= len(wrong) <= 45
        elif name == "exact_dedup":
            best = {}
            for i, t in sorted(now.items()):
                best[re.sub("[A-Z]+", lambda m: m[0].lower(), text(t))] = i
            want = {i: now[i] for i in best.values()}
        elif name == "near_dedup":
            want = {min(g): now[min(g)] for g in brute_classes(list(now.items()))}
        else:
            clean = {row[0] for row in brute_hits(list(now.items()), items) if not row[-1]}
            want = {i: t for i, t in now.items() if i in clean}
            assert len(want) < len(now)
        assert kept(docs) == want
        now = want
    packed = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(packed) == key(again)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in now.items():
        ids = np.array([*library.encode(text(t), add_special_tokens=False).ids, 2], "<u4")
        starts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids), 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert key(packed) == sorted(want)


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark, folder):
    rows = [(i, t, "x", "y", 7) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, `group` string, n long")
    docs.write.parquet(f"{folder}/odd.parquet")
    docs = spark.read.parquet(f"{folder}/odd.parquet")
    key = lambda df: sorted(((r.doc_id is not None, r.doc_id or 0, text(r.text)) for r in df.collect()))
    all_rows = sorted((i is not None, i or 0, text(t)) for i, t in ROWS)
    norm = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), text(t))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = key(out)
        if name == "toxicity":
            assert set(got) <= set(all_rows)
        elif name == "exact_dedup":
            best = {}
            for r in all_rows:
                best[norm(r[2])] = r
            assert got == sorted(best.values())
        elif name == "near_dedup":
            keep = {min(i for i in g if i is not None) for g in brute_classes(ROWS) if g != {None}}
            assert got == [r for r in all_rows if not r[0] or r[1] in keep]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = {row[0] for row in brute_hits(ROWS, items) if not row[-1]}
            assert got == [r for r in all_rows if (r[1] if r[0] else None) in clean]
        none = stage(spark, docs.filter("n = 0"), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.packing(spark, docs.filter("n = 0"), folder).count() == 0
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, folder).collect()} == {i for i, _ in ROWS}


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_return_columns_of_any_name(spark, folder):
    names = ["_uid", "_drop", "uid", "ROW", "Drop", "drop_", "ID", "Size"]
    rows = [(i, t, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(ROWS)]
    path = f"{folder}/clashing.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).write.parquet(path)
    docs = spark.read.parquet(path)
    every = set(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= every, name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, folder).collect()} == {i for i, _ in ROWS}
