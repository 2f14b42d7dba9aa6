"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .decontam import decontaminate
from .exact import exact_dedup
from .extract import extract
from .licenses import PHRASES, STRIDE, TEMPLATES, Template, license_scan, words_of
from .minhash import near_classes
from .packing import pack
from .prefix_trie import prefix_trie
from .substring import substring_dedup
from .suffix import suffix_dedup
from .tokens import token_counts
from .toxicity import toxicity
from .warc import round_trip
from .whitening import component_rows, whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read(spark, sf_dir, "pages"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_rows(whiten(read(spark, sf_dir, "embeddings")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))[0].drop("turn_id")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("matches")


def _rows(of) -> str:
    return ", ".join("(" + ", ".join("[" + ", ".join(f"'{w}'" for w in v) + "]" if isinstance(v, (list, tuple)) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in of)


SQL: dict[str, str] = {
    "op12_prefix_trie": """
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p,
                          {'r': coalesce(role, ''), 't': coalesce(text, '')} as k from conversations where conv_id is not null),
        own as (select conv_id, list(k order by p) as ks from t group by conv_id),
        h as (select *, conv_id - conv_id % 100 as first,
                     xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                         lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h from own),
        c as (select a.conv_id, coalesce(list_slice(b.ks, 1, a.h), []) || list_slice(a.ks, a.h + 1, len(a.ks)) as ks from h a left join own b on a.first = b.conv_id),
        m as (select conv_id, ks, unnest(range(0, len(ks) + 1)) as d from c),
        p as (select conv_id, len(ks) = d as ends, d, list_slice(ks, 1, d) as k from m),
        n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends,
                     case when d = 0 then 0 else (count(*) - 1) * length(k[d].t) end as saved from p group by k, d),
        kids as (select list_slice(k, 1, d - 1) as k, count(*) as n_children from n where d > 0 group by 1),
        f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (k)),
        u as (select list_slice(k, 1, e) as k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens from (select k, n_children, saved, unnest(range(0, d + 1)) as e from f) group by 1)
        select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, sha256(f.ends) as ends_sha256
        from f join u using (k) left join n up on f.d > 0 and up.k = list_slice(f.k, 1, f.d - 1)
    """,
    "op13_licenses": rf"""
        with d as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        ph(ws, label) as (values {_rows((words_of(p), label) for p, label in PHRASES)}),
        hit as (select uid, s - 1 as s, label from (select uid, w, ws, label, unnest(range(1, len(w) - len(ws) + 2)) as s from d, ph where list_has_all(w, ws)) where list_slice(w, s, s + len(ws) - 1) = ws),
        base as (select uid, count(*) as n, min(s) as a, max(s) as b, list_sort(list_distinct(list(label))) as labels from hit group by uid),
        tp(label, ws, least) as (values {_rows((t.label, sorted(t.words), t.least) for t in (Template.of(*x) for x in TEMPLATES))}),
        bl as (select uid, b, list_distinct(list_slice(w, b * {STRIDE} + 1, (b + 2) * {STRIDE})) as ws from (select uid, w, unnest(range(0, greatest(1, ceil(len(w) / {STRIDE})::bigint - 1))) as b from d)),
        may as (select uid, b, label, tp.ws, len(list_intersect(bl.ws, tp.ws)) as o, len(tp.ws) as n from bl, tp where len(list_intersect(bl.ws, tp.ws)) >= least),
        met as (select * from may where not exists (select 1 from may as m where m.uid = may.uid and m.b = may.b and m.n > may.n and list_has_all(m.ws, may.ws))),
        lab as (select uid, list_distinct(list(label)) as labels, max(o / n) as share from met group by uid)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_base, a as first_word, b as last_word, coalesce(array_to_string(base.labels, ','), '') as base_labels,
               coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(lab.labels, []))), ','), '') as labels,
               case when n > 0 then 1e0 else coalesce(share, 0e0) end as score
        from d left join base using (uid) left join lab using (uid)
    """,
    "op2_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, unnest(range(1, len(w) - 33)) as s, w from d where len(w) >= 35),
        g as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) as g from s),
        hit as (select doc_id, s from g where g in (select g from g group by g having count(*) > 1)),
        gone as (select distinct doc_id, unnest(range(s, s + 35)) as p from hit),
        lost as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
               sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
        from d left join lost using (doc_id)
    """,
    "op5_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t
    """,
    "op8_decontaminate": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from b where len(w) > 0),
        win as (select distinct item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g from bw),
        ks as (select distinct k from win),
        dw as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, ks where len(w) >= k),
        hits as (select dw.doc_id, dw.s, dw.k, win.item_id from (select doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as g from dw) dw join win using (k, g)),
        words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + k)) as p from hits) group by doc_id),
        items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id),
        tok as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as term from d),
        cf as (select term, count(*) as cf from tok where term in (select unnest(w) from b) group by term),
        nw as (select distinct item_id, list_slice(w, s, s + k - 1) as ws from bw),
        rare as (select item_id, ws, arg_min(term, (cf, term)) as term from (select item_id, ws, unnest(ws) as term from nw) left join cf using (term) group by item_id, ws having count(*) = count(cf)),
        near as (select distinct doc_id, item_id from rare join tok using (term) join d using (doc_id) where list_has_all(list_slice(d.w, greatest(p - 20, 1), p + 20), ws)),
        close as (select doc_id, count(*) as n from near group by doc_id)
        select d.doc_id, len(d.w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
               sha256(coalesce(items.names, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated, coalesce(close.n, 0) as n_near
        from d left join words using (doc_id) left join items using (doc_id) left join close using (doc_id)
    """,
    "op9_warc": """
        with t as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) || '00' as hex from pages),
        m as (select *, min(page_id) over (partition by hex) as first_id from t)
        select page_id, octet_length(encode(html)) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((((strpos('0123456789abcdef', substr(hex, (i * 5) // 4 + 1, 1)) - 1) * 256
                    + (strpos('0123456789abcdef', substr(hex, (i * 5) // 4 + 2, 1)) - 1) * 16
                    + (strpos('0123456789abcdef', substr(hex, (i * 5) // 4 + 3, 1)) - 1)) >> (7 - (i * 5) % 4)) & 31) + 1, 1)), '') as payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id = first_id then null else first_id end as refers_to
        from m
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
