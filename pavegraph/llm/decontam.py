"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

One scan of the documents stores the index: a posting (term, document, position) for every word that some benchmark item
has too, and at term -1 the length of each document. Collection frequencies come from the index. Each window of an item
is looked up by its rarest term: a posting of that term fixes how the item would lie in the document, and the lists of
the terms around it are intersected at the offsets that follow. Places where consecutive words of item and document
agree for a window or more are phrase matches; places that have all terms of a window close by, in any order, are
proximity matches.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, table, without

#: Words in a window.
WINDOW = 10
#: Words to either side of a window's rarest term in which a proximity match has all its terms.
NEAR = 20
#: All but the characters of words, after A-Z is lower-cased. Fixed value.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A dictionary of up to this many bytes, which is checked, is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: The term whose position in a document is the number of its words.
END = -1


def words_of(column: str = "text") -> Column:
    """The words of a text, null having none."""
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n, width): distinct items with at least one word; width is that of their windows."""
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("words")).distinct()
    return words.withColumn("n", F.size("words")).filter("n > 0").withColumn("width", F.least("n", F.lit(WINDOW)))


class Index:
    """Written tables: ``terms`` (term, tid), numbered in order; ``items`` (iid, item, n, width, at, tid), a row a word; ``postings`` (uid, id, tid, pos)."""

    def __init__(self, docs: DataFrame, items: DataFrame) -> None:
        """``docs``: (uid, id, text); ``items`` as from items_of."""
        numbered = table(items.withColumn("iid", F.monotonically_increasing_id()))
        distinct = numbered.select(F.explode("words").alias("term")).distinct()
        self.terms = table(distinct.sort("term").withColumn("tid", F.monotonically_increasing_id()))
        size = self.terms.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
        known = self.terms.union(docs.sparkSession.createDataFrame([("", END)], "term string, tid long"))
        known = F.broadcast(known) if size <= BROADCAST_BYTES else known
        each = numbered.select("iid", "item", "n", "width", F.posexplode("words").alias("at", "term"))
        self.items = table(each.join(known, "term").drop("term"))
        ended = F.concat(words_of("text"), F.array(F.lit("")))
        self.postings = table(docs.select("uid", "id", F.posexplode(ended).alias("pos", "term")).join(known, "term").select("uid", "id", "tid", "pos"))
        self.frequencies = table(self.postings.filter(F.col("tid") != END).groupBy("tid").agg(F.count(F.lit(1)).alias("cf")))
        discard(numbered)

    def windows(self) -> DataFrame:
        """(iid, width, start, best, terms): each window with its rarest term, best.tid at best.at, and its terms as (at, tid, cf).

        Windows with a term that no document has are left out, as they occur nowhere.
        """
        ahead = Window.partitionBy("iid").orderBy("at").rowsBetween(0, WINDOW - 1)
        placed = self.items.join(self.frequencies, "tid", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
        best = F.min(F.struct("cf", "tid", "at")).over(ahead)
        terms = F.collect_list(F.struct("at", "tid", "cf")).over(ahead)
        full = placed.withColumns({"best": best, "terms": terms}).filter((F.col("at") + F.col("width") <= F.col("n")) & (F.col("best.cf") > 0))
        return full.select("iid", "width", F.col("at").alias("start"), "best", "terms")

    def discard(self) -> None:
        discard(self.terms, self.items, self.postings, self.frequencies)


def ranked(terms: str = "terms") -> Column:
    """The places of a window from its rarest term on, as structs (cf, tid, at)."""
    return F.array_sort(F.transform(terms, lambda x: F.struct(x["cf"].alias("cf"), x["tid"].alias("tid"), x["at"].alias("at"))))


def _only(postings: DataFrame, tids: DataFrame, name: str) -> DataFrame:
    """The postings of the terms in column ``name`` of a written table; what is left is all that a shuffle moves."""
    return postings.join(tids.select(F.col(name).alias("tid")).filter("tid is not null").distinct(), "tid", "left_semi")


def phrase_matches(index: Index) -> DataFrame:
    """(uid, item, first, last): runs of words that hold at least one window of the item.

    A posting of a window's rarest term stays only if the second rarest stands at its offset; then all words around it
    are looked up.
    """
    postings = index.postings.filter(F.col("tid") != END).select("uid", "tid", "pos")
    windows = index.windows().withColumn("by", ranked()).select(
        "iid", "width", F.col("by")[0]["tid"].alias("tid"), F.col("by")[0]["at"].alias("anchor"), F.get("by", F.lit(1))["tid"].alias("tid2"), F.get("by", F.lit(1))["at"].alias("at2"), "terms"
    )
    around = F.array_distinct(F.transform(F.flatten(F.collect_list("terms")), lambda x: F.struct(x["at"].alias("at"), x["tid"].alias("tid"))))
    pairs = table(windows.groupBy("iid", "width", "tid", "anchor", "tid2", "at2").agg(around.alias("around")).withColumn("pair", F.monotonically_increasing_id()))
    shift = F.col("pos") - F.col("anchor")
    first = postings.join(pairs.select("pair", "tid", "anchor", "tid2", "at2"), "tid").select("uid", "pair", shift.alias("shift"), "tid2", (shift + F.col("at2")).alias("pos2"))
    second = _only(postings, pairs, "tid2").select("uid", F.col("tid").alias("tid2"), F.col("pos").alias("pos2"))
    met = first.filter("tid2 is not null and pos2 >= 0").join(second, ["uid", "tid2", "pos2"]).select("uid", "pair", "shift")
    aligned = table(met.union(first.filter("tid2 is null").select("uid", "pair", "shift")))
    whole = aligned.join(pairs.select("pair", "iid", "width", "around"), "pair").groupBy("uid", "iid", "width", "shift").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))
    wanted = whole.select("uid", "iid", "width", "shift", F.explode("around").alias("x")).select("uid", "iid", "width", "shift", F.col("x.at").alias("at"), F.col("x.tid").alias("tid"), (F.col("shift") + F.col("x.at")).alias("pos"))
    wanted = table(wanted.filter("pos >= 0"))
    there = postings.join(table(aligned.select("uid").distinct()), "uid", "left_semi")
    agree = there.join(wanted, ["uid", "tid", "pos"])  # a posting is one row
    line = Window.partitionBy("uid", "iid", "shift").orderBy("at")
    runs = agree.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("uid", "iid", "width", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    names = index.items.select("iid", "item").distinct()
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.col("width")).join(names, "iid").select("uid", "item", "first", "last")


def near_matches(index: Index, within: int = NEAR) -> DataFrame:
    """(uid, item, pos): places of a window's rarest term with all the window's terms at most ``within`` words away, in any order.

    The lists are intersected from the rarest terms on: with the second, then the third, then all the rest.
    """
    tids = F.array_distinct(F.transform(ranked(), lambda x: x["tid"]))
    sets = table(index.windows().select("iid", tids.alias("tids")).distinct().withColumn("wid", F.monotonically_increasing_id()))
    sets = sets.withColumns({f"t{k}": F.get("tids", F.lit(k)) for k in range(3)})
    postings = index.postings.filter(F.col("tid") != END).select("uid", "tid", "pos")
    width = 10 * within  # of a cell; most surroundings lie in one

    def close(places: DataFrame, there: DataFrame) -> DataFrame:
        """Of ``places`` (uid, wid, pos, tid), those with a posting of tid close by."""
        span = F.sequence(F.floor((F.col("pos") - within) / width), F.floor((F.col("pos") + within) / width))
        celled = there.select("uid", "tid", F.col("pos").alias("other"), F.floor(F.col("pos") / width).alias("cell"))
        met = places.withColumn("cell", F.explode(span)).join(celled, ["uid", "tid", "cell"])
        return met.filter(F.abs(F.col("other") - F.col("pos")) <= within).select("uid", "wid", "pos", "tid").distinct()

    left = postings.join(sets.select("wid", F.col("t0").alias("tid"), F.size("tids").alias("n")), "tid").select("uid", "wid", "pos", "n")
    for k in (1, 2):
        asked = left.filter(F.col("n") > k).join(sets.select("wid", F.col(f"t{k}").alias("tid")), "wid")
        left = table(close(asked, _only(postings, sets, f"t{k}")).select("uid", "wid", "pos").join(sets.select("wid", F.size("tids").alias("n")), "wid").union(left.filter(F.col("n") <= k).select("wid", "uid", "pos", "n")).select("uid", "wid", "pos", "n"))
    rest = left.filter("n > 3").join(sets.select("wid", F.explode(F.slice("tids", 4, WINDOW)).alias("tid")), "wid").select("uid", "wid", "pos", "tid")
    there = postings.join(table(left.select("uid").distinct()), "uid", "left_semi")
    seen = close(table(rest), there).groupBy("uid", "wid", "pos").agg(F.count(F.lit(1)).alias("seen"))
    whole = left.join(seen, ["uid", "wid", "pos"], "left").filter(F.coalesce("seen", F.lit(0)) == F.greatest(F.col("n") - 3, F.lit(0)))
    names = index.items.select("iid", "item").distinct()
    return whole.join(sets.select("wid", "iid"), "wid").join(names, "iid").select("uid", "item", "pos").distinct()


def indexed(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> Index:
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return Index(rows, items_of(benchmark, item_col, item_text))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = NEAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, pos): places of a window's rarest term with all the window's terms at most ``within`` words away, in any order.

    Null texts have no words. Rows of one document are not merged; repeated matches of an item at one place are.
    """
    index = indexed(docs, benchmark, id_col, text_col, item_col, item_text)
    ends = index.postings.filter(F.col("tid") == END).select("uid", F.col("id").alias(id_col))
    return near_matches(index, within).join(ends, "uid").select(id_col, "item", "pos")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_near`` is the number of items with a proximity match. Null and empty texts have no words, in documents and
    items; items without words have no window. Repeated items count once, repeated documents are judged each for
    itself, a null item id counts as an empty name. Other columns are ignored. Without documents there are no rows,
    without items no hits.
    """
    index = indexed(docs, benchmark, id_col, text_col, item_col, item_text)
    order = Window.partitionBy("uid").orderBy("first", "last")
    covered = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    hit = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, covered))
    found = phrase_matches(index).withColumn("hit", hit).groupBy("uid").agg(F.sum("hit").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    near = near_matches(index).groupBy("uid").agg(F.countDistinct("item").alias("n_near"))
    named = F.coalesce(F.array_join("items", ","), F.lit(""))
    return (
        index.postings.filter(F.col("tid") == END)
        .select("uid", "id", F.col("pos").cast("long").alias("n_words"))
        .join(found, "uid", "left")
        .join(near, "uid", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(named, 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a hit, with all their columns; judged as by ``decontaminate``."""
    marked = numbered(docs)
    index = Index(marked.select("uid", F.lit(None).cast("string").alias("id"), F.col("row")[text_col].alias("text")), items_of(benchmark, item_col, item_text))
    drop = table(phrase_matches(index).select("uid").distinct())
    index.discard()
    return without(marked, drop, "uid").select("row.*")
