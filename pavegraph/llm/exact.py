"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into fixed-size byte blocks. The blocks are dealt into buckets by a hash and sorted there; a block's
name is its bucket with its rank among the bucket's distinct blocks, so that equal blocks, and only those, share an
integer name, whatever the number of tasks. Adjacent names are paired and the pairs named likewise, level by level,
until one name is left for each document: two documents have the same name (and block count) if and only if their texts
are the same bytes. No digest takes part in the decision.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, table, without

#: Bytes in a block: large enough for few rows, small enough that long texts spread over many tasks.
BLOCK_BYTES = 1024
#: Blocks or pairs in a bucket, about.
BUCKET_ROWS = 2_000
#: One document in so many is looked at for hot blocks and pairs, which get their names before the shuffle.
SAMPLED = 32
#: A block or pair is hot if it makes up this share of those looked at; so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.002
HOT_LEAST = 8


def normalised(column: str = "text"):
    """Text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(column), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def named(rows: DataFrame, sample: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """``rows`` with an integer ``name`` for each distinct combination of ``keys``.

    A hot combination, one that makes up much of ``sample``, is named by its rank among the hot ones, which are few
    enough to broadcast; so no bucket gets most of the rows. Which way a row takes changes names, but not which are equal.
    """
    counted = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_LEAST, HOT_SHARE * sample.count())
    hot = table(counted.filter(F.col("n") >= least).select(*keys, F.row_number().over(Window.orderBy(*keys)).cast("long").alias("hot")))  # fewer than 1 / HOT_SHARE rows
    cold = F.col("hot").isNull()
    if hot.count():
        marked = rows.join(F.broadcast(hot), keys, "left").withColumns({k: F.when(cold, F.col(k)) for k in keys})
    else:
        marked = rows.withColumn("hot", F.lit(None).cast("long"))
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    bucket = F.pmod(F.when(cold, F.xxhash64(*keys)).otherwise(F.xxhash64("uid")), F.lit(buckets)).cast("long")
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long")
    name = F.when(cold, F.shiftleft("_bucket", 24) + rank).otherwise(-F.col("hot"))
    return marked.withColumn("_bucket", bucket).withColumn("name", name).drop("_bucket", "hot", *keys)


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, id, sha, n_blocks, name): one row per document, ``(n_blocks, name)`` being its collision-free identity.

    ``docs``: (uid, id, text), text not null. A level shuffles its blocks or pairs once.
    """
    raw = docs.select("uid", "id", F.unhex(F.sha2("text", 256)).alias("sha"), F.encode("text", "UTF-8").alias("raw"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block_bytes))).cast("int")
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    first = F.col("at") == 0
    cut_up = lambda rows: rows.select("uid", "id", "sha", count.alias("n_blocks"), F.posexplode(slices).alias("at", "block"))
    blocks = cut_up(raw).select("uid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "n_blocks", F.col("n_blocks").alias("left"), "at", "block")
    looked_at = F.pmod(F.xxhash64("uid"), F.lit(SAMPLED)) == 0
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    level = table(named(blocks, cut_up(raw.filter(looked_at)).select("block"), ["block"], (size[0] or 0) // block_bytes + size[1]))
    widest = level.agg(F.max("left")).first()[0] or 1
    done = level.filter("left = 1")
    while widest > 1:
        even = F.col("at") % 2 == 0
        pairs = table(
            level.filter("left > 1")
            .groupBy("uid", F.floor(F.col("at") / 2).cast("int").alias("to"))
            .agg(
                F.max("id").alias("id"),
                F.max("sha").alias("sha"),
                F.max("n_blocks").alias("n_blocks"),
                F.ceil(F.max("left") / 2).cast("int").alias("left"),
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),  # no name is 0
            )
            .withColumnRenamed("to", "at")
        )
        level = table(named(pairs, pairs.filter(looked_at).select("a", "b"), ["a", "b"], pairs.count()))
        discard(pairs)
        done = done.unionByName(level.filter("left = 1"))
        widest = -(-widest // 2)
    return done.select("uid", "id", "sha", "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts the row with the largest id is
    kept; a null id is smaller than any other. Of repeated rows (same id and text) exactly one is kept. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    return _judged(rows, block_bytes).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _judged(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(uid, id, sha, group_size, keep_id, kept) of ``rows`` (uid, id, text). Groups of several are few beside the rows, and written first."""
    names = table(block_names(rows, block_bytes))
    best = names.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "uid")).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = table(best.filter("n > 1"))
    alone = F.col("n").isNull()
    return names.join(groups, ["n_blocks", "name"], "left").select(
        "uid",
        "id",
        "sha",
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.when(alone, True).otherwise(F.col("uid") == F.col("best.uid")).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns."""
    marked = numbered(docs)
    narrow = marked.select("uid", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text")).select("uid", "id", normalised("text").alias("text"))
    drop = _judged(narrow, block_bytes).filter("not kept").select("uid")
    return without(marked, drop, "uid").select("row.*")
