"""Trie of conversation prefixes by radix partitioning, most significant turn first.

Turns become numbers of a dictionary, conversations arrays of these numbers, and equal conversations one row. The rows
are one bucket at first. A bucket with many turns is partitioned by Spark: the turns that all its rows share are
skipped at once, and the turn after them deals the rows out to smaller buckets, again and again. A bucket with few
turns is finished within a task by multikey quicksort, whose recursion into equal turns emits the nodes. What is below
a partitioned bucket is added up from its buckets' tops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, table

#: Turns in a bucket that a task finishes.
LOCAL_TURNS = 400_000
#: A turn is hot if it makes up this share of all; so there are at most 1 / HOT_SHARE of them to broadcast.
HOT_SHARE, HOT_LEAST = 0.001, 200
#: Conversations in a range of ids whose equal ones are listed together before they meet.
RANGE_ROWS = 20_000
#: Large buckets that are broadcast; more of them are joined by shuffle.
BROADCAST_BUCKETS, BROADCAST_TURNS = 100_000, 1_000_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id long"


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, dictionary): (conv_id, ids, lens) with a conversation's turns in order; (key, n, id) for each distinct turn.

    A turn's key is the SHA-256 of its role's length, role and text, so that no text is shuffled. Null role and text are
    empty. Turns of the same number stand by role and text. A row without conversation is left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    full = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    rows = table(full.select("conv_id", "turn", "key", F.char_length("text").alias("len")))
    words = table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    hot = table(words.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * rows.count())).select("key", "id"))  # at most 1 / HOT_SHARE rows
    if hot.count():
        marked = rows.join(F.broadcast(hot), "key", "left")
        coded = marked.filter("id is not null").unionByName(marked.filter("id is null").drop("id").join(words.select("key", "id"), "key"))
    else:
        coded = rows.join(words.select("key", "id"), "key")
    listed = lambda df, *order: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*order, "id", "len"))).alias("all"))
    convs = table(listed(coded, "turn"))
    tie = F.exists(F.sequence(F.lit(1), F.size("all") - 1), lambda i: F.col("all")[i]["turn"].eqNullSafe(F.col("all")[i - 1]["turn"]) & (F.col("all")[i]["id"] != F.col("all")[i - 1]["id"]))
    tied = table(convs.filter(F.size("all") > 1).filter(tie).select("conv_id"))
    arrays = ["conv_id", F.col("all.id").alias("ids"), F.col("all.len").alias("lens")]
    out = convs.select(*arrays)
    if not tied.isEmpty():  # their order takes the texts
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
        placed = full.join(tied, "conv_id", "left_semi").select("conv_id", "key", F.char_length("text").alias("len"), place.alias("place"))
        again = listed(placed.join(words.select("key", "id"), "key"), "place").select(*arrays)
        out = table(out.join(tied, "conv_id", "left_anti").unionByName(again))
        discard(convs)
    discard(rows, hot, tied)
    return out, words


def with_shared_heads(convs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Conversations whose first h turns are those of the first of their hundred, h being the id's CRC-32 modulo ``most`` + 1."""
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("ids", 1, most).alias("head"), F.slice("lens", 1, most).alias("head_lens"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = convs.withColumn("first", first).join(heads, "first", "left").withColumn("h", h)
    rest = lambda a: F.when(F.size(a) > F.col("h"), F.slice(a, F.col("h") + 1, F.greatest(F.size(a), F.lit(1)))).otherwise(F.slice(a, 1, 0))
    part = lambda a, head: F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(a, 1, 0)), rest(a))
    return both.select("conv_id", part("ids", "head").alias("ids"), part("lens", "head_lens").alias("lens"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(rep, n, ids, lens, ends): one row for equal conversations, with the smallest id, their number and the SHA-256 of their ids.

    Ranges of ids are listed apart and their lists hashed one after another, in order, so the ids of a large group are
    never held together; SHA-256 takes them in one stream by its nature.
    """
    ranges = max(1, convs.count() // RANGE_ROWS)
    listed = (
        convs.repartitionByRange(ranges, "conv_id")
        .withColumn("range", F.spark_partition_id())
        .groupBy("ids", "range")
        .agg(F.first("lens").alias("lens"), F.sort_array(F.collect_list("conv_id")).alias("members"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "n", "ids", "lens", "ends"]
        ids = lens = sha = None
        rep = n = 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for a, b, members in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("ids", "lens", "members"))):
                a, members = a.as_py(), members.as_py()
                if a != ids:
                    if ids is not None:
                        done.append((rep, n, ids, lens, sha.hexdigest()))
                        if len(done) >= 2_000:
                            yield flush()
                    ids, lens, rep, n, sha = a, b.as_py(), members[0], 0, hashlib.sha256()
                sha.update((("," if n else "") + ",".join(map(str, members))).encode())
                n += len(members)
        if ids is not None:
            done.append((rep, n, ids, lens, sha.hexdigest()))
        if done:
            yield flush()

    return listed.repartition("ids").sortWithinPartitions("ids", "range").select("ids", "lens", "members").mapInArrow(digest, "rep long, n long, ids array<long>, lens array<int>, ends string")


def bucket_nodes(rep: np.ndarray, n: np.ndarray, flat: np.ndarray, lens: np.ndarray, start: np.ndarray, size: np.ndarray, ends: list[str], rows: np.ndarray, depth: int, parent: int | None) -> list[list]:
    """Nodes of one bucket, whose ``rows`` share their first ``depth`` turns, by multikey quicksort; columns as in NODE, the top first."""
    conv, deep, up, count, kids, leaves, saved, end, turn = [], [], [], [], [], [], [], [], []
    top: list[int] = []

    def node(members: np.ndarray, d: int, above: int) -> int:
        at = len(conv)
        first = members[0]
        conv.append(int(rep[members].min()))
        deep.append(d)
        top.append(above)
        up.append(conv[above] if above >= 0 else parent)
        count.append(int(n[members].sum()))
        kids.append(0)
        leaves.append(0)
        saved.append((count[-1] - 1) * int(lens[start[first] + d - 1]) if d else 0)
        end.append(NO_ENDS)
        turn.append(int(flat[start[first] + d - 1]) if d else None)
        if above >= 0:
            kids[above] += 1
        return at

    def chain(row: int, d: int, at: int) -> None:
        """What is left of a single row below the node ``at`` of depth ``d``."""
        a, more = start[row], int(size[row]) - d
        base = len(conv)
        if more:
            kids[at] += 1
            mine, members = int(rep[row]), int(n[row])
            conv.extend([mine] * more)
            deep.extend(range(d + 1, d + more + 1))
            top.extend([at, *range(base, base + more - 1)])
            up.extend([conv[at], *[mine] * (more - 1)])
            count.extend([members] * more)
            kids.extend([1] * (more - 1) + [0])
            leaves.extend([0] * more)
            saved.extend(((members - 1) * lens[a + d : a + d + more].astype(np.int64)).tolist())
            end.extend([NO_ENDS] * more)
            turn.extend(flat[a + d : a + d + more].tolist())
        end[-1 if more else at] = ends[row]

    work = [(rows, depth, -1, True)]  # rows that share ``depth`` turns; whether they are a node of their own, or some below one
    while work:
        members, d, at, fresh = work.pop()
        if fresh:
            at = node(members, d, at)
            over = size[members] == d
            if over.any():
                end[at] = ends[members[over][0]]  # sequences are distinct
                members = members[~over]
        if not len(members):
            continue
        if len(members) == 1:
            chain(members[0], d, at)
            continue
        digit = flat[start[members] + d]
        pivot = np.partition(digit, len(digit) // 2)[len(digit) // 2]
        for side in (members[digit < pivot], members[digit > pivot]):
            if len(side):
                work.append((side, d, at, False))
        equal = members[digit == pivot]
        if len(equal) == 1:
            chain(equal[0], d, at)
        else:
            work.append((equal, d + 1, at, True))
    for i in range(len(conv) - 1, -1, -1):  # below comes after above
        if not kids[i]:
            leaves[i] = 1
        if top[i] >= 0:
            leaves[top[i]] += leaves[i]
            saved[top[i]] += saved[i]
    return [conv, deep, up, count, kids, leaves, saved, end, turn]


def _finish(buckets: pa.Table) -> pa.Table:
    """Nodes of all local buckets of a shard, the way of large buckets above being told with each bucket's top."""
    buckets = buckets.combine_chunks()
    column = lambda c: buckets.column(c).combine_chunks()
    whole = lambda c: column(c).to_numpy(zero_copy_only=False)
    ids = column("ids")
    size = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    start = np.cumsum(size) - size
    flat, lens = ids.flatten().to_numpy(), column("lens").flatten().to_numpy()
    rep, n, depth, ends = whole("rep"), whole("n"), whole("depth"), buckets.column("ends").to_pylist()
    parent, path = buckets.column("parent").to_pylist(), buckets.column("path").to_pylist()
    groups: dict[bytes, list[int]] = {}
    for i in range(len(rep)):
        groups.setdefault(flat[start[i] : start[i] + depth[i]].tobytes(), []).append(i)
    out: list[list] = [[] for _ in range(10)]
    for rows in groups.values():
        found = bucket_nodes(rep, n, flat, lens, start, size, ends, np.array(rows), int(depth[rows[0]]), parent[rows[0]])
        for into, values in zip(out, [*found, [path[rows[0]] or None] + [None] * (len(found[0]) - 1)]):
            into.extend(values)
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int64(), pa.list_(pa.struct([("conv", pa.int64()), ("at", pa.int64())]))]
    names = [c.split(" ")[0] for c in NODE.split(", ")] + ["path"]
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


PATH = "array<struct<conv:long,at:long>>"


def trie_nodes(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes (NODE) of the trie of distinct ``sequences`` (rep, n, ids, lens, ends). A large bucket takes one round for each branching in it."""
    weight = F.size("ids") + 1
    left = table(sequences.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("long"), "path": F.array().cast(PATH)}))
    local: list[DataFrame] = []
    shared: list[DataFrame] = []
    kept = [left]
    while True:
        prefix = F.slice("ids", F.lit(1), F.col("depth"))
        heavy = left.groupBy(prefix.alias("prefix")).agg(F.min("rep").alias("conv"), F.sum("n").alias("n_convs"), F.sum(weight).alias("turns")).filter(F.col("turns") > local_turns)
        large = table(heavy.select("prefix", "conv", "n_convs"))
        found = large.agg(F.count(F.lit(1)), F.sum(F.size("prefix"))).first()
        if not found[0]:
            local.append(left)
            break
        small = found[0] <= BROADCAST_BUCKETS and (found[1] or 0) <= BROADCAST_TURNS
        hint = F.broadcast if small else (lambda df: df)
        keyed = left.withColumn("prefix", prefix)
        local.append(keyed.join(hint(large), "prefix", "left_anti").drop("prefix"))
        inside = keyed.join(hint(large.withColumnRenamed("n_convs", "members")), "prefix").drop("prefix")
        # the first and the last row of a bucket share what all of it shares
        ends = inside.groupBy("conv", "depth", "members", "parent", "path").agg(F.min(F.struct("ids", "lens")).alias("lo"), F.max("ids").alias("hi"))
        apart = F.array_position(F.zip_with("lo.ids", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        common = table(ends.withColumn("at", F.when(apart == 0, F.size("hi")).otherwise(apart - 1).cast("int")))
        at = inside.join(hint(common.select("conv", "depth", "at")), ["conv", "depth"])
        beyond = F.size("ids") > F.col("at")
        stops = at.filter(~beyond).select("conv", "at", F.col("ends").alias("stop"))
        digits = at.filter(beyond).groupBy("conv", "at", F.element_at("ids", F.col("at") + 1).alias("digit")).agg(F.lit(1).alias("one")).groupBy("conv", "at").agg(F.count(F.lit(1)).alias("kids"))
        own = common.join(stops, ["conv", "at"], "left").join(digits, ["conv", "at"], "left").withColumn("lens", F.slice("lo.lens", F.lit(1), F.col("at"))).withColumn("ids", F.slice("lo.ids", F.lit(1), F.col("at")))
        shared.append(table(own.select("conv", "at", "depth", "parent", "path", F.col("members").alias("n_convs"), "ids", "lens", F.coalesce("stop", F.lit(NO_ENDS)).alias("stop"), F.coalesce("kids", F.lit(0)).alias("kids"))))
        deeper = at.filter(beyond).select("rep", "n", "ids", "lens", "ends", (F.col("at") + 1).alias("depth"), F.col("conv").alias("parent"), F.concat("path", F.array(F.struct("conv", F.col("at").cast("long").alias("at")))).alias("path"))
        left = table(deeper)
        kept += [left, large, common]
    parts = local[0]
    for more in local[1:]:
        parts = parts.unionByName(more)
    total = sequences.agg(F.sum(weight)).first()[0] or 0
    shards = max(1, -(-total // local_turns) * 2, sequences.sparkSession.sparkContext.defaultParallelism if total > 20_000 else 1)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(F.slice("ids", F.lit(1), F.col("depth"))), F.lit(shards)))
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    nodes = table(dealt.groupBy("shard").applyInArrow(_finish, f"{NODE}, path {PATH}"))
    discard(*kept)
    if not shared:
        return nodes.select(*names)
    top = shared[0]
    for more in shared[1:]:
        top = top.unionByName(more)
    # turns of the way from ``depth`` on; the top of a way may be the root, which has none
    steps = F.sequence(F.greatest(F.col("depth"), F.lit(1)), F.col("at"))
    some = F.col("at") >= F.greatest(F.col("depth"), F.lit(1))
    cost = lambda since: F.when(F.col("at") >= since, F.aggregate(F.slice("lens", since, F.col("at") - since + 1), F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n_convs") - 1)).otherwise(F.lit(0))
    passed = top.select("path", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), cost(F.greatest(F.col("depth"), F.lit(1))).cast("long").alias("saved_tokens"))
    below = nodes.filter("path is not null").select("path", "n_leaves", "saved_tokens").unionByName(passed)
    below = below.select(F.explode("path").alias("p"), "n_leaves", "saved_tokens").groupBy("p.conv", "p.at").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    rooted = F.when(F.col("depth") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    steps = F.concat(rooted, F.when(some, steps).otherwise(F.array().cast("array<int>")))
    last = F.col("d") == F.col("at")
    here = top.join(below, ["conv", "at"], "left").withColumn("d", F.explode(steps))
    upper = here.select(
        F.col("conv").alias("conv_id"),
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(F.col("kids") == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + cost(F.greatest(F.col("d"), F.lit(1)))).cast("long").alias("saved_tokens"),
        F.when(last, F.col("stop")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        F.when(F.col("d") > 0, F.element_at("ids", F.col("d"))).alias("turn_id"),
    )
    return nodes.select(*names).unionByName(upper.select(*names))


def prefix_trie(turns: DataFrame, local_turns: int = LOCAL_TURNS, rebuild=with_shared_heads, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, dictionary) of the conversations in ``turns``, each rebuilt by ``rebuild`` (None: as they are).

    A node is a distinct sequence of first turns, told by its smallest conversation and its depth; ``turn_id`` is its
    last turn in the dictionary (key, n, id). See NODE for the columns. Null role and text are empty; a null turn comes
    first; turns of one number stand by role and text, repeated rows are repeated turns; rows without conversation are
    left out; other columns are ignored. A conversation is one array of twelve bytes a turn. An empty table has no nodes.
    """
    convs, words = numbered_turns(turns, **columns)
    whole = table(rebuild(convs)) if rebuild else convs
    sequences = table(distinct_sequences(whole))
    if whole is not convs:
        discard(whole)
    discard(convs)
    nodes = trie_nodes(sequences, local_turns)
    discard(sequences)
    return nodes, words


def node_texts(nodes: DataFrame, dictionary: DataFrame, turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with the role and text of their last turn; the root has none."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    texts = turns.select(key.alias("key"), role.alias("role"), text.alias("text")).groupBy("key").agg(F.min_by("role", "role").alias("role"), F.min("text").alias("text"))
    return nodes.join(dictionary.join(texts, "key").select(F.col("id").alias("turn_id"), "role", "text"), "turn_id", "left")
