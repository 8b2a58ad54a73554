"""The trie of conversations by their first turns.

A turn's id has a fixed width: 16 big-endian bytes of the SHA-256 of its role and text. A
conversation is cut into segments of ``SEGMENT`` turns, and a segment's key is the id of the
node it starts at and the ids of its turns. Tasks enter their segments into adaptive radix
trees; of a tree's byte depths only those at the end of a turn are nodes of the trie. So what
a task hands on is a row per node it has met, not one per conversation and turn, and rows of
the same node are added up.

Nothing is gathered by node or conversation: a conversation of any length is spread over its
segments, and a node that all conversations share is a row per tree. The node a segment starts
at is known without its predecessors' nodes: hashes of segments with their places add up along
a conversation. Only the digest of the conversations that end at a node must read their ids
in order, in one task, which holds one of them at a time.

What is summed over a node's subtree is summed over its members instead. The smallest member
of a node owns it; a conversation owns the nodes from some depth on. A text is saved once
for each conversation that has it but doesn't own its node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.radix import RadixTree
from lectern.operators.ordered import ordered, running_sum
from lectern.operators.skew import join_per_key
from lectern.session import materialise, scratch

WIDTH = 16
#: Turns of a segment, which is a row.
SEGMENT = 32
#: Segments of a conversation whose running sums one task takes.
CHUNK = 4_096
#: Segments a tree holds before its nodes are handed on.
TREE_SEGMENTS = 20_000

Batches = Iterator[pa.RecordBatch]


def short_hash(value: Column) -> Column:
    """The first ``WIDTH`` bytes of the SHA-256 of bytes."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * WIDTH))


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, nth, tid, size``: each conversation's turns from 1, ordered by turn (null
    first), turns of one place by their id; the id of role and text, and the text's bytes.

    Null roles and texts are empty; rows with a null ``conv_id`` are left out, as are other
    columns. Rows are sorted over all tasks, so a conversation may have any number of them,
    also equal ones. An empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        short_hash(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("tid"),
        F.octet_length(text).cast("long").alias("size"),
        F.rand(7).alias("salt"),  # parts rows that are equal, whose order doesn't matter
    )
    order = ["turn", "tid", "salt"]
    placed = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "trie-turns")
    counted = running_sum(ordered(placed, ["conv_id"], order, F.col("part")), "nth", F.lit(1).cast("long"))
    return counted.df.select("conv_id", "nth", "tid", "size")


def whole(turns: DataFrame) -> DataFrame:
    """``conv_id, total`` of conversations as they are."""
    return turns.groupBy("conv_id").agg(F.max("nth").alias("total"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations with another one's beginning: the first ``h`` turns of conversation
    ``c - c % every`` (fewer, where it has fewer), then the own ones after the first ``h``, with
    ``h = crc32(c) % most``. Their turns, and ``conv_id, total`` (0 for those left without)."""
    rows = materialise(turns, "trie-numbered")
    c = F.col("conv_id")
    convs = whole(rows).select(
        "conv_id",
        F.col("total").alias("own"),
        (F.crc32(c.cast("string").cast("binary")) % most).alias("h"),
        (c - c % every).alias("base"),
    )
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    total = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = materialise(convs.select("conv_id", "base", "h", "taken", total.cast("long").alias("total")), "trie-conversations")

    own = join_per_key(rows, convs.select("conv_id", "h", "taken"), ["conv_id"]).filter("nth > h")
    own = own.withColumn("nth", F.col("nth") - F.col("h") + F.col("taken")).select(*rows.columns)
    # A beginning has fewer than `most` turns and goes to fewer than 2 * `every` conversations.
    heads = rows.filter((F.col("nth") < most) & (c % every == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "h"), "base").filter("nth <= h").select(*rows.columns)
    return own.unionByName(heads), convs.select("conv_id", "total")


def _running(rows: DataFrame, name: str, value: Column, backwards: bool = False) -> DataFrame:
    """The sum of ``value`` over a conversation's segments up to each one, or from the last one
    back to it. Conversations of one segment need no neighbours."""
    one = rows.filter(F.col("total") <= SEGMENT).withColumn(name, value)
    sign = F.lit(-1 if backwards else 1)
    more = rows.filter(F.col("total") > SEGMENT).withColumn("_at", F.col("segment") * sign)
    # Chunks never fall along the order in either direction.
    more = ordered(more, ["conv_id"], ["_at"], F.floor(F.col("_at") / CHUNK))
    more = running_sum(more, name, value).df.drop("chunk", "_at")
    kind = dict(more.dtypes)[name]
    return one.withColumn(name, F.col(name).cast(kind)).unionByName(more)


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, segment, total, start, stop, key, sizes, ending``: conversations in segments,
    with the ids of the node each starts at, of the node it ends at if it is full, and of the
    conversation's last node, in its last segment."""
    place = F.floor((F.col("nth") - 1) / SEGMENT)
    entries = F.sort_array(F.collect_list(F.struct("nth", "tid", "size")))
    rows = turns.groupBy("conv_id", place.alias("segment")).agg(entries.alias("turns"))
    rows = join_per_key(rows, convs, ["conv_id"])
    key = F.aggregate(
        F.transform("turns", lambda t: t["tid"]), F.lit(bytearray()), lambda a, b: F.concat(a, b)
    )
    rows = rows.select(
        "conv_id", "segment", "total", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")
    )
    none = convs.filter("total = 0").select(
        "conv_id", F.lit(0).cast("long").alias("segment"), "total",
        F.lit(bytearray()).alias("key"), F.array().cast("array<bigint>").alias("sizes"),
    )
    rows = rows.unionByName(none)
    hexed = F.sha2(F.concat(F.col("segment").cast("string").cast("binary"), F.col("key")), 256)

    def part(at: int) -> Column:
        return F.conv(F.substring(hexed, at, 11), 16, 10).cast("decimal(14,0)")

    # 88 bits, so that sums stay within a decimal's 38 digits.
    number = part(1) * F.lit(str(16**11)).cast("decimal(14,0)") + part(12)
    full = F.length("key") == WIDTH * SEGMENT
    rows = rows.withColumn("number", F.when(full, number).otherwise(F.lit("0").cast("decimal(29,0)")))
    rows = _running(rows, "upto", F.col("number").cast("decimal(28,0)"))

    def node(segment: Column, sum_: Column) -> Column:
        return short_hash(F.concat_ws(":", segment.cast("string"), sum_.cast("decimal(38,0)").cast("string")).cast("binary"))

    rows = rows.withColumn("start", node(F.col("segment"), F.col("upto") - F.col("number")))
    rows = rows.withColumn("stop", F.when(full, node(F.col("segment") + 1, F.col("upto"))))
    inside = F.when(F.length("key") == 0, F.col("start")).otherwise(short_hash(F.concat("start", "key")))
    last = (F.col("segment") + 1) * SEGMENT >= F.col("total")
    ending = F.when(last, F.coalesce("stop", inside))
    return rows.select("conv_id", "segment", "total", "start", "stop", "key", "sizes", ending.alias("ending"))


class Members:
    """Segments that begin alike: how many, the smallest conversation, one of them as a
    sample, and sums: of leaves, and of what is saved from each depth on."""

    __slots__ = ("n", "conv", "sample", "leaves", "saved")

    def __init__(self):
        self.n, self.conv, self.sample, self.leaves, self.saved = 0, None, None, 0, None

    def add(self, other: Members, turns: int) -> None:
        """Those of a branch, which are alike for so many turns."""
        self.n += other.n
        self.leaves += other.leaves
        if self.conv is None or other.conv < self.conv:
            self.conv = other.conv
        if self.sample is None:
            self.sample = other.sample
        if other.saved is not None:
            head = other.saved[: turns + 1]
            self.saved = head.copy() if self.saved is None else self.saved + head


def nodes_of(tree: RadixTree) -> Iterator[tuple[Members, int]]:
    """The members and the turns of each node: of the depths in bytes, only the ends of turns."""
    held: dict[int, Members] = {}
    for parent, node, start, end in tree.walk():
        mine = held.pop(id(node), None) or Members()
        if node.value is not None:
            mine.add(node.value, end // WIDTH - 1)
        if mine.conv is None:  # an empty tree
            continue
        for depth in range((start // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            yield mine, depth // WIDTH - 1
        if parent is not None:
            held.setdefault(id(parent), Members()).add(mine, start // WIDTH - 1)


def node_id(sample: tuple, turns: int) -> bytes:
    segment, key, sizes, stop = sample
    if turns == 0:
        return key[:WIDTH]
    if turns == SEGMENT:
        return stop
    return hashlib.sha256(key[: WIDTH * (turns + 1)]).digest()[:WIDTH]


ROW = "node binary, parent binary, depth long, size long, n_convs long, conv_id long, n_leaves long, saved long"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
TYPES = {"binary": pa.binary(), "long": pa.int64()}
SCHEMA = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in ROW.split(", ")])


def trees(weighted: bool, most: int = TREE_SEGMENTS) -> Callable[[Batches], Batches]:
    """Rows of the nodes that segments pass, by trees of at most so many segments; ``weighted``
    ones also carry ``leaf``, ``shared`` (up to which depth others own the nodes) and ``rest``
    (what later segments save)."""

    def handed_on(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for members, turns in nodes_of(tree):
            sample = members.sample
            # The node a later segment starts at is the last one of its predecessor.
            if turns == 0 and sample[0]:
                continue
            saved = int(members.saved[turns]) if weighted else 0
            rows.append(
                (
                    node_id(sample, turns),
                    node_id(sample, turns - 1) if turns else None,
                    sample[0] * SEGMENT + turns,
                    sample[2][turns - 1] if turns else 0,
                    members.n,
                    members.conv,
                    members.leaves,
                    saved,
                )
            )
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    def run(batches: Batches) -> Batches:
        tree, n = RadixTree(), 0
        for batch in batches:
            names = ["conv_id", "segment", "start", "key", "sizes", "stop"] + ["leaf", "shared", "rest"] * weighted
            for conv, segment, start, key, sizes, stop, *more in zip(*(batch.column(c).to_pylist() for c in names)):
                value = tree.at(start + key, Members)
                one = Members()
                one.n, one.conv, one.sample = 1, conv, (segment, start + key, sizes, stop)
                if weighted:
                    one.leaves, shared, rest = more
                    saved = np.array([0, *sizes], np.int64)
                    saved[max(0, shared - segment * SEGMENT + 1) :] = 0
                    one.saved = saved[::-1].cumsum()[::-1] + rest
                value.add(one, len(sizes))
                n += 1
                if n == most:
                    yield from handed_on(tree)
                    tree, n = RadixTree(), 0
        yield from handed_on(tree)

    return run


def endings(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256``: of the conversations that end at a node, the digest of their ids
    in decimal, ascending, with commas between. They are read in order and never held."""

    def digests(batches: Batches) -> Batches:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at == node:
                    digest.update(b",%d" % conv)
                    continue
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(b"%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    rows = rows.filter("ending IS NOT NULL").select(F.col("ending").alias("node"), "conv_id")
    return rows.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(
        digests, "node binary, ends_sha256 string"
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` of each distinct sequence of first turns, from the root (no
    turns) on.

    ``turns`` has ``conv_id, nth, tid, size`` with places from 1 without gaps, as
    ``numbered_turns`` makes them; ``convs`` has ``conv_id, total`` of all conversations, also
    of those without turns. A node's ``conv_id`` is its smallest member; ``saved_tokens`` adds
    up over its subtree, itself included, the bytes of each node's last text once for each
    member beyond the first; ``ends_sha256`` digests the ids of the members that end there
    (those of none: an empty string). Without conversations there is no root.
    """
    with scratch(turns.sparkSession) as kept:
        rows = materialise(segments(turns, convs), "trie-segments")
        met = rows.select("conv_id", "segment", "start", "key", "sizes", "stop").mapInArrow(trees(False), ROW)
        firsts = [F.min(c).alias(c) for c in ("parent", "depth", "size", "conv_id")]
        nodes = materialise(met.groupBy("node").agg(*firsts, F.sum("n_convs").alias("n_convs")), "trie-met")
        below = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = materialise(nodes, "trie-nodes")

        owners = nodes.groupBy("conv_id").agg(
            F.min("depth").alias("first"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf")
        )
        rows = join_per_key(rows, owners, ["conv_id"])
        shared = F.coalesce(F.col("first") - 1, F.col("total"))
        rows = rows.select("*", shared.alias("shared")).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
        below = F.least(F.col("shared") - F.col("segment") * SEGMENT, F.size("sizes"))
        here = F.slice("sizes", F.lit(1), F.greatest(below, F.lit(0)).cast("int"))
        rows = rows.withColumn("here", F.aggregate(here, F.lit(0).cast("long"), lambda a, b: a + b))
        rows = _running(rows, "rest", F.col("here"), backwards=True).withColumn("rest", F.col("rest") - F.col("here"))
        names = ["conv_id", "segment", "start", "key", "sizes", "stop", "leaf", "shared", "rest"]
        sums = rows.select(*names).mapInArrow(trees(True), ROW)
        sums = sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

        above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        found = join_per_key(nodes, above, ["parent"]).join(sums, "node").join(endings(rows), "node", "left")
        found = found.select(
            "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(bytearray()), 256)).alias("ends_sha256"),
        )
        return kept(found, "trie")


#: The same rows for the registered query's table in DuckDB.
SQL = """
WITH turns AS (
    SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid,
           octet_length(encode(coalesce(text, ''))) AS size,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                   lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
           ), 4294967295::BIGINT) % 9 AS h
    FROM turns
), joined AS (
    SELECT c.conv_id, 0 AS part, t.nth, t.tid, t.size FROM convs c JOIN turns t ON t.conv_id = c.base AND t.nth <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.nth, t.tid, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.nth > c.h
), paths AS (
    SELECT conv_id, size, row_number() OVER placed AS depth, string_agg(tid, '') OVER placed AS path
    FROM joined WINDOW placed AS (PARTITION BY conv_id ORDER BY part, nth)
), members AS (
    SELECT conv_id, size, depth, path FROM paths
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ending AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends
    FROM (SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path
), nodes AS (
    SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved
    FROM members GROUP BY path
), below AS (
    SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
    SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b USING (path)
), upwards AS (
    SELECT left(path, 32 * up) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ends, '')) AS ends_sha256
FROM full_nodes n JOIN upwards u USING (path) LEFT JOIN ending e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""
