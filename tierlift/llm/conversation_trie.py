"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt into shards of at most ``SHARD`` neighbours in the order of their ids,
and the turns of a shard into blocks of ``BLOCK`` positions. In a block each (position, turn)
has a posting: the bitset of the shard's conversations with that turn there. A depth-first walk
keeps the bitset of the current node; its intersection with a posting of the next position is
a child, the popcount its members, and what no posting of that position covers ends there.

A prefix is named by the exclusive or of 128-bit hashes of its (position, role, text), so the
same node has one name in all shards, and a block is entered with the names of the blocks before
it. Nodes of all shards are then summed by name. As shards ascend with the ids, the lists of
members that end at a node are concatenated shard by shard and hashed as a stream. Sums over
subtrees double the distance to an ancestor each round, so a trie of depth d takes log2(d).

No task holds a conversation, a first turn or a node as a whole: turns are numbered in range
partitions with offsets, a group is one shard and block, and shards are summed before they meet.
Only a digest of one node is sequential by its nature: one task reads its list, a row per shard.

Defined cases: a null role or text is an empty one; a row without ``conv_id`` belongs to no
conversation and is left out; turns of one number are in the order of role, then text, null
numbers first; repeated rows are turns of their own; other columns are ignored; an empty table
gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlift.llm.common import stored, whole_text

SHARD_BITS = 11
BLOCK = 64
# Fixed value: white space between words.
WORD = "[^\\x20\\x09-\\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, idx, t1, t2, words)``: turns from 0 on, their hashes and words, stored.

    Rows are sorted in range partitions, which may cut a conversation; the few that are cut
    get the number of their turns in earlier partitions added.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        whole_text("role").alias("role"), whole_text("text").alias("text"),
        # Equal rows may be many; a number of their own lets range partitions part them.
        F.monotonically_increasing_id().alias("copy")).where("conv_id is not null")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "copy"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            lengths = np.diff(np.append(starts, len(ids)))
            idx = np.arange(len(ids)) - np.repeat(starts, lengths)
            if ids[0] == last:
                idx[:lengths[0]] += count
            last, count = ids[-1], int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(idx), pa.array(np.full(len(ids), part))],
                ["conv_id", "t1", "t2", "words", "at", "part"])

    inside = stored(ordered.mapInArrow(
        number, "conv_id bigint, t1 bigint, t2 bigint, words bigint, at bigint, part bigint"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    # A partition has at most one conversation that began before it: one row per partition.
    offsets = (
        inside.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n"))
        .select("conv_id", "part", F.sum("n").over(earlier).alias("before"))
        .where("before is not null"))
    return inside.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Members and turns of conversations whose first turns come from the head of their family.

    The first h turns of conversation c are those of ``c - c % family``, h = crc32(c) % heads.
    Returns ``(conv_id, shard, ordinal)`` and ``(conv_id, shard, ordinal, position, z1, z2,
    words)``, positions from 1; both are stored.
    """
    first = (
        turns.where((F.col("conv_id") % family == 0) & (F.col("idx") < heads - 1))
        .groupBy(F.col("conv_id").alias("base"))
        # At most heads - 1 turns.
        .agg(F.array_sort(F.collect_list(F.struct("idx", "t1", "t2", "words"))).alias("first")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.select("conv_id").distinct().withColumn("h", h).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % family)
    ordered = ids.join(first, "base", "left").select(
        "conv_id", "h", F.filter(F.coalesce("first", F.array()), lambda x: x["idx"] < F.col("h"))
        .alias("first")).repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    # Ids of sorted partitions ascend; each partition starts at a multiple of the shard size.
    place = F.monotonically_increasing_id()
    members = stored(ordered.select(
        "conv_id", F.shiftright(place, SHARD_BITS).alias("shard"),
        place.bitwiseAND((1 << SHARD_BITS) - 1).cast("int").alias("ordinal"), "h", "first"))
    keys = ["conv_id", "shard", "ordinal"]
    taken = members.select(*keys, F.explode("first").alias("x")).select(
        *keys, (F.col("x.idx") + 1).alias("position"), "x.t1", "x.t2", "x.words")
    own = turns.join(
        members.select(*keys, "h", F.size("first").alias("n")), "conv_id").where("idx >= h").select(
        *keys, (F.col("n") + F.col("idx") - F.col("h") + 1).alias("position"), "t1", "t2", "words")
    rows = taken.unionByName(own).select(
        *keys, "position", F.xxhash64(F.lit(3), "position", "t1", "t2").alias("z1"),
        F.xxhash64(F.lit(4), "position", "t1", "t2").alias("z2"), "words")
    return members.select(*keys), stored(rows)


class Postings:
    """The bitmaps of one shard and block: (position, turn) to conversations."""

    def __init__(self, start: int, table: pa.Table):
        self.start = start
        column = {n: table.column(n).to_pylist() for n in
                  ("ordinal", "position", "z1", "z2", "words", "conv_id")}
        self.conv: dict[int, int] = {}
        self.entered: dict[tuple[int, int], int] = {}
        self.bits: dict[tuple[int, int, int], int] = {}
        self.turn: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.present: dict[int, int] = {}
        for o, p, z1, z2, words, conv in zip(*column.values()):
            bit = 1 << o
            if p == 0:
                self.conv[o] = conv
                self.entered[z1, z2] = self.entered.get((z1, z2), 0) | bit
                continue
            self.bits[p, z1, z2] = self.bits.get((p, z1, z2), 0) | bit
            self.turn[p, o] = z1, z2, words
            self.present[p] = self.present.get(p, 0) | bit

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield self.conv[low.bit_length() - 1]
            bits ^= low

    def _node(self, k1, k2, depth, p1, p2, bits, words):
        ends = bits & ~self.present.get(depth + 1, 0)
        return (k1, k2, depth, p1, p2, self.conv[(bits & -bits).bit_length() - 1],
                bits.bit_count(), words,
                ",".join(map(str, self.members(ends))) if ends else None)

    def nodes(self, block: int) -> Iterator[tuple]:
        """Depth first from the nodes that enter the block."""
        stack = [(k1, k2, self.start, bits) for (k1, k2), bits in self.entered.items()]
        if self.start == 0:
            for _, _, _, bits in stack:
                yield self._node(0, 0, 0, None, None, bits, 0)
        while stack:
            k1, k2, depth, bits = stack.pop()
            depth += 1
            if depth > self.start + block:
                continue
            rest = bits & self.present.get(depth, 0)
            while rest:
                z1, z2, words = self.turn[depth, (rest & -rest).bit_length() - 1]
                child = bits & self.bits[depth, z1, z2]
                rest &= ~child
                yield self._node(k1 ^ z1, k2 ^ z2, depth, k1, k2, child, words)
                stack.append((k1 ^ z1, k2 ^ z2, depth, child))


NODE = pa.schema([
    ("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("p1", pa.int64()),
    ("p2", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()),
    ("ends", pa.string()), ("shard", pa.int64())])


def shard_nodes(members: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of every shard: a row per shard and node."""
    keys = ["shard", "ordinal", "conv_id"]
    number = F.floor((F.col("position") - 1) / block)
    # A block also sees the first position of the next one: who has no turn there ends before.
    border = (F.col("position") > 1) & ((F.col("position") - 1) % block == 0)
    turns = rows.select(
        *keys, F.explode(F.when(border, F.array(number, number - 1)).otherwise(F.array(number)))
        .alias("block"), "position", "z1", "z2", "words")
    earlier = Window.partitionBy("shard", "ordinal").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    later = (
        rows.groupBy(*keys, number.alias("block"))
        .agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
        .select(*keys, "block", F.bit_xor("z1").over(earlier).alias("z1"),
                F.bit_xor("z2").over(earlier).alias("z2")).where("block > 0"))
    none = F.lit(0).cast("bigint")
    entries = members.select(*keys, none.alias("block"), none.alias("z1"), none.alias("z2"))
    grouped = turns.unionByName(entries.unionByName(later).select(
        *keys, "block", none.alias("position"), "z1", "z2", none.alias("words")))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        shard, number = (k.as_py() for k in key)
        found = list(Postings(number * block, table).nodes(block))
        columns = zip(*found) if found else [[]] * (len(NODE) - 1)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, NODE)]
        return pa.table([*arrays, pa.array([shard] * len(found), type=pa.int64())], schema=NODE)

    return grouped.groupBy("shard", "block").applyInArrow(
        walk, "k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, conv_id bigint, "
              "n_convs bigint, words bigint, ends string, shard bigint")


def _end_digests(nodes: DataFrame) -> DataFrame:
    """SHA-256 of each node's comma-joined list, fed shard by shard."""
    lists = (
        nodes.where("ends is not null").select("k1", "k2", "shard", "ends")
        .repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done: list) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int64()),
                 pa.array(columns[2], type=pa.string())], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for k1, k2, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ends.encode())
            yield out(done)
        if state:
            yield out([(*key, state.hexdigest())])

    return lists.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def subtree_sums(nodes: DataFrame, depth: int, values: list[str]) -> DataFrame:
    """``values`` of every node ``(k1, k2)`` summed over its subtree, itself included.

    After round i a node has the sum down to a distance below 2**i and knows the ancestor that
    far above it (``u1``, ``u2``).
    """
    state, reach = nodes.select("k1", "k2", "u1", "u2", *values), 1
    while reach <= depth:
        gains = state.where("u1 is not null").groupBy("u1", "u2").agg(
            *[F.sum(v).alias(f"more_{v}") for v in values]).select(
            F.col("u1").alias("k1"), F.col("u2").alias("k2"), *[f"more_{v}" for v in values])
        above = state.where("u1 is not null").select(
            F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"),
            F.col("u2").alias("v2"))
        state = stored(
            state.join(gains, ["k1", "k2"], "left").join(above, ["u1", "u2"], "left").select(
                "k1", "k2", F.col("v1").alias("u1"), F.col("v2").alias("u2"),
                *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))
        reach *= 2
    return state.select("k1", "k2", *values)


def trie(members: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    parts = stored(shard_nodes(members, rows, block))
    summed = parts.groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.min("words").alias("words"))
    nodes = stored(summed.join(_end_digests(parts), ["k1", "k2"], "left"))
    children = nodes.where("p1 is not null").groupBy(
        F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = stored(nodes.join(children, ["k1", "k2"], "left").select(
        "k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    depth = counted.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(counted.withColumnsRenamed({"p1": "u1", "p2": "u2"}), depth,
                        ["n_leaves", "saved_tokens"])
    parents = counted.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                             F.col("conv_id").alias("parent_conv_id"))
    return (
        counted.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"])
        .join(parents, ["p1", "p2"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256"))


ORACLE_SQL = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                              coalesce(text, '')) - 1 AS idx
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, (xor(list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                          WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END),
        4294967295::BIGINT)) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
    SELECT c.conv_id, t.idx, t.role, t.text
    FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.idx < c.h
    UNION ALL
    SELECT c.conv_id, t.idx + 1000000000, t.role, t.text
    FROM c JOIN t ON t.conv_id = c.conv_id AND t.idx >= c.h),
r AS (
    SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY idx)
                               FILTER (idx IS NOT NULL), []) AS turns
    FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
p AS (
    SELECT conv_id, d AS depth, len(turns) AS n, turns[1:d] AS key, turns[1:d - 1] AS up,
           len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (
    SELECT key, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id,
           count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                           FILTER (n = depth), '')) AS ends_sha256
    FROM p GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
s AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.key = k.key),
a AS (
    SELECT s.key[1:x] AS key, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves,
           sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS x FROM s) s GROUP BY s.key[1:x])
SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.n_leaves,
       a.saved_tokens, s.ends_sha256
FROM s JOIN a ON a.key = s.key LEFT JOIN n u ON s.depth > 0 AND u.key = s.up
"""
