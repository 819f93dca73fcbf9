"""The trie of rebuilt conversations against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tierlift.llm import conversation_trie as ct
from tierlift.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_rebuilt(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = turns.get(c - c % family, [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members, children, last = defaultdict(list), defaultdict(set), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
                last[tuple(turns[:d])] = turns[d - 1][1]
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", last.get(key, "")))
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(ids) - 1) * words
    out = []
    for key, ids in members.items():
        ends = sorted(c for c in ids if len(convs[c]) == len(key))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids),
                    len(children[key]) if key in children else 0, leaves[key], saved[key],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def key(row):
    return tuple((v is None, v) if not isinstance(v, str) else v for v in row)


def check(spark, rows, block=ct.BLOCK):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ct.trie(*ct.rebuilt(ct.numbered_turns(df)), block=block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_trie(plain_rebuilt(rows)), key=key)


def some_rows(seed, convs=130, words=3, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), convs):
        for t in range(rnd.randint(1, longest)):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "assistant", None]),
                         rnd.choice([None, "", "a b", "a  b\tc", "é x y z", " "][:words + 2])))
    return rows + rnd.sample(rows, 20)


@pytest.mark.parametrize("block", [1, 2, 64])
def test_nodes_are_those_of_prefix_dictionaries(spark, block):
    check(spark, some_rows(block), block)


def test_small_shards_are_summed(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD_BITS", 3)
    check(spark, some_rows(7, convs=200), 3)


def test_long_and_common_conversations(spark):
    one = [(40, t, "user", f"turn {t // 2}") for t in range(300)]
    twin = [(41, t, "user", f"turn {t // 2}") for t in range(299)]
    common = [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]
    alone = [(19, 0, "user", "base is absent"), (59, 0, None, None)]
    repeated = [(7, 1, "user", "again")] * 50
    check(spark, one + twin + common + alone + repeated + [(None, 1, "user", "no conversation")])


def test_turns_are_numbered_across_range_partitions(spark):
    rows = [(1, i // 3, "user", "x") for i in range(3000)] + [(2, 0, "user", "y")]
    got = ct.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert int(parts) > 1
    assert sorted(r["idx"] for r in got.where("conv_id = 1").collect()) == list(range(3000))
    assert [r["idx"] for r in got.where("conv_id = 2").collect()] == [0]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(3, 0, "user", "hi there", 9)],
                               SCHEMA + ", words int").withColumn("idx", F.lit(1))
    got = ct.trie(*ct.rebuilt(ct.numbered_turns(df))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(
        plain_trie(plain_rebuilt([(3, 0, "user", "hi there")])), key=key)
    assert ct.trie(*ct.rebuilt(ct.numbered_turns(df.where("conv_id > 5")))).collect() == []


def test_query_over_the_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_vertical_bitmaps"](spark, small).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_trie(plain_rebuilt(rows)), key=key)
