"""SimHash groups against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tierlift.llm import simhash
from tierlift.llm.components import connected_components
from tierlift.llm.queries import QUERIES


def plain_fingerprint(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = ([" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)]
             if len(parts) >= words else [" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_groups(rows, words, radius):
    prints = [plain_fingerprint(t, words) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i]
             if (a ^ b).bit_count() <= radius]
    root = plain_components(distinct, links)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]].append(i)
    return [(i, f"{p:016x}", min(least[root[p]], default=None)) for (i, _), p in zip(rows, prints)]


def some_texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = ["", None, "one", "A b C", "\x0b \t", "Über ÄB straße \x85x", "x" * 5000]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            near = list(base)
            near[rnd.randrange(len(near))] = "changed"
            texts.append("\n".join(near))
    return texts


@pytest.mark.parametrize("limit", [2000, 3])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, limit):
    run = simhash.bucket_links
    monkeypatch.setattr(simhash, "bucket_links", lambda *a, **k: run(*a, **(k | {"limit": limit})))
    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[9]), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_groups(docs, 4, 4).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")), "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_groups(rows, 4, 4), key=key)


def test_query_on_the_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op10_covering_simhash"](spark, small).collect()}
    assert got == set(plain_groups([tuple(r) for r in docs], 4, 4))


def test_masks_cover_every_small_difference():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(3)]
    rnd = random.Random(1)
    for _ in range(3000):
        apart = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(apart & m == 0 for m in masks)


def test_long_groups_of_hashes():
    rnd = np.random.default_rng(2)
    counts = np.array([1, 254, 255, 256, 700, 2])
    hashes = rnd.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2)
    at, want = 0, []
    for n in counts:
        part = [int(h) for h in hashes[at:at + n]]
        at += n
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n))
    assert [int(x) for x in simhash.majority_bits(hashes, counts)] == want


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(4)
    links = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)],
             "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)],
             "none": []}[shape]
    df = spark.createDataFrame(links + [(None, 1)], "a bigint, b bigint")
    got = dict(map(tuple, connected_components(df).collect()))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == plain_components(nodes, [x for x in links if x[0] != x[1]])


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "a b c d e f", 1), (2, "a b c d e f", 2), (9, "other words here", 3),
            (None, "a b c d e f", 4), (None, "alone", 5), (9, "other words here", 3),
            (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=lambda r: r[2])
    assert got == [(2, "a b c d e f", 2), (9, "other words here", 3), (None, "alone", 5),
                   (7, None, 6)]
    assert simhash.keep_one(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs).columns == docs.columns
