"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_simhash import plain_components
from tierlift.llm import multi_index, sorted_lists
from tierlift.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, links int"


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, every, k):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = set()
    for q, a in rows:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def plain_links(rows, threshold):
    """Multiset of (id, links, component)."""
    n = len(rows)
    good = [bool(usable(v)) and any(v) for _, v in rows]
    link = [[False] * n for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j]:
                a, b = (np.array(rows[x][1], dtype=np.float32).astype(float) for x in (i, j))
                w = max(len(a), len(b))
                a, b = np.pad(a, (0, w - len(a))), np.pad(b, (0, w - len(b)))
                link[i][j] = a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold
    root = plain_components(range(n), [(i, j) for i in range(n) for j in range(i) if link[i][j]])
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = (min(ids, default=None) if good[i] else vec_id)
        out.append((vec_id, sum(link[i]), least, None if None in (vec_id, least)
                    else vec_id == least))
    return out


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (902, [0.0, 0.0, 0.0, 0.0]), (903, [nan, 1.0, 0.0, 0.0]),
            (904, [1.0, inf, 0.0, 0.0]), (905, [None, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]),
            (None, [0.3, 0.1, 0.9, -0.5]), (906, [1.0, 0.0]), (906, [1.0, 0.0, 0.0, 0.0]),
            (906, [1.0, 0.0, 0.0, 0.0]), (950, [2.0, 0.0, 0.0, 0.0])]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("blocks", [16384, 40])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(sorted_lists, "CANDIDATES_PER_BLOCK", blocks)
    monkeypatch.setattr(sorted_lists, "QUERIES_PER_BLOCK", 3)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).round(1).tolist()) for i in range(250)] + odd_rows()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    found = sorted_lists.top_k(sorted_lists.scaled(df, 256), F.col("vec_id") % 50 == 0, 5)
    assert {tuple(r) for r in found.collect()} == plain_top(rows, 50, 5)
    assert sorted_lists.top_k(sorted_lists.scaled(df.limit(0), 256), F.lit(True), 5).collect() == []


@pytest.mark.parametrize("scale", [1, 10 ** 5])
def test_bounds_keep_the_best(scale):
    draw = np.random.default_rng(3)
    rows = draw.integers(-100, 100, size=(3000, 8)) * scale
    lists, some = sorted_lists.Lists(rows, np.arange(3000)), np.arange(0, 3000, 300)
    for q, best in zip(some, lists.best(rows[some], some, 5)):
        scores = rows @ rows[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:5]
        assert best == [(scores[i], i) for i in order]


@pytest.mark.parametrize("limit", [1000, 4])
def test_links(spark, monkeypatch, limit):
    run = multi_index.bucket_links
    monkeypatch.setattr(multi_index, "bucket_links",
                        lambda *a, **k: run(*a, **(k | {"limit": limit})))
    monkeypatch.setattr(multi_index, "PER_CELL", 6)
    draw = np.random.default_rng(2)
    base = draw.normal(size=(12, 4))
    rows = [(i, (base[i % 12] + draw.normal(size=4) * draw.choice([0, 0.1, 0.5])).tolist())
            for i in range(150)] + odd_rows()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in multi_index.near_duplicates(df, target=1.0).collect()]
    assert sorted(got, key=key) == sorted(plain_links(rows, 0.95), key=key)
    assert multi_index.near_duplicates(df.limit(0)).collect() == []


def test_query_recall_on_the_sample(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select(
        "vec_id", "embedding").collect()]
    got = {tuple(r) for r in QUERIES["op8_multi_index"](spark, small).collect()}
    want = set(plain_links(rows, 0.95))
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)


def test_recall_of_the_calibrated_index():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(300, 32))
    rows = multi_index.unit(np.repeat(centres, 20, axis=0) + 0.15 * draw.normal(size=(6000, 32)))
    index = multi_index.fit_index(rows[::2], len(rows), 0.95)
    a, b = np.nonzero(np.triu(rows @ rows.T >= 0.95, 1))
    cells, own = index.visited(rows, index.visits), index.visited(rows, 1)
    met = (cells[a] == own[b]).any(axis=1) | (cells[b] == own[a]).any(axis=1)
    assert len(a) > 1000 and met.mean() >= 0.95
    assert index.visits < len(index.books[0]) ** 2 / 2
