"""Removed bytes against a table of every window's first start."""

import hashlib
import random

import numpy as np
import pytest

from tierlift.llm import repeats
from tierlift.llm.queries import QUERIES


def plain(rows, window=100):
    """Rows in document order: ``(doc_id, bytes, removed runs)``."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            piece = data[i:i + window]
            if piece in seen:
                gone[i:i + window] = b"\1" * window
            seen.add(piece)
        runs, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end]:
                end += 1
            if end > at:
                runs.append((at, end))
            at = max(end, at + 1)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), runs, kept))
    return out


def result(df):
    return sorted(((r.doc_id, r.n_bytes, [(x.start, x.end) for x in r.removed], r.kept_sha256)
                   for r in df.collect()), key=lambda r: (r[0] is not None, r))


def wanted(rows, window=100):
    return sorted(((i, n, runs, hashlib.sha256(k).hexdigest())
                   for i, n, runs, k in plain(rows, window)), key=lambda r: (r[0] is not None, r))


def texts(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh éß"
    passages = ["".join(rnd.choice(letters) for _ in range(n)) for n in
                (90, 99, 100, 101, 110, 130, 150, 200, 400, 1000)]
    out = ["", None, "a" * 99, "a" * 100, "b" * 350, "ab" * 200, passages[3] * 3]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p)) if rnd.random() < 0.4 else 0
            parts.append(p[a:a + rnd.randint(60, 1000)])
            parts.append("".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 3, 40)))))
        out.append("".join(parts))
    return out + [out[9], out[12]]


@pytest.mark.parametrize("seed, limit, spread, cut", [
    (1, 2000, 100, 2 << 20), (2, 2, 100, 3000), (3, 2000, 2, 3000), (4, 0, 3, 1500)])
def test_against_brute_force(spark, monkeypatch, seed, limit, spread, cut):
    monkeypatch.setattr(repeats, "SPREAD", spread)
    monkeypatch.setattr(repeats, "SLICE_BYTES", cut)
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(repeats.remove_repeats(docs, limit=limit)) == wanted(rows)


def test_odd_ids_and_columns(spark):
    long = "".join(random.Random(5).choice("xyz ") for _ in range(300))
    rows = [(7, long), (None, long[50:]), (7, long), (3, long), (None, None)]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows],
                                 "text string, doc_id bigint, removed int")
    got = repeats.remove_repeats(docs, keep_text=True)
    order = [(None, None), (None, long[50:]), (3, long), (7, long), (7, long)]
    assert result(got) == wanted(order)
    assert {bytes(r.kept) for r in got.collect()} == {k for *_, k in plain(order)}
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_ids_in_steps_are_dealt_over_the_groups(spark):
    keys = np.arange(-1000, 100_000) * 256
    groups = np.bincount(repeats._by_key(keys, 256), minlength=256)
    assert groups.min() > 0.5 * groups.mean() and groups.max() < 2 * groups.mean()
    some = keys[::997]
    df = spark.createDataFrame([(int(k),) for k in some], "key bigint")
    got = [r[1] for r in df.select("key", repeats._group_column(256)).collect()]
    assert got == repeats._by_key(some, 256).tolist()
    rows = [(i * 256, t) for i, t in enumerate(texts(5))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(repeats.remove_repeats(docs)) == wanted(rows)


def test_query_on_the_sample(spark, small):
    rows = sorted(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", "text").collect()))
    got = sorted(map(tuple, QUERIES["op3_previous_factors"](spark, small).collect()))
    assert got == [(i, n, sum(e - s for s, e in runs), len(runs), hashlib.sha256(k).hexdigest())
                   for i, n, runs, k in plain(rows)]
