"""Source mixing: Poisson counts, shares, order, odd rows."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tests.compare import differences
from tierlift.llm import mixing
from tierlift.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id bigint, text string, source string, copy string"


def plain_count(doc_id, text, rate):
    key = f"{mixing.SEED}:{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_shares_and_order(spark):
    rows = [(i, "x" * (1 + i % 50), "big" if i % 10 else "small", "c") for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("absent", 1.0)],
                                    "source string, weight double")
    mixed = mixing.mix_sources(docs, targets)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "n_copies", "place"]
    got = mixed.collect()
    rates = {r.source: r.rate for r in mixing.repetition_rates(docs, targets).collect()}
    counts = Counter(r.doc_id for r in got)
    assert all(counts[i] == plain_count(i, t, rates[s]) for i, t, s, _ in rows)
    assert [r.place for r in got] == sorted(r.place for r in got)
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
        assert 1 <= r.copy <= r.n_copies == counts[r.doc_id]
    whole = sum(len(t) for _, t, *_ in rows)
    assert abs(size["small"] / sum(size.values()) - 0.75) < 0.02
    assert abs(sum(size.values()) / whole - 1) < 0.05
    # The order mixes the sources, whatever the input's.
    first = Counter(r.source for r in got[:len(got) // 2])
    assert abs(first["small"] / sum(first.values()) - Counter(
        r.source for r in got)["small"] / len(got)) < 0.05


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (None, "", None, "b"), (2, "text", "s", "c"), (2, "text", "s", "c"),
            (3, "other", "left out", "d")]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([(None, 5.0), ("s", 5.0), ("left out", 0.0)],
                                    "source string, weight double")
    got = mixing.mix_sources(docs, targets).collect()
    assert {r.source for r in got} <= {None, "s"}
    same = [r for r in got if r.doc_id == 2]
    assert len(same) % 2 == 0  # rows that are alike get alike counts
    assert mixing.mix_sources(docs.limit(0), targets).collect() == []
    assert mixing.mix_sources(docs, targets.limit(0)).collect() == []


def test_large_rates(spark):
    docs = spark.createDataFrame([(i, "a", "rare" if i < 3 else "rest", "") for i in range(3000)],
                                 SCHEMA)
    targets = spark.createDataFrame([("rare", 999.0), ("rest", 1.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs, targets).groupBy("source").agg(F.count("*").alias("n"))
    n = {r.source: r.n for r in mixed.collect()}
    assert abs(n["rare"] - 2997) < 250


def test_against_sql(spark, duck, small):
    got = QUERIES["op4_poisson_mixing"](spark, small).toPandas()
    assert differences(got, duck.execute(ORACLE["op4_poisson_mixing"]).fetchdf()) is None
