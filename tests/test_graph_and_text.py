import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tierlift.operators import graph, text_terms
from tierlift.session import broadcast_if_small, cut_lineage, shared_dir, spread


def edge_table(spark, edges):
    rows = [(min(a, b), max(a, b), w) for a, b, w in edges]
    return spark.createDataFrame(rows, "source string, target string, weight long")


def brute_paths(edges, unit=False):
    """All shortest paths between all pairs by plain enumeration."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = 1 if unit else w
        near.setdefault(b, {})[a] = 1 if unit else w
    best = {}

    def walk(start, node, length, seen):
        if node != start:
            found = best.setdefault((start, node), [math.inf, []])
            if length < found[0]:
                found[0], found[1] = length, [seen]
            elif length == found[0]:
                found[1].append(seen)
        for nxt, w in near[node].items():
            if nxt not in seen:
                walk(start, nxt, length + w, (*seen, nxt))

    for s in near:
        walk(s, s, 0, (s,))
    return near, best


@pytest.mark.parametrize("seed", [1, 2])
def test_centralities_equal_enumeration(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    edges = [(x, y, rng.randint(1, 3)) for x, y in combinations(names, 2) if rng.random() < 0.45]
    edges += [("x", "y", 2), ("y", "z", 2)]  # a second component
    near, best = brute_paths(edges)
    n = len(near)
    want = dict.fromkeys(near, 0.0)
    for (s, t), (_, paths) in best.items():
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1.0 / len(paths) / ((n - 1) * (n - 2))
    table = edge_table(spark, edges)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(table).collect()}
    assert got == pytest.approx(want, abs=1e-12)

    _, hops = brute_paths(edges, unit=True)
    close = {r["node"]: r["closeness"] for r in graph.closeness(table).collect()}
    for v in near:
        reach = [d for (s, _), (d, _) in hops.items() if s == v]
        assert close[v] == pytest.approx(len(reach) / sum(reach) * len(reach) / (n - 1))
    degree = {r["node"]: (r["degree"], r["weighted_degree"])
              for r in graph.degrees(table).collect()}
    assert degree == {v: (len(x), sum(x.values())) for v, x in near.items()}


def plain_modularity(edges, community):
    two_m = 2.0 * sum(w for _, _, w in edges)
    inside, total = Counter(), Counter()
    for a, b, w in edges:
        total[community[a]] += w
        total[community[b]] += w
        if community[a] == community[b]:
            inside[community[a]] += 2 * w
    return sum(inside[c] / two_m - (total[c] / two_m) ** 2 for c in total)


def test_planted_communities_are_recovered(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(24)]
    block = {v: i // 8 for i, v in enumerate(names)}
    edges = []
    for a, b in combinations(names, 2):
        if block[a] == block[b] and rng.random() < 0.9:
            edges.append((a, b, rng.randint(5, 9)))
        elif rng.random() < 0.05:
            edges.append((a, b, 1))
    table = edge_table(spark, edges)
    partition = graph.communities(table)
    found = {r["node"]: r["community"] for r in partition.collect()}
    assert len(set(found.values())) == 3
    assert len({(block[v], found[v]) for v in names}) == 3
    q = graph.modularity(table, partition).first()["modularity"]
    assert q == pytest.approx(plain_modularity(edges, found))
    assert q > plain_modularity(edges, {v: v for v in names})


def rounds_of(monkeypatch):
    rounds, run = [], graph._trials
    monkeypatch.setattr(graph, "_trials", lambda *a: rounds.append(1) or run(*a))
    return rounds


def test_a_hub_takes_its_leaves_in_few_rounds(spark, monkeypatch):
    table = spark.createDataFrame(
        [("hub", f"leaf{i:03}", 1) for i in range(300)], "source string, target string, weight long")
    rounds = rounds_of(monkeypatch)
    partition = graph.communities(table)
    assert partition.select("community").distinct().count() == 1
    assert len(rounds) <= 36


def test_a_dense_graph_of_near_equal_weights_takes_few_rounds(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(f"n{a:02}", f"n{b:02}", rng.randint(100, 119)) for b in range(64) for a in range(b)]
    table = spark.createDataFrame(edges, "source string, target string, weight long")
    rounds = rounds_of(monkeypatch)
    found = {r["node"]: r["community"] for r in graph.communities(table).collect()}
    assert len(rounds) <= 36
    q = plain_modularity(edges, found)
    assert q >= max(0.0, plain_modularity(edges, {v: v for v in found}))
    # No single move gains.
    assert graph.gaining_moves(table, spark.createDataFrame(
        list(found.items()), "node string, community bigint")).isEmpty()
    for v in found:
        for c in set(found.values()):
            assert plain_modularity(edges, found | {v: c}) <= q + 1e-8


@pytest.mark.parametrize("seed", [1, 2])
def test_no_round_lowers_modularity(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(f"n{a:02}", f"n{b:02}", rng.randint(1, 9)) for a in range(30) for b in range(a)
            if rng.random() < (0.6 if a % 3 == b % 3 else 0.1)]
    table = spark.createDataFrame(
        [(min(a, b), max(a, b), w) for a, b, w in rows], "source string, target string, weight long")
    seen, run = [], graph._trials

    def watched(state, *args):
        if len(seen) < 8:  # the first level, where nodes are the graph's own
            seen.append(graph.modularity(table, state.select("node", "community")).first()[0])
        return run(state, *args)

    monkeypatch.setattr(graph, "_trials", watched)
    level, stable = [], graph._move_until_stable

    def first_level(*args):
        out = stable(*args)
        level.append(len(seen))
        if len(level) == 1:
            seen.extend([None] * 8)
        return out

    monkeypatch.setattr(graph, "_move_until_stable", first_level)
    partition = graph.communities(table)
    first = [q for q in seen[:level[0]]]
    assert len(first) > 1 and all(b >= a - 1e-12 for a, b in zip(first, first[1:]))
    assert graph.modularity(table, partition).first()[0] >= first[-1] - 1e-12
    some = spark.createDataFrame([("n01",), ("n02",)], "node string")
    every = {r.node: r.closeness for r in graph.closeness(table).collect()}
    assert {r.node: r.closeness for r in graph.closeness(table, some).collect()} == {
        n: every[n] for n in ("n01", "n02")}


def test_subgraph_keeps_heavy_edges_between_members(spark):
    table = edge_table(spark, [("a", "b", 5), ("a", "c", 9), ("b", "c", 1)])
    members = spark.createDataFrame([("a",), ("b",)], "node string")
    assert [tuple(r) for r in graph.subgraph(table, members, 5).collect()] == [("a", "b", 5)]


def test_stored_cuts_live_below_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and sorted(cut.collect()) == sorted(df.collect())
    assert all(folder.split(":")[-1] in f for f in cut.inputFiles())


def test_spread_only_when_splits_are_few(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, cores * 2)
    assert spread(few, "id").rdd.getNumPartitions() == cores
    assert spread(many, "id").rdd.getNumPartitions() == cores * 2


def test_terms_are_counted_in_parts_that_grow_with_the_documents(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit(True).alias("label"), F.lit("welding glazing").alias("clean"))
    terms = text_terms.document_terms(docs)
    assert terms.rdd.getNumPartitions() >= 20
    held = terms.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 12_000
    weights = text_terms.tfidf(terms, spark.createDataFrame([("welding", 40_000)], "term string, df long"), 40_000)
    assert weights.rdd.getNumPartitions() >= 20 and weights.count() == 40_000


def test_spread_makes_more_parts_of_a_larger_table(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("x"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    parts = spread(spark.read.parquet(str(tmp_path / "t")), "id", "x")
    held = parts.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 60_000 and max(r["count"] for r in held) < 4_000


def test_broadcast_hint_only_below_the_limit(spark):
    df = spark.range(10)
    hinted = broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_tfidf_rows_have_unit_length_and_known_weights(spark):
    texts = ["apple banana apple", "banana cherry", "apple cherry cherry", ""]
    docs = spark.createDataFrame(
        [(i, i < 2, t) for i, t in enumerate(texts)], "doc_id long, label boolean, clean string")
    terms = text_terms.document_terms(docs, stop=["cherry"])
    vocab = text_terms.vocabulary(terms, 4, 100, 1, 1.0)
    counts = {r["term"]: (r["df"], r["total"]) for r in vocab.collect()}
    assert counts["apple"] == (2, 3) and counts["banana apple"] == (1, 1)
    assert "cherry" not in counts
    weights = {}
    for r in text_terms.tfidf(terms, vocab, 4).collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for w in weights.values():
        assert sum(x * x for x in w.values()) == pytest.approx(1.0)
    idf = {t: math.log(5 / (1 + df)) + 1 for t, (df, _) in counts.items()}
    raw = {"apple": (1 + math.log(2)) * idf["apple"], "banana": idf["banana"],
           "apple banana": idf["apple banana"], "banana apple": idf["banana apple"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert weights[0] == pytest.approx({k: v / norm for k, v in raw.items()})


def test_topics_are_complete_and_empty_documents_fall_to_the_first(spark):
    rows = [(i, i % 2 == 0, ("red green " if i % 2 else "cat dog ") * 5) for i in range(40)]
    rows.append((99, False, ""))
    docs = spark.createDataFrame(rows, "doc_id long, label boolean, clean string")
    model, vocab, shares = text_terms.fit_topics(docs, n_topics=3, min_df=2, max_df=0.9)
    meta = docs.select("doc_id", "label", F.lit(2.0).alias("metric"))
    table = text_terms.topic_table(model, vocab, shares, meta).toPandas()
    assert sorted(table.topic_id) == [1, 2, 3] and table.entity_count.sum() == 41
    assert ((table.top_rate >= 0) & (table.top_rate <= 1)).all()
    assert (table.median_metric[table.entity_count == 0] == 0).all()
    empty = text_terms.dominant_topic(shares).where("doc_id = 99").first()
    assert empty["topic"] == 0


def test_stored_terms_are_not_made_again(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, i % 2 == 0, "red apple tree" if i % 2 else "blue apple sky") for i in range(40)],
        "doc_id long, label boolean, clean string")
    stored = cut_lineage(text_terms.document_terms(docs))
    want = text_terms.differential_terms(docs, min_df=2).orderBy("term").collect()
    _, words, _ = text_terms.fit_topics(docs, 2, min_df=2, epochs=1, share=1.0)
    monkeypatch.setattr(text_terms, "document_terms", None)
    assert text_terms.differential_terms(docs, min_df=2, terms=stored).orderBy("term").collect() == want
    assert text_terms.fit_topics(
        docs, 2, min_df=2, epochs=1, share=1.0, terms=stored)[1] == words
