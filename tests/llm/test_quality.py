"""The quality classifier by held-out accuracy and on odd input."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierlift.llm import quality
from tierlift.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"


def some_docs(n=400):
    draw = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(n):
        good = bool(draw.random() < 0.7)
        words = ["".join(draw.choice(list("abcdefghijk"), size=draw.integers(2, 9)))
                 for _ in range(draw.integers(30, 90))]
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        rows.append((i, text, "en", "good" if good and draw.random() < .8 else "any",
                     len(text), "x"))
        marks.append((i, int(good)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = some_docs()
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks[:150], "doc_id bigint, quality int")
    model = quality.train(docs, labels, per_round=50)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    rest = marks[150:]
    assert np.mean([got[i].kept == bool(g) for i, g in rest]) > 0.97
    assert np.mean([got[i].kept for i, g in rest if g]) > 0.98
    # The metadata alone tell something, the text more.
    meta = [(got[i].meta_score > 0.5) == bool(g) for i, g in rest]
    assert np.mean(meta) >= 0.7
    assert all(0 <= r.quality_score <= 1 and isinstance(r.kept, bool) for r in got.values())


def test_pseudo_labels_come_from_the_other_view(spark, monkeypatch):
    rows, marks = some_docs()
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks[:60], "doc_id bigint, quality int")
    seen, run = [], quality._surest

    def watched(views, text, meta, per_round):
        out = run(views, text, meta, per_round)
        seen.append(out)
        return out

    monkeypatch.setattr(quality, "_surest", watched)
    quality.train(docs, labels, per_round=20)
    assert len(seen) == quality.ROUNDS
    for t in seen:
        ids = t.column("doc_id").to_pylist()
        assert ids and min(ids) >= 60  # none that has a label
        groups = list(zip(t.column("view").to_pylist(), t.column("good").to_pylist()))
        assert max(map(groups.count, set(groups))) <= 20


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, None), (2, 5), (None, 0), (99, 0)]])
def test_without_two_classes_all_stay(spark, marks):
    docs = spark.createDataFrame([(1, None, None, None, None, None), (2, "a b", "en", "s", 3, "y"),
                                  (2, "a b", "en", "s", 3, "y")], DOCS)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert [(r.doc_id, r.quality_score, r.kept) for r in sorted(got, key=lambda r: r.doc_id)] == [
        (1, 1.0, True), (2, 1.0, True), (2, 1.0, True)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, None), (None, "", "", "", -5, None), (3, "x" * 300000, "en",
         None, 1, "y"), (4, " \n\t", "de", "s", 10 ** 15, "y"), (4, "A!! B!!", "de", "s", 7, "y"),
         (5, "plain words here", "en", "s", 9, "z")], DOCS)
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 1), (4, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "kept"] + quality.OUTPUTS
    values = got.collect()
    assert len(values) == 6 and all(math.isfinite(r.quality_score) for r in values)
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.train(docs.limit(0), labels) is None


def test_features_are_finite():
    found = quality.text_features(pa.array(["", " ", "a a a", "É ü 漢字", "z" * 70000]))
    assert np.isfinite(found).all() and (found >= 0).all()


def test_query_on_the_sample(spark, small):
    got = QUERIES["op7_cotraining"](spark, small)
    marks = spark.read.parquet(f"{small}/labels.parquet")
    rows = got.join(marks, "doc_id").select("kept", (F.col("quality") == 1).alias("good")).collect()
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert np.mean([r.kept == r.good for r in rows]) > 0.9
    assert np.mean([r.kept for r in rows if r.good]) > 0.95
