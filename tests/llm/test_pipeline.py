"""The pipeline's stages on the sample, each against its own input."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_lines import plain_removal
from tests.llm.test_shingles import plain_kept
from tierlift.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], small).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "lines", "near_duplicates", "mixture", "tokens"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]
    assert stages[-1].columns == ["doc_id", "source", "n_tokens", "ids"]


def test_quality_keeps_the_good(spark, small, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    marks = spark.read.parquet(f"{small}/labels.parquet").collect()
    assert np.mean([m.doc_id in kept for m in marks if m.quality == 1]) > 0.95
    assert np.mean([m.doc_id in kept for m in marks if m.quality == 0]) < 0.2


def test_lines_near_duplicates_and_tokens(stages):
    rows = sorted(map(tuple, stages[1].select("doc_id", "text").collect()))
    want = {i: t for i, t, *_ in plain_removal(rows)}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    rows = sorted((i, t) for i, (t, _) in got.items())
    kept = sorted(r.doc_id for r in stages[3].select("doc_id").collect())
    assert kept == plain_kept(rows)[0]

    mixed = Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    assert set(mixed) <= set(kept)
    library, text_of = Tokenizer.from_file(TOKENIZER), dict(rows)
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == mixed
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(
            text_of[r.doc_id], add_special_tokens=False).ids


def test_odd_rows_and_columns(spark, small):
    """Null ids and texts, repeated rows, and a column named like the outputs of operators."""
    rows = [(None, "no id and some words " * 9, "en", "a", 3, 1.0), (7, None, None, None, None, None),
            (8, "the same text of a few words " * 9, "en", "a", 9, 2.0),
            (8, "the same text of a few words " * 9, "en", "a", 9, 2.0),
            (9, "\n\n \n", "en", None, 4, None)]
    start = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept double")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, start, small)
        names = start.columns if "ids" not in docs.columns else docs.columns
        assert docs.columns == names and docs.count() >= 0
    lines = corpus_pipeline.first_lines(spark, start, small).collect()
    assert len(lines) == 5 and sum(bool(r.text) for r in lines) == 3
    kept = corpus_pipeline.one_of_each_group(spark, start, small).collect()
    assert sorted(r.doc_id is None for r in kept) == [False, False, True]


def test_empty_corpus(spark, small, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
        docs = docs if "text" not in docs.columns else spark.createDataFrame([], docs.schema)
