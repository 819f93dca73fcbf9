"""Spliced token counts against the tokenizers library on whole texts."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierlift.llm import token_counts as tc
from tierlift.llm.queries import QUERIES, TOKENIZER, WORD_TOKENIZER

PARTS = ["a", "The", "don't", "'s", "é", "é", "ß", "İ", "日本", "😀", "1", "23", "...", "$",
         "<|endoftext|>", "<|startoftext|>", "<|endof", "̸", "́", "=", "aaaa", "ing",
         "ΑΣ", "\x00", "\xa0", " ", "\u0085", "ﬁ", "각", "가"]
SPACES = [" ", "  ", "\n", "\t", " \r\n ", "\x0b", "\x0c"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def some_text(rnd, n, spaces):
    return "".join(rnd.choice(SPACES) if rnd.random() < spaces else rnd.choice(PARTS)
                   for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (40, 1), (300, 64)])
def test_counts_are_those_of_whole_texts(spark, library, chunk, overlap):
    rnd = random.Random(chunk + overlap)
    texts = [None, "", " ", "\n" * 500, "x" * 3000, "<|endoftext|>" * 60, "word " * 900,
             "é" * 400, "a ́" * 200, "'" * 500, "'s " * 200]
    texts += [some_text(rnd, rnd.randint(0, 400), rnd.choice([0.01, 0.1, 0.4, 0.9]))
              for _ in range(150)]
    texts += texts[-5:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = tc.count_tokens(docs.repartition(4), WORD_TOKENIZER, limit=100, chunk=chunk,
                          overlap=overlap).collect()
    assert len(got) == len(texts)
    for r in got:
        text = r["text"] or ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"]) == (want, len(text.encode())), repr(text[:80])
        assert r["over_limit"] == (want > 100)


def test_neighbours_splice_where_they_agree(library):
    rnd = random.Random(5)
    text = some_text(rnd, 3000, 0.2)
    counter, border = tc.counter(WORD_TOKENIZER), 1000
    left, right = text[:border + 200], text[border:]
    (_, tail, _), (head, _, total) = counter.splices([left, right], [border, 10 ** 9])
    assert head[0] == tail[0] - border > 0
    assert tail[1] + total - head[1] == len(library.encode(text, add_special_tokens=False))


def test_huge_text_without_white_space_is_widened_to_one_chunk(spark, library, monkeypatch):
    rounds = []
    chunks = tc._chunks
    monkeypatch.setattr(tc, "_chunks", lambda t, c, o: rounds.append((c, o)) or chunks(t, c, o))
    text = "añb7" * 3000
    docs = spark.createDataFrame([(1, text), (2, "some words " * 2000)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(
        docs, WORD_TOKENIZER, chunk=1000, overlap=16).collect()}
    assert got == {1: len(library.encode(text).ids), 2: 4000}
    assert len(rounds) > 2 and rounds[-1][0] >= len(text)


def test_long_copies_extra_columns_and_empty_tables(spark, library):
    text = "some words, and more: " * 4000
    docs = spark.range(30).select(
        (F.col("id") % 3).alias("doc_id"), F.lit(text).alias("text"), F.lit(1).alias("N_tokens"),
        F.lit("k").alias("key"), F.lit("r").alias("row"), F.lit(2).alias("a.b"))
    got = tc.count_tokens(docs, WORD_TOKENIZER, keep_text=False)
    assert got.columns == ["doc_id", "key", "row", "a.b", "n_bytes", "n_tokens", "over_limit"]
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert [tuple(r) for r in got.distinct().orderBy("doc_id").collect()] == [
        (i, "k", "r", 2, len(text), want, True) for i in range(3)]
    assert got.count() == 30
    assert tc.count_tokens(docs.where("doc_id > 5"), WORD_TOKENIZER).collect() == []


def test_other_tokenizers_are_not_spliced(spark):
    with open(TOKENIZER, encoding="utf-8") as f:
        assert not tc.splices_at_spaces(json.load(f))
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    assert tc.splices_at_spaces(spec)
    spec["added_tokens"][0]["lstrip"] = True
    assert not tc.splices_at_spaces(spec)
    text = "a  b c " * 9000
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    t = Tokenizer.from_file(TOKENIZER)
    assert tc.count_tokens(docs, TOKENIZER).first()["n_tokens"] == len(t.encode(text).ids)


def test_query_over_the_whole_table(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op13_resynchronised_counts"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (
            len(texts[r["doc_id"]].encode()), n, n > 2048)
