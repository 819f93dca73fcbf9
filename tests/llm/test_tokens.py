"""Token files and the trie encoder against the tokenizers library."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierlift.llm import bpe, pieces, token_files
from tierlift.llm.queries import END_ID, QUERIES, TOKENIZER

PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "é", "ß", "日本", "😀",
         "<|endoftext|>", "1", "23", "...", "$", "aaaa", "the", "ing", "\x00", "\x1f", "\xa0", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def some_texts(n=1500):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + [
        "", " ", "\n\n", "word " * 5000, "x" * 30000]


def encoded(library, texts):
    return [np.array(e.ids, "<u4").tobytes()
            for e in library.encode_batch(texts, add_special_tokens=False)]


def test_both_encoders_give_the_library_ids(library):
    texts = some_texts()
    want = encoded(library, texts)
    trie, whole = bpe.trie_encoder(TOKENIZER), token_files.library_encoder(TOKENIZER)
    assert [bytes(x) for x in trie.encode(pa.array(texts))] == want
    assert [bytes(x) for x in pieces.encode_texts(
        pa.array(texts), whole.pieces, whole.whole, whole.special, None)] == want
    for text, ids in zip(texts, want):
        assert trie.decode(np.frombuffer(ids, "<u4")).decode() == library.decode(
            np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    trie = bpe.trie_encoder(TOKENIZER)
    t = Tokenizer.from_file(TOKENIZER)
    ids = np.frombuffer(bytes(trie.encode(pa.array([text]))[0]), "<u4").tolist()
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert trie.decode(np.array(ids, "<u4")).decode() == t.decode(ids, skip_special_tokens=False)


def test_memo_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 50)
    trie, texts = bpe.TrieEncoder(TOKENIZER), some_texts(60)[:60]
    first = [bytes(x) for x in trie.encode(pa.array(texts))]
    assert [bytes(x) for x in trie.encode(pa.array(texts))] == first


def test_files_hold_the_documents_in_order(spark, tmp_path, library):
    texts = some_texts(300)
    rows = [(i * 7 % 311, t, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", "x"), (5, None, "x"), (5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(docs.repartition(6), folder, TOKENIZER, END_ID)
    got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] + sorted(i for i, *_ in rows if i is not None)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids[-1] == END_ID
        at += len(r.ids)
    want = sorted([*np.frombuffer(x, "<u4").tolist(), END_ID]
                  for x in encoded(library, [t or "" for _, t, _ in rows]))
    assert sorted(r.ids for r in got) == want
    sums = token_files.document_checksums(spark, folder).collect()
    assert {(r.start, r.ids_crc32) for r in sums} == {
        (r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    # The files are flat: all parts one after the other are the whole sequence.
    parts = token_files.read_manifest(spark, folder).orderBy("part").collect()
    flat = np.concatenate([np.memmap(f"{folder}/{p.file}.tokens", dtype=f"<u{p.width}")
                           for p in parts])
    assert flat.tolist() == [i for r in got for i in r.ids] and parts[0].width == 2


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write_token_files(docs, str(tmp_path / "none"), TOKENIZER, END_ID)
    assert token_files.read_documents(spark, str(tmp_path / "none")).collect() == []
    assert bpe.encode(docs, TOKENIZER).collect() == []


def test_trie_query_and_columns(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op6_trie_bpe"](spark, small).collect()}
    first = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, small).collect()}
    at = 0
    for (i, text), ids in sorted(zip(docs, encoded(library, [t or "" for _, t in docs]))):
        one = ids + np.array([END_ID], "<u4").tobytes()
        assert (first[i].start, first[i].n_tokens, first[i].ids_crc32) == (
            at, len(one) // 4, zlib.crc32(one))
        assert got[i].n_tokens == len(ids) // 4
        at += len(one) // 4
    odd = spark.createDataFrame([(1, None, "keep", "old"), (1, "a b", "keep", "old")],
                                "doc_id bigint, text string, row string, ids string")
    coded = bpe.encode(odd, TOKENIZER, decoded="decoded")
    assert coded.columns == ["doc_id", "text", "row", "ids", "decoded"]
    assert {(r.text, r.decoded, r.row) for r in coded.collect()} == {
        (None, "", "keep"), ("a b", "a b", "keep")}
    assert coded.select(F.octet_length("ids")).distinct().count() == 2


def test_memory_of_an_encoder_is_bounded(library):
    """Its tables, and what a slice of many different words takes besides the ids and memos."""
    rnd = random.Random(3)
    texts = ["".join(f" {rnd.randrange(36 ** 6):x}" for _ in range(200)) for _ in range(4_000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    tracemalloc.start()
    try:
        trie = bpe.TrieEncoder(TOKENIZER)
        tables = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        slices = [*bpe.text_slices(iter([batch]), "text", bpe.SLICE_BYTES)]
        ids = [bytes(x) for x in trie.encode(slices[0].column("text"))]
        peak = tracemalloc.get_traced_memory()[1] - tables
    finally:
        tracemalloc.stop()
    assert tables < 50 << 20
    assert len(slices) > 1 and peak < 150 << 20
    assert ids[:20] == encoded(library, texts[:20])
