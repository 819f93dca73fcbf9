"""Piece tables against plain string slicing, and exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierlift.llm import fill_middle as fm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "a", "<", "<P>", "x<M>y", "<P", "P>", "<<S", "é😀日本\r\n", "a" * 3_000_000,
       "S><P><", "ﬁ́", "<S", ">>"]


def test_documents_are_those_of_string_slices(spark):
    texts = ODD + [f"text {i} é😀" * (i % 7) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = fm.restore(fm.arrange(docs)).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        n, form, prefix, middle, output = by_hand(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output"] == output and r["output_sha256"] == sha(output)
        assert r["restored"] == (r["text"] or "") and r["restored_sha256"] == sha(r["restored"])
        buffers = fm.Rule().buffers(r["text"] or "")
        assert "".join(buffers[p["buffer"]][p["start"]:p["start"] + p["length"]]
                       for p in r["pieces"]) == output
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSMab", max_size=30), st.integers(0, 40), st.integers(0, 40),
       st.sampled_from(["psm", "spm"]))
def test_inverse_permutation_restores(text, a, b, form):
    rule = fm.Rule()
    if not text or rule.in_text(text):
        return
    a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    pieces = fm.permuted(form, fm.parts(len(text), a, b), rule)
    assert all(length for _, _, length in pieces)
    output = "".join(fm.written(pieces, rule.buffers(text)))
    assert "".join(fm.written(fm.original(output, form, rule), (output,))) == text


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "some text", 7, "x", True)],
        "doc_id bigint, text string, N int, row string, `a.b` boolean")
    got = fm.restore(fm.arrange(docs))
    assert got.columns == ["doc_id", "text", "row", "a.b", "n", "form", "prefix_chars",
                           "middle_chars", "pieces", "output", "output_sha256", "restored",
                           "restored_sha256"]
    row = got.first()
    assert row["row"] == "x" and row["a.b"] is True and row["n"] == 9
    assert got.where("false").count() == 0
    assert fm.restore(fm.arrange(docs.where("doc_id > 5"))).collect() == []
    bare = spark.createDataFrame([("t",)], "output string").withColumn("form", F.lit(None).cast("string"))
    assert fm.restore(bare).first()["restored"] == "t"


def test_other_rules(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("words of text").alias("text"))
    rule = fm.Rule("⟨pre⟩", "⟨suf⟩", "⟨mid⟩", rewritten=50, spm=100, seed=3)
    got = fm.restore(fm.arrange(docs, rule), rule).collect()
    assert {r["restored"] for r in got} == {"words of text"}
    forms = [r["form"] for r in got]
    assert set(forms) == {"plain", "spm"} and 100 < forms.count("plain") < 200
    for marks in (("<P>", "<P>x", "<M>"), ("", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fm.Rule(*marks)
