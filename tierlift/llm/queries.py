"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.llm import (
    bpe, conversation_trie, fill_middle, lines, mixing, multi_index, pii, quality, repeats,
    simhash, sorted_lists, token_counts, token_files)
from tierlift.llm.common import table
from tierlift.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), folder, TOKENIZER, END_ID)
    return token_files.document_checksums(spark, folder)


def op2_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.remove_repeated_lines(docs, n_lines="n_lines", n_removed="n_removed")


def op3_previous_factors(spark: SparkSession, sf: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf, "documents"), window=100)
    length = F.aggregate("removed", F.lit(0).cast("bigint"),
                         lambda n, r: n + r.getField("end") - r.getField("start"))
    return found.select("doc_id", "n_bytes", length.alias("n_removed"),
                        F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def op4_poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    mixed = mixing.mix_sources(docs, mixing.tempered_targets(docs))
    return mixed.select("doc_id", "source", "text", "copy", "n_copies", "place")


def op5_disclosing_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.sanitise(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x.getField("kind"), x.getField("start").cast("string"),
            x.getField("end").cast("string"))), ",")

    def count(kind: str):
        held = F.filter("base_spans", lambda x: x.getField("kind") == kind)
        return F.size(held).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "term_spans")).alias("spans"))


def op6_trie_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER, decoded="decoded", keep_text=False)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_cotraining(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.score(docs, model).select("doc_id", *quality.OUTPUTS)


def op8_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf, "embeddings"), threshold=0.95)


def op9_sorted_lists(spark: SparkSession, sf: str) -> DataFrame:
    vectors = sorted_lists.scaled(table(spark, sf, "embeddings"), 256)
    return sorted_lists.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf, "documents"), words=4, radius=4)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def op11_piece_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    restored = fill_middle.restore(fill_middle.arrange(docs))
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                           "output_sha256", "restored_sha256")


def op12_vertical_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(table(spark, sf, "conversations"))
    return conversation_trie.trie(*conversation_trie.rebuilt(turns, family=20, heads=4))


def op13_resynchronised_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_TOKENIZER, limit=2048, keep_text=False).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_previous_factors": op3_previous_factors,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_disclosing_terms": op5_disclosing_terms,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_cotraining": op7_cotraining,
    "op8_multi_index": op8_multi_index,
    "op9_sorted_lists": op9_sorted_lists,
    "op10_covering_simhash": op10_covering_simhash,
    "op11_piece_table": op11_piece_table,
    "op12_vertical_bitmaps": op12_vertical_bitmaps,
    "op13_resynchronised_counts": op13_resynchronised_counts,
}

OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (
    SELECT query_id, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE = {
    "op4_poisson_mixing": mixing.ORACLE_SQL,
    "op9_sorted_lists": OP9_SQL,
    "op11_piece_table": fill_middle.ORACLE_SQL,
    "op12_vertical_bitmaps": conversation_trie.ORACLE_SQL,
}
