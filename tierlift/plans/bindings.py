"""The operators' inputs, built from the sample star schema.

customer = entity, distinct part name bought = item, order value = metric, nation =
region, market segment = locality; an order is a basket; a document is a raw profile.
Entities and links feed most queries, so they are stored once per session and folder, like
the tables of a full run; each pass reads the columns it needs.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.operators.graph import cooccurrence_edges, top_items
from tierlift.operators.item_stats import item_statistics
from tierlift.operators.normalise import with_label
from tierlift.operators.bundles import mine_bundles
from tierlift.functions.text import normalise_text
from tierlift.params import DEFAULTS
from tierlift.session import cut_lineage, spread
from tierlift.sources.raw_json import type_records
from tierlift.sources.tables import read_table

_shared: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, build, keep=None) -> DataFrame:
    """Build a shared input once per session and folder: persisted, or kept by ``keep``."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _shared:
        df = build()
        _shared[key] = keep(df) if keep else df.persist(StorageLevel.MEMORY_AND_DISK)
    return _shared[key]


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", list(columns) or ["*"])


def links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer and part name bought."""
    def build() -> DataFrame:
        part = table(spark, sf, "part", "p_partkey", "p_name")
        ids = part.groupBy(F.col("p_name").alias("item_name")).agg(
            F.min("p_partkey").alias("item_id"))
        orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
        lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
        bought = (
            lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("entity_id"), F.col("p_name").alias("item_name"))
            .distinct())
        return bought.join(ids, "item_name").select("entity_id", "item_id", "item_name")
    return once(spark, sf, "links", build, cut_lineage)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        spend = (
            table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey")
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                 .alias("metric"),
                 F.max("o_totalprice").alias("rate"),
                 F.count(F.lit(1)).alias("event_count")))
        items = links(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("item_count"))
        customer = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
        nation = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
        zero = F.lit(0).cast("bigint")
        base = (
            customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(spend, F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(items, F.col("c_custkey") == F.col("entity_id"), "left")
            .select(F.col("c_custkey").alias("entity_id"),
                    F.coalesce("n_name", F.lit("Unknown")).alias("region"),
                    F.coalesce("c_mktsegment", F.lit("Unknown")).alias("locality"),
                    F.coalesce("metric", F.lit(0.0)).alias("metric"),
                    F.coalesce("rate", F.lit(0.0)).alias("rate"),
                    F.coalesce("event_count", zero).alias("event_count"),
                    F.coalesce("item_count", zero).alias("item_count"),
                    F.col("n_nationkey").cast("double").alias("latitude"),
                    F.col("n_regionkey").cast("double").alias("longitude")))
        return with_label(base)
    return once(spark, sf, "entities", build, cut_lineage)


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order and part name: the links of the co-occurrence graph."""
    def build() -> DataFrame:
        part = table(spark, sf, "part", "p_partkey", "p_name")
        lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("entity_id"),
            F.col("p_name").alias("item_name")).distinct()
    return once(spark, sf, "baskets", build, cut_lineage)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Basket edges of at least the documented minimum weight."""
    def build() -> DataFrame:
        held = baskets(spark, sf)
        counts = held.groupBy("item_name").agg(F.count(F.lit(1)).alias("entity_count"))
        return cooccurrence_edges(held, top_items(counts))
    return once(spark, sf, "edges", build, cut_lineage)


def item_stats(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "item_stats",
                 lambda: item_statistics(entities(spark, sf), links(spark, sf)), cut_lineage)


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, and triples that extend the most frequent pairs, as the SQL has it."""
    return once(spark, sf, "bundles", lambda: mine_bundles(
        entities(spark, sf), links(spark, sf), seeds=DEFAULTS.triple_seed_pairs), cut_lineage)


def all_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """All frequent pairs and triples."""
    return once(spark, sf, "all_bundles",
                 lambda: mine_bundles(entities(spark, sf), links(spark, sf)), cut_lineage)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in normal form; quality 1 is the label, null where there is none."""
    def build() -> DataFrame:
        marks = table(spark, sf, "labels", "doc_id", "quality")
        texts = spread(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
        return texts.join(marks, "doc_id", "left").select(
            "doc_id", (F.col("quality") == 1).alias("label"),
            normalise_text(F.col("text")).alias("clean"))
    return once(spark, sf, "documents", build, cut_lineage)


def document_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one raw JSON record: ``(doc_id, file, pos, json)``.

    Words of the whole text are the items (words of four or more characters are
    explicit) and lines are the children.
    """
    docs = spread(table(
        spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars"), "doc_id", "text")
    n_lines = F.size(F.split("text", "\n")).cast("string")
    record = F.struct(
        F.concat("source", F.lit("-"), "lang").alias("user_id"),
        F.concat(F.lit("  "), F.col("lang"), F.lit(" \t")).alias("username"),
        F.lit("").alias("public_name"),
        F.col("lang").alias("country"),
        F.col("source").alias("city"),
        F.concat(F.col("n_chars").cast("string"), F.lit(".5")).alias("hourlyrate"),
        F.col("n_chars").alias("total_earnings"),
        F.concat(n_lines, F.lit(".7")).alias("no_reviews"),
        F.struct((F.col("doc_id") * 0.5).alias("lat"),
                 F.when(F.col("lang") != "fr", F.col("doc_id") * 0.25).alias("lon"))
        .alias("location"),
        F.transform(F.split("text", " "), lambda w, i: F.struct(
            i.alias("skill_id"), w.alias("skill_name"),
            (F.length(w) >= 4).alias("is_user_skill"))).alias("skills"),
        F.col("text").alias("user_profile"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("source")).alias("tagline"),
        F.transform(F.split("text", "\n"), lambda t: F.struct(
            t.alias("title"), F.lit("").alias("description"))).alias("portfolios"),
    )
    page = F.floor(F.col("doc_id") / 100)
    return docs.select(
        "doc_id", F.lpad(page.cast("string"), 12, "0").alias("file"),
        (F.col("doc_id") - page * 100).cast("int").alias("pos"),
        F.to_json(record).alias("json"))


def raw_variants(spark: SparkSession, sf: str) -> DataFrame:
    return document_json(spark, sf).select(
        "doc_id", "file", "pos", F.parse_json("json").alias("rec"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed raw records, keyed by source and language (so keys repeat).

    Staged once as a stored table: later passes then read only the columns they need.
    """
    return once(spark, sf, "records",
                 lambda: type_records(raw_variants(spark, sf).drop("doc_id")), cut_lineage)


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed raw records with the document id as the key: nothing repeats."""
    number = F.col("file").cast("bigint") * 100 + F.col("pos")
    return records(spark, sf).withColumn("entity_id", number)
