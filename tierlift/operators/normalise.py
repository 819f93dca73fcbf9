"""Deduplicate raw records, label entities and split them into relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlift.functions.clean import (
    clean_float, clean_int, clean_string, float_or_zero, string_or,
)
from tierlift.functions.naming import joined_text
from tierlift.operators.item_stats import label_count
from tierlift.operators.quantiles import quantile_value
from tierlift.operators.running import running
from tierlift.params import DEFAULTS, UNKNOWN
from tierlift.session import cut_lineage

# Arrivals of this many files form one block of the conflict scan.
FILES_PER_BLOCK = 1024


def keep_best(records: DataFrame, key: str, metric: Column, size: Column,
              arrival: list[str]) -> DataFrame:
    """Per key keep the record with the largest ``(metric, size)``, first seen on ties.

    Only the ordering columns are aggregated (combined before the shuffle, so a hot key
    costs one row per task); the full records are then matched by their unique arrival.
    Read ``records`` from a stored table, so that the first pass prunes columns.
    """
    known = records.where(F.col(key).isNotNull())
    order = F.struct(
        (F.lit(0.0) - F.coalesce(metric, F.lit(0.0))).alias("m"),
        (-F.coalesce(size, F.lit(0)).cast("bigint")).alias("s"),
        *arrival,
    )
    winners = (
        known.select(key, order.alias("o")).groupBy(key).agg(F.min("o").alias("o"))
        .select(key, *[F.col(f"o.{a}").alias(a) for a in arrival])
    )
    return known.join(winners, [key, *arrival], "left_semi")


def conflict_log(records: DataFrame, key: str, metric: Column, size: Column,
                 arrival: list[str], block: Column) -> DataFrame:
    """One row per repeat sighting of a key, in any order.

    ``existing_items`` is the item count of the record kept until then, ``new_items``
    that of the new record. ``block`` cuts arrivals into order-preserving chunks.
    """
    narrow = records.where(F.col(key).isNotNull()).select(
        key, *arrival, block.alias("_block"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("new_items"),
        F.struct(F.coalesce(metric, F.lit(0.0)).alias("m"),
                 F.coalesce(size, F.lit(0)).cast("bigint").alias("s")).alias("_rank"))
    scanned = running(narrow, [key], "_block", arrival, "_rank", "max", "_kept",
                      include_current=False)
    return scanned.where(F.col("_kept").isNotNull()).select(
        key, *arrival, F.col("_kept.s").alias("existing_items"), "new_items")


def with_file_block(records: DataFrame, files_per_block: int = FILES_PER_BLOCK) -> DataFrame:
    """Add ``block``, an order-preserving number for every run of files by name.

    File names are range-sorted across tasks; the ids that follow depend on the range
    bounds, so they are stored before use.
    """
    names = records.select("file").distinct().repartitionByRange("file").sortWithinPartitions(
        "file")
    numbered = cut_lineage(names.select(
        "file", F.monotonically_increasing_id().alias("_no")))
    block = F.floor(F.col("_no") / files_per_block)
    return records.join(numbered.select("file", block.alias("block")), "file")


def conflict_sample(conflicts: DataFrame, arrival: list[str], n: int = 100) -> DataFrame:
    return conflicts.orderBy(*arrival).limit(n)


def top_label(metric: Column, threshold: Column) -> Column:
    return (metric >= threshold) & (metric > 0)


def with_label(entities: DataFrame, quantile: float = DEFAULTS.top_quantile) -> DataFrame:
    """Add ``log_metric`` and ``is_top`` (metric at or above its own quantile).

    The entities are stored first: the threshold then reads one column of the stored
    table instead of deriving every entity once more.
    """
    stored = cut_lineage(entities)
    threshold = quantile_value(stored, "metric", quantile)
    return (
        stored.withColumn("log_metric", F.log1p("metric"))
        .withColumn("is_top", top_label(F.col("metric"), threshold))
    )


def first_spellings(items: Column) -> Column:
    """Explicit items of one record, case-insensitively unique, first spelling kept.

    ``items`` is an array of ``{item_id, item_name, explicit}``. The work stays inside
    the row: sort by (folded name, position), keep the head of each run, restore order.
    """
    named = F.filter(items, lambda s: s["explicit"] & s["item_name"].isNotNull())
    return F.array_sort(F.transform(named, lambda s, i: F.struct(
        F.lower(s["item_name"]).alias("folded"), i.alias("pos"),
        s["item_name"].alias("item_name"), s["item_id"].alias("item_id"))))


def item_links(records: DataFrame) -> DataFrame:
    """``(entity_id, pos, item_id, item_name)``: one row per entity and distinct item.

    ``pos`` is the rank of the explicit mention that was kept.
    """
    ordered = records.select("entity_id", first_spellings(F.col("items")).alias("_s"))
    heads = F.filter(
        "_s",
        lambda s, i: (i == 0) | (s["folded"] != F.col("_s")[F.greatest(i - 1, F.lit(0))]["folded"]))
    return (
        ordered.select("entity_id", F.explode(heads).alias("s"))
        .select("entity_id", F.col("s.pos").alias("pos"),
                clean_int(F.col("s.item_id")).alias("item_id"),
                F.col("s.item_name").alias("item_name"))
    )


def child_rows(records: DataFrame) -> DataFrame:
    """Child rows with 1-based original positions; fully blank children are dropped."""
    return (
        records.select("entity_id", F.posexplode("children").alias("pos", "c"))
        .select("entity_id", (F.col("pos") + 1).cast("bigint").alias("child_id"),
                string_or(F.col("c.title"), F.lit("")).alias("title"),
                string_or(F.col("c.description"), F.lit("")).alias("description"))
        .where((F.col("title") != "") | (F.col("description") != ""))
    )


def assembled_text(records: DataFrame) -> DataFrame:
    """Tagline, profile and child texts joined per record, without a shuffle."""
    child_texts = F.filter(
        F.transform("children", lambda c: joined_text(
            string_or(c["title"], F.lit("")), string_or(c["description"], F.lit("")))),
        lambda t: t != "")
    parts = records.select(
        "entity_id",
        string_or(F.col("profile"), F.lit("")).alias("profile_text"),
        string_or(F.col("tagline"), F.lit("")).alias("tagline"),
        F.array_join(child_texts, " ").alias("child_text"))
    return parts.withColumn("combined_text", clean_or_blank(joined_text(
        F.col("tagline"), F.col("profile_text"), F.col("child_text"))))


def clean_or_blank(c: Column) -> Column:
    return F.coalesce(clean_string(c), F.lit(""))


def entity_table(records: DataFrame, links: DataFrame,
                 quantile: float = DEFAULTS.top_quantile) -> DataFrame:
    """Typed entity rows with defaults filled, label and number of links."""
    counts = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("item_count"))
    typed = records.select(
        "entity_id",
        string_or(F.col("handle"), F.col("entity_id").cast("string")).alias("handle"),
        F.col("display_name"),
        string_or(F.col("region"), F.lit(UNKNOWN)).alias("region"),
        string_or(F.col("locality"), F.lit(UNKNOWN)).alias("locality"),
        float_or_zero(F.col("rate")).alias("rate"),
        float_or_zero(F.col("metric")).alias("metric"),
        float_or_zero(F.col("reputation")).alias("reputation"),
        clean_int(F.col("event_count")).alias("event_count"),
        float_or_zero(F.col("stars")).alias("stars"),
        float_or_zero(F.col("score")).alias("score"),
        clean_float(F.col("latitude")).alias("latitude"),
        clean_float(F.col("longitude")).alias("longitude"),
    ).withColumn("display_name", string_or(F.col("display_name"), F.col("handle")))
    counted = typed.join(counts, "entity_id", "left").withColumn(
        "item_count", F.coalesce("item_count", F.lit(0).cast("bigint")))
    return with_label(counted, quantile)


def ingestion_report(entities: DataFrame, links: DataFrame, children: DataFrame,
                     texts: DataFrame, quantile: float = DEFAULTS.top_quantile) -> DataFrame:
    """One row of ingest totals."""
    rows = F.count(F.lit(1))
    return entities.agg(
        rows.alias("entities"),
        label_count().alias("top_entities"),
        (F.lit(100.0) * label_count() / rows).alias("top_pct"),
    ).select(
        "*",
        quantile_value(entities, "metric", quantile).alias("top_threshold"),
        links.agg(rows).scalar().alias("links"),
        links.select("item_name").distinct().agg(rows).scalar().alias("distinct_items"),
        children.agg(rows).scalar().alias("child_rows"),
        texts.agg(F.count_if(F.length("combined_text") > 0)).scalar()
        .alias("entities_with_text"),
    )
