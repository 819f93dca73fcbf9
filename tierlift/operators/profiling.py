"""Profiles of raw, not yet deduplicated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlift.functions.clean import clean_float, clean_string
from tierlift.operators.quantiles import aggregate_with_quantiles


def percent(n: Column, total: Column) -> Column:
    return F.lit(100.0) * n / F.greatest(total, F.lit(1))


def record_counts(records: DataFrame) -> DataFrame:
    """Records, distinct and duplicate ids, places and items, in one row.

    Each distinct count is its own two-step aggregate, so no row is expanded once per
    distinct column.
    """
    rows = F.count(F.lit(1))

    def distinct(c: Column) -> Column:
        return (records.select(c.alias("v")).where(F.col("v").isNotNull()).distinct()
                .agg(rows).scalar())

    entity = clean_string(F.col("entity_id"))
    # Spellings are made distinct before the costlier parsing.
    item_ids = (records.select(F.explode("items.item_id").alias("raw")).distinct()
                .select(clean_float(F.col("raw")).try_cast("bigint").alias("v"))
                .where(F.col("v").isNotNull()).distinct().agg(rows).scalar())
    return records.agg(
        rows.alias("total_records"),
        F.count(entity).alias("_ids"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .alias("with_coordinates"),
        F.coalesce(F.sum(explicit_items()), F.lit(0)).cast("bigint").alias("explicit_mentions"),
    ).select(
        "total_records", "with_coordinates", "explicit_mentions",
        distinct(entity).alias("unique_entities"),
        (F.col("_ids") - distinct(entity)).alias("duplicate_entities"),
        distinct(clean_string(F.col("locality"))).alias("distinct_localities"),
        item_ids.alias("distinct_item_ids"),
    )


def explicit_items() -> Column:
    return F.size(F.filter("items", lambda s: s["explicit"] & s["item_name"].isNotNull()))


def field_completeness(fields: DataFrame) -> DataFrame:
    """Per key of the map column ``fields``: records where the value is not null, "" or []."""
    total = fields.agg(F.count(F.lit(1))).scalar()
    blank = F.col("value").isin("null", '""', "[]")
    return (
        fields.select(F.explode("fields").alias("field", "value"))
        .where(F.col("value").isNotNull() & ~blank)
        .groupBy("field").agg(F.count(F.lit(1)).alias("present"))
        .withColumn("percentage", percent(F.col("present"), total))
    )


def column_completeness(df: DataFrame) -> DataFrame:
    """The same for a flat table: one pass of counts, unpivoted afterwards."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    return counts.unpivot("_total", df.columns, "field", "present").select(
        "field", "present", percent(F.col("present"), F.col("_total")).alias("percentage"))


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """Presence, zeros and the distribution of one numeric column."""
    v = F.col("v")
    source = df.select(F.col(column).alias("v"))
    out = aggregate_with_quantiles(
        source, [],
        [
            F.count(v).alias("count_present"),
            F.count_if(v.isNull()).alias("count_missing"),
            F.count_if(v == 0.0).alias("count_zero"),
            percent(F.count_if(v.isNull() | (v == 0.0)), F.count(F.lit(1)))
            .alias("pct_zero_or_missing"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            (F.sum(v) / F.nullif(F.count(v), F.lit(0))).alias("mean_value"),
            F.stddev_pop(v).alias("std_value"),
        ],
        {"median_value": ("v", 0.5), "p25": ("v", 0.25), "p75": ("v", 0.75),
         "p90": ("v", 0.90), "p95": ("v", 0.95), "p99": ("v", 0.99)},
    )
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def text_profile(records: DataFrame) -> DataFrame:
    """Coverage and stripped length of the profile text, taglines and child rows."""
    lengths = records.select(
        F.length(clean_string(F.col("profile"))).cast("bigint").alias("len"),
        clean_string(F.col("tagline")).isNotNull().alias("has_tagline"),
        F.size("children").cast("bigint").alias("children"))
    present = F.count("len")
    return aggregate_with_quantiles(
        lengths, [],
        [
            present.alias("with_text"),
            percent(present, F.count(F.lit(1))).alias("pct_with_text"),
            F.count_if("has_tagline").alias("with_tagline"),
            F.count_if(F.col("children") > 0).alias("with_children"),
            F.coalesce(F.sum("children"), F.lit(0)).alias("total_children"),
            (F.sum("len") / F.nullif(present, F.lit(0))).alias("mean_length"),
            F.max("len").alias("max_length"),
        ],
        {"median_length": ("len", 0.5)},
    )


def item_mentions(records: DataFrame) -> DataFrame:
    """Explicit and total mentions per item; items never named explicitly are left out."""
    total = records.agg(F.count(F.lit(1))).scalar()
    return (
        records.select(F.explode("items").alias("s"))
        .where(F.col("s.item_name").isNotNull())
        .groupBy(F.col("s.item_name").alias("item_name"))
        .agg(F.count_if("s.explicit").alias("explicit_count"),
             F.count(F.lit(1)).alias("mention_count"))
        .where(F.col("explicit_count") > 0)
        .withColumn("prevalence_pct", percent(F.col("explicit_count"), total))
    )


def group_frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-blank value and their share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.select(clean_string(F.col(column)).alias(column)).where(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("percentage", percent(F.col("row_count"), total))
    )
