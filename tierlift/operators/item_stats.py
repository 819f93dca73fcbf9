"""Overview of the entity table and per-item outcome statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlift.operators.quantiles import aggregate_with_quantiles
from tierlift.params import DEFAULTS
from tierlift.session import cut_lineage


def money_mean(column: str) -> Column:
    """Mean of an amount kept to four decimals, independent of summation order."""
    exact = F.sum(F.col(column).cast("decimal(18,4)")).cast("double")
    return exact / F.count(F.col(column))


def label_count(column: str = "is_top") -> Column:
    return F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0).cast("bigint"))


def overview(entities: DataFrame, links: DataFrame) -> DataFrame:
    """One row: counts, label rate, location and spread of the outcome columns."""
    # Distinct items are counted in their own aggregate, as a scalar subquery.
    distinct_items = links.select("item_name").distinct().agg(F.count(F.lit(1))).scalar()
    n = F.count(F.lit(1))
    out = aggregate_with_quantiles(
        entities, [],
        [
            n.alias("total_entities"),
            label_count().alias("total_top"),
            (label_count() / n).alias("top_rate"),
            money_mean("metric").alias("mean_metric"),
            F.stddev_samp("metric").alias("std_metric"),
            money_mean("rate").alias("mean_rate"),
            (F.sum("item_count") / n).alias("mean_items_per_entity"),
            (F.sum("event_count") / n).alias("mean_event_count"),
        ],
        {
            "median_metric": ("metric", 0.5),
            "median_rate": ("rate", 0.5),
            "median_items_per_entity": ("item_count", 0.5),
            "median_event_count": ("event_count", 0.5),
        },
    )
    return out.withColumn("total_distinct_items", distinct_items)


def metric_distribution(entities: DataFrame) -> DataFrame:
    return entities.select(
        "metric", "log_metric", "rate", "item_count", "event_count", "is_top", "region")


def item_statistics(
    entities: DataFrame,
    links: DataFrame,
    min_frequency: int = DEFAULTS.min_item_frequency,
) -> DataFrame:
    """Outcome statistics per (item id, item name).

    ``links`` holds one row per entity and item, so row counts are entity counts and
    no distinct aggregate is needed. Rare items go before the wide join: a count over
    the links alone keeps only items that can pass the threshold.
    """
    total = entities.agg(F.count(F.lit(1))).scalar()
    frequent = (links.groupBy("item_id", "item_name").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") >= min_frequency).drop("_n"))
    held = links.select("entity_id", "item_id", "item_name").join(
        frequent, ["item_id", "item_name"], "left_semi")
    # Quantiles are read in several passes. In the order of entities their columns repeat, so the
    # stored table is small.
    joined = cut_lineage(held.join(
        entities.select("entity_id", "metric", "log_metric", "rate", "item_count", "is_top"),
        "entity_id").drop("entity_id"))
    n = F.count(F.lit(1))
    stats = aggregate_with_quantiles(
        joined, ["item_id", "item_name"],
        [
            n.alias("entity_count"),
            money_mean("metric").alias("mean_metric"),
            (label_count() / n).alias("top_rate"),
            money_mean("rate").alias("mean_rate"),
        ],
        {
            "median_metric": ("metric", 0.5),
            "median_log_metric": ("log_metric", 0.5),
            "median_rate": ("rate", 0.5),
            "median_item_count": ("item_count", 0.5),
        },
    )
    return (
        stats.where(F.col("entity_count") >= min_frequency)
        .withColumn("prevalence", F.col("entity_count") / total)
    )


def item_counts(links: DataFrame, min_frequency: int = DEFAULTS.min_item_frequency) -> DataFrame:
    """Items by name with their link count, rare ones removed."""
    return (links.groupBy("item_name").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_frequency))
