"""Outcome statistics by region and locality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlift.functions.naming import counted
from tierlift.operators.item_stats import label_count, money_mean
from tierlift.operators.quantiles import aggregate_with_quantiles
from tierlift.params import DEFAULTS, UNKNOWN


def known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != UNKNOWN))
    return df


def region_statistics(entities: DataFrame,
                      min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    n = F.count(F.lit(1))
    return aggregate_with_quantiles(
        known(entities, "region"), ["region"],
        [
            n.alias("entity_count"),
            (label_count() / n).alias("top_rate"),
            label_count().alias("top_count"),
            money_mean("metric").alias("mean_metric"),
            money_mean("rate").alias("mean_rate"),
            F.avg("latitude").alias("avg_lat"),
            F.avg("longitude").alias("avg_lon"),
        ],
        {
            "median_metric": ("metric", 0.5),
            "median_rate": ("rate", 0.5),
            "median_item_count": ("item_count", 0.5),
            "median_event_count": ("event_count", 0.5),
        },
    ).where(F.col("entity_count") >= min_entities)


def locality_statistics(entities: DataFrame,
                        min_entities: int = DEFAULTS.min_locality_entities) -> DataFrame:
    n = F.count(F.lit(1))
    return aggregate_with_quantiles(
        known(entities, "region", "locality"), ["region", "locality"],
        [
            n.alias("entity_count"),
            (label_count() / n).alias("top_rate"),
            money_mean("metric").alias("mean_metric"),
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
        ],
        {"median_metric": ("metric", 0.5), "median_rate": ("rate", 0.5)},
    ).where(F.col("entity_count") >= min_entities)


def kept_regions(entities: DataFrame,
                 min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    return (
        known(entities, "region").groupBy("region").agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("c") >= min_entities).select("region"))


def region_item_counts(entities: DataFrame, links: DataFrame,
                       min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    """Holders per kept region and item; links are unique per entity and item name."""
    placed = entities.select("entity_id", "region").join(
        kept_regions(entities, min_entities), "region", "left_semi")
    return (
        links.select("entity_id", "item_name").join(placed, "entity_id")
        .groupBy("region", "item_name").agg(F.count(F.lit(1)).alias("item_entities")))


def region_top_items(entities: DataFrame, links: DataFrame, k: int = 5,
                     min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    """The ``k`` most held items of every kept region as one ordered string."""
    rank = Window.partitionBy("region").orderBy(F.col("item_entities").desc(), "item_name")
    ranked = (
        region_item_counts(entities, links, min_entities)
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
    # At most k rows per region are collected.
    return ranked.groupBy("region").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(
            "rank", counted(F.col("item_name"), F.col("item_entities")).alias("shown")))),
        lambda x: x["shown"]), ", ").alias("top_items"))


def region_report(entities: DataFrame, links: DataFrame,
                  min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    stats = region_statistics(entities, min_entities)
    tops = region_top_items(entities, links, min_entities=min_entities)
    return stats.join(tops, "region", "left").withColumn(
        "top_items", F.coalesce("top_items", F.lit("")))
