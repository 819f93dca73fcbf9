"""Bundles that go with the label inside a region, tested against the region's own totals.

A bundle of the whole population is counted again per region by the same pass over the links
that counts pairs and triples, so no table of holders is made. Every region is a family of
tests of its own: its p-values are adjusted together, with ranks cut into blocks, and a region
that holds most of the entities is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlift.functions import association as assoc
from tierlift.functions.naming import bundle_name, guarded_ratio
from tierlift.operators.bundles import (
    coded_links, false_discovery, min_bundle_count, pair_counts, population, ranked_items,
    seed_pairs, triple_counts)
from tierlift.operators.geography import known
from tierlift.params import DEFAULTS
from tierlift.session import cut_lineage


def region_totals(entities: DataFrame,
                  min_entities: int = DEFAULTS.min_region_entities) -> DataFrame:
    """``(region, region_entities, region_top)`` of the regions large enough to test in."""
    return (
        known(entities, "region").groupBy("region")
        .agg(F.count(F.lit(1)).alias("region_entities"),
             F.count_if("is_top").alias("region_top"))
        .where(F.col("region_entities") >= min_entities))


def region_bundles(
    entities: DataFrame,
    links: DataFrame,
    min_holders: int = DEFAULTS.min_region_holders,
    min_entities: int = DEFAULTS.min_region_entities,
    min_frequency: int = DEFAULTS.min_item_frequency,
    min_count: int = DEFAULTS.min_bundle_count,
    min_support: float = DEFAULTS.min_bundle_support,
    seeds: int = DEFAULTS.triple_seed_pairs,
    alpha: float = DEFAULTS.fdr_alpha,
) -> DataFrame:
    """Every bundle of the population with at least ``min_holders`` holders in a region.

    Regions that are null or unknown, or have fewer than ``min_entities``, are left out.
    """
    needed = min_bundle_count(population(entities).total, min_count, min_support)
    items = cut_lineage(ranked_items(links, max(min_frequency, needed)))
    placed = known(entities, "region").select("entity_id", "region")
    coded = cut_lineage(coded_links(entities, links, items).join(placed, "entity_id", "left"))
    pairs = cut_lineage(pair_counts(coded, needed))
    first = cut_lineage(seed_pairs(pairs, seeds))
    triples = triple_counts(coded, first, needed).select("i", "j", "k")
    held = coded.where("region is not null")
    regional = (
        pair_counts(held, min_holders, by=("region",))
        .join(pairs.select("i", "j"), ["i", "j"], "left_semi")
        .withColumn("ranks", F.array("i", "j"))
        .unionByName(
            triple_counts(held, first, min_holders, by=("region",))
            .join(triples, ["i", "j", "k"], "left_semi")
            .withColumn("ranks", F.array("i", "j", "k")), allowMissingColumns=True)
        .join(region_totals(entities, min_entities), "region"))
    names = items.select("r", "item_name")
    for place in range(3):
        looked = names.select(F.col("r").alias("_r"), F.col("item_name").alias(f"_m{place}"))
        regional = regional.join(
            looked, F.get("ranks", F.lit(place)) == F.col("_r"), "left").drop("_r")
    n, a = F.col("n"), F.col("a")
    cells = assoc.contingency(n, a, F.col("region_entities"), F.col("region_top"))
    stats = regional.select(
        "region", bundle_name(F.array_compact(F.array("_m0", "_m1", "_m2"))).alias("bundle_name"),
        F.size("ranks").alias("bundle_size"), n.alias("entity_count"), a.alias("top_count"),
        (a / n).alias("top_rate"),
        guarded_ratio(a / n, F.col("region_top") / F.col("region_entities"), 1.0)
        .alias("top_lift"),
        assoc.odds_ratio(assoc.corrected_cells(cells)).alias("odds_ratio"),
        assoc.yates_chi2(cells).alias("chi2"),
    ).withColumn("p_value", assoc.chi2_survival(F.col("chi2")))
    return false_discovery(cut_lineage(stats), alpha, by=("region",))


def leading_bundles(tested: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` bundles most in favour of the label in each region.

    Only bundles with a lift above 1 lead; significant ones come first, then the larger lift,
    more holders, the name.
    """
    order = Window.partitionBy("region").orderBy(
        F.col("is_significant").desc(), F.col("top_lift").desc(), F.col("entity_count").desc(),
        "bundle_name")
    # A row number with a limit keeps k rows per region and task before the shuffle.
    return (
        tested.where(F.col("top_lift") > 1).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k))
