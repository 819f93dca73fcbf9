"""Data behind the presentation: histograms, leaderboards, filters, chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlift.operators.bundles import by_top_lift


def headline_metrics(overview: DataFrame) -> DataFrame:
    return overview.select(
        "total_entities", "total_top", "top_rate", "median_metric", "mean_metric",
        "median_rate", "median_items_per_entity", "total_distinct_items")


def histogram(df: DataFrame, column: str, bins: int, split: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the maximum joins the last bin."""
    bounds = df.agg(F.min(column).cast("double").alias("lo"),
                    F.max(column).cast("double").alias("hi"))
    low = bounds.select("lo").scalar()
    width = bounds.select((F.col("hi") - F.col("lo")) / bins).scalar()
    place = F.when(width > 0, F.least(
        F.floor((F.col(column) - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    keys = ["bin", *(split or [])]
    return (
        df.where(F.col(column).isNotNull()).select(place.cast("int").alias("bin"), *(split or []))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
        .select(*keys, "row_count", (low + F.col("bin") * width).alias("bin_start")))


def metric_histogram(entities: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(entities.where(F.col("metric") > 0), "log_metric", bins, ["is_top"])


def item_count_histogram(entities: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(entities, "item_count", bins)


def bundle_members(bundles: DataFrame, first: int = 1000) -> DataFrame:
    """Distinct items of the leading bundles, as a pick list."""
    return (by_top_lift(bundles).limit(first)
            .select(F.explode("members").alias("item_name")).distinct())


def bundle_explorer(bundles: DataFrame, min_count: int = 20, size: int | None = None,
                    contains: str | None = None, first: int = 250) -> DataFrame:
    """Leading bundles that pass the filters; ``contains`` is literal and ignores case."""
    kept = bundles.where(F.col("entity_count") >= min_count)
    if size is not None:
        kept = kept.where(F.col("bundle_size") == size)
    if contains:
        kept = kept.where(F.lower("bundle_name").contains(contains.lower()))
    return by_top_lift(kept).limit(first)


def odds_ratio_chart(regressions: DataFrame, first: int = 15) -> DataFrame:
    """Controlled odds ratios with distances to both confidence bounds."""
    ratio = F.col("controlled_odds_ratio")
    return by_top_lift(regressions).limit(first).select(
        "bundle_name", "controlled_odds_ratio",
        (F.col("controlled_ci_upper") - ratio).alias("error_plus"),
        (ratio - F.col("controlled_ci_lower")).alias("error_minus"), "ols_coefficient")


def bridge_leaderboard(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.col("bridge_score").desc(), "node").limit(n).select(
        "node", "community", "entity_count", "betweenness", "bridge_score", "top_rate")


def term_extremes(terms: DataFrame, n: int = 15) -> DataFrame:
    """The terms leaning most to the top class and those leaning most away."""
    high = terms.orderBy(F.col("log_diff_score").desc(), "term").limit(n)
    low = terms.orderBy(F.col("log_diff_score").asc(), "term").limit(n)
    return high.withColumn("side", F.lit("top")).unionByName(
        low.withColumn("side", F.lit("other")))


def locality_leaders(localities: DataFrame, n: int = 25) -> DataFrame:
    return localities.orderBy(
        F.col("entity_count").desc(), "region", "locality").limit(n)
