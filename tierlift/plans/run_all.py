"""From raw JSON pages to every result table, in one session.

``python -m tierlift.plans.run_all <pages> <out>`` or ``run(spark, pages, out)``.
Every phase reads the stored tables of the phases before it.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.functions.clean import clean_float
from tierlift.operators import (
    bundles as mining, geography, graph, item_stats, normalise, profiling, regression, summary,
    text_terms,
)
from tierlift.params import DEFAULTS, Thresholds
from tierlift.sources import raw_json, tables


class Store:
    """Result tables below one folder; each is written once and read back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        tables.write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def document(self, name: str, df: DataFrame) -> DataFrame:
        tables.write_json(df, f"{self.root}/{name}")
        return df


def stage(spark: SparkSession, pages: str, store: Store) -> DataFrame:
    """Typed raw records and their field names, parsed once."""
    scanned = raw_json.read_pages(spark, pages, "*.json")
    store.document("profile/files", raw_json.file_counts(scanned))
    store.table("profile/bad_files", raw_json.bad_files(scanned))
    raw = store.table("staged/raw", raw_json.explode_records(scanned))
    store.table("profile/field_completeness",
                profiling.field_completeness(raw_json.json_fields(raw)))
    return store.table("staged/records", raw_json.type_records(raw))


def profile(records: DataFrame, store: Store) -> None:
    numbers = records.select(
        clean_float(F.col("metric"), keep_infinity=True).alias("metric"),
        clean_float(F.col("rate"), keep_infinity=True).alias("rate"))
    store.document("profile/records", profiling.record_counts(records))
    store.document("profile/metric", profiling.numeric_profile(numbers, "metric"))
    store.document("profile/rate", profiling.numeric_profile(numbers, "rate"))
    store.document("profile/text", profiling.text_profile(records))
    store.table("profile/items", profiling.item_mentions(records))
    store.table("profile/regions", profiling.group_frequency(records, "region"))


def normalised(records: DataFrame, store: Store, t: Thresholds) -> dict[str, DataFrame]:
    metric = clean_float(F.col("metric"))
    arrival = ["file", "pos"]
    conflicts = store.table("profile/conflicts", normalise.conflict_log(
        normalise.with_file_block(records), "entity_id", metric, F.col("n_items"), arrival,
        F.col("block")))
    store.table("profile/conflict_sample", normalise.conflict_sample(conflicts, arrival))
    best = store.table("staged/best", normalise.keep_best(
        records, "entity_id", metric, F.col("n_items"), arrival))
    links = store.table("links", normalise.item_links(best).drop("pos"))
    out = {
        "links": links,
        "entities": store.table("entities", normalise.entity_table(best, links, t.top_quantile)),
        "children": store.table("children", normalise.child_rows(best)),
        "texts": store.table("texts", normalise.assembled_text(best)),
    }
    store.document("profile/ingestion", normalise.ingestion_report(
        out["entities"], links, out["children"], out["texts"], t.top_quantile))
    return out


def run(spark: SparkSession, pages: str, out: str,
        t: Thresholds = DEFAULTS) -> dict[str, DataFrame]:
    store = Store(spark, out)
    records = stage(spark, pages, store)
    profile(records, store)
    made = normalised(records, store, t)
    entities, links = made["entities"], made["links"]

    overview = store.document("overview", item_stats.overview(entities, links))
    store.table("metric_distribution", item_stats.metric_distribution(entities))
    made["item_statistics"] = store.table("item_statistics", item_stats.item_statistics(
        entities, links, t.min_item_frequency))

    people = mining.population(entities)
    made["bundles"] = store.table("bundles", mining.by_top_lift(mining.mine_bundles(
        entities, links, people, t.min_item_frequency, t.min_bundle_count, t.min_bundle_support,
        t.triple_seed_pairs, t.fdr_alpha)))
    made["regressions"] = store.table("regressions", regression.bundle_regressions(
        entities, links, made["bundles"], t.regression_bundles, t.regression_regions))

    controls = regression.control_names(regression.top_regions(entities, t.regression_regions))
    store.document("regression_controls", spark.createDataFrame(
        [(controls,)], "model_controls array<string>"))

    top = graph.top_items(made["item_statistics"], t.max_graph_nodes)
    made["edges"] = store.table("edges", graph.cooccurrence_edges(links, top, t.min_edge_weight))
    partition = graph.communities(made["edges"])
    made["nodes"] = store.table("nodes", graph.node_table(
        made["edges"], made["item_statistics"], partition))
    made["communities"] = store.table("communities", graph.community_summary(made["nodes"]))

    docs = store.table("staged/corpus", text_terms.corpus(
        entities, made["texts"], "entity_id", "is_top", "combined_text"))
    made["terms"] = store.table("terms", text_terms.differential_terms(docs))
    model, vocab, shares = text_terms.fit_topics(docs, t.topics, t.seed)
    meta = entities.select(
        F.col("entity_id").alias("doc_id"), F.col("is_top").alias("label"), "metric")
    made["topics"] = store.table(
        "topics", text_terms.topic_table(model, vocab, shares, meta))

    made["regions"] = store.table("regions", geography.region_report(
        entities, links, t.min_region_entities))
    made["localities"] = store.table("localities", geography.locality_statistics(
        entities, t.min_locality_entities))

    store.document("summary", summary.summary_document(
        overview, made["bundles"], made["item_statistics"], made["communities"], made["terms"],
        made["topics"], made["regions"], made["regressions"]))
    store.table("status", tables.table_row_counts(made))
    return made


if __name__ == "__main__":
    session = SparkSession.builder.appName("tierlift").getOrCreate()
    run(session, sys.argv[1], sys.argv[2])
