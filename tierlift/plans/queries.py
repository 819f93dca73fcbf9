"""Registered queries: operators bound to the sample tables.

Doubles that go through exp, log or an order-dependent sum are rounded, everything
else is returned as computed. Lists come out as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.functions import association, clean, naming
from tierlift.functions.text import stop_words, tokens, unigrams_and_bigrams
from tierlift.operators import (
    bundles as mining, geography, graph, item_stats, normalise, profiling, region_bundles as regional,
    regression, summary, text_terms, views,
)
from tierlift.plans import bindings as b, ordered_queries, stream_queries
from tierlift.session import cut_lineage, parts_of, scratch_path
from tierlift.sources import raw_json, tables
from tierlift.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = ordered_queries.QUERIES | stream_queries.QUERIES


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


# --- item and entity statistics -------------------------------------------------

@query
def item_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.item_stats(spark, sf), 6, "median_log_metric")


@query
def overview_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(item_stats.overview(b.entities(spark, sf), b.links(spark, sf)),
                   4, "std_metric")


@query
def metric_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(item_stats.metric_distribution(b.entities(spark, sf)), 6, "log_metric")


@query
def headline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return views.headline_metrics(item_stats.overview(b.entities(spark, sf), b.links(spark, sf)))


@query
def quantile_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.entities(spark, sf).select(
        "entity_id", "metric", "log_metric", "is_top"), 6, "log_metric")


@query
def item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return item_stats.item_counts(b.links(spark, sf))


# --- raw profiles ---------------------------------------------------------------

@query
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.record_counts(b.records(spark, sf))


@query
def profile_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.field_completeness(raw_json.json_fields(b.raw_variants(spark, sf)))


@query
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.column_completeness(b.table(
        spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars"))


@query
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    out = profiling.numeric_profile(b.table(spark, sf, "events", "value"), "value")
    return rounded(out, 4, "mean_value", "std_value", "median_value", "p25", "p75", "p90",
                   "p95", "p99", "iqr")


@query
def profile_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = b.records(spark, sf).select(
        clean.clean_float(F.col("rate"), keep_infinity=True).alias("rate"))
    out = profiling.numeric_profile(rates, "rate").drop("std_value", "p95", "p99", "iqr")
    return rounded(out, 4, "mean_value", "median_value", "p25", "p75", "p90")


@query
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.text_profile(b.records(spark, sf))


@query
def profile_items(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.item_mentions(b.records(spark, sf))


@query
def profile_groups(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.group_frequency(b.records(spark, sf), "region")


# --- cleaning -------------------------------------------------------------------

@query
def clean_scalars(spark: SparkSession, sf: str) -> DataFrame:
    customer = b.table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    balance = F.col("c_acctbal")
    text = (
        F.when(balance < 0, F.lit(" inf ")).when(balance < 500, F.lit("12 apples"))
        .when(balance < 1000, F.lit("NaN")).when(balance < 1500, F.lit(" 1_000 "))
        .when(balance < 2000, F.lit("1d"))
        .otherwise(F.concat(balance.cast("string"), F.lit("\t"))))
    padded = F.when(balance < 0, F.lit(" \t\n ")).otherwise(
        F.concat(F.lit(" \n"), F.col("c_name"), F.lit("\t ")))
    return customer.select(
        "c_custkey",
        clean.clean_string(padded).alias("name"),
        clean.string_or(padded, F.lit("Unknown")).alias("name_or_default"),
        clean.clean_float(text).alias("number"),
        F.coalesce(clean.clean_float(text, keep_infinity=True) > 1e300, F.lit(False))
        .alias("is_infinite"),
        clean.float_or_zero(text).alias("number_or_zero"),
        clean.clean_int(text).alias("whole"),
        clean.truthy_text(padded).alias("truthy"),
        naming.guarded_ratio(F.lit(1.0), balance, 0.0).alias("ratio"),
        F.round(F.log1p(F.abs(balance)), 6).alias("log_balance"))


@query
def nested_number(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events", "event_id", "props")
    props = F.try_parse_json("props")
    return events.select(
        "event_id", F.try_variant_get(props, "$.k", "bigint").alias("k"),
        F.try_variant_get(props, "$.k.deeper", "bigint").alias("missing"),
        clean.truthy_variant(F.try_variant_get(props, "$.k", "variant")).alias("k_is_true"))


@query
def dynamic_key_fold(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events", "event_id", "user_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    keyed = events.select(
        "event_id", F.array(k, k + 1).alias("jobs"),
        F.create_map(
            F.concat(F.lit("stars_"), k.cast("string")), F.col("value").cast("string"),
            F.concat(F.lit("score_"), k.cast("string")), F.col("user_id").cast("string"),
            F.lit("stars_none"), F.lit("0"), F.lit("is_online"), F.lit("1"),
            F.lit("name"), F.lit("x")).alias("m"))
    fields = ["stars", "score"]
    rest = clean.drop_prefixed_keys(clean.drop_keys(F.col("m"), raw_json.UNUSED_KEYS), fields)
    return keyed.select(
        "event_id",
        F.explode(clean.fold_dynamic_keys(F.col("m"), F.col("jobs"), fields)).alias("j"),
        F.array_join(F.array_sort(F.map_keys(rest)), ",").alias("kept_keys"),
    ).select("event_id", F.col("j.id").alias("job_id"),
             F.col("j.stars").cast("double").alias("stars"),
             F.col("j.score").cast("bigint").alias("score"), "kept_keys")


# --- deduplication and normalisation ---------------------------------------------

@query
def keep_best_dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")
    sized = events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return normalise.keep_best(
        sized, "user_id", F.col("value"), F.col("k"), ["event_id"]).drop("props")


@query
def dedup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events", "event_id", "user_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return normalise.conflict_log(
        events.withColumn("k", k), "user_id", F.col("value"), F.col("k"), ["event_id"],
        F.floor(F.col("event_id") / (1 << 20)))


@query
def record_dedup(spark: SparkSession, sf: str) -> DataFrame:
    best = normalise.keep_best(b.records(spark, sf), "entity_id", clean.clean_float(F.col("metric")),
                               F.col("n_items"), ["file", "pos"])
    return best.select("entity_id", "file", "pos", "n_items",
                       clean.float_or_zero(F.col("metric")).alias("metric"))


@query
def record_conflict_sample(spark: SparkSession, sf: str) -> DataFrame:
    log = normalise.conflict_log(
        normalise.with_file_block(b.records(spark, sf)), "entity_id",
        clean.clean_float(F.col("metric")), F.col("n_items"), ["file", "pos"], F.col("block"))
    return normalise.conflict_sample(log, ["file", "pos"])


@query
def first_wins_items(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.item_links(b.document_records(spark, sf)).drop("pos")


@query
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.child_rows(b.document_records(spark, sf))


@query
def assembled_text(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.assembled_text(b.document_records(spark, sf))


@query
def entity_records(spark: SparkSession, sf: str) -> DataFrame:
    recs = b.document_records(spark, sf)
    out = normalise.entity_table(recs, normalise.item_links(recs))
    return rounded(out, 6, "log_metric")


@query
def ingestion_report(spark: SparkSession, sf: str) -> DataFrame:
    recs = b.document_records(spark, sf)
    links = normalise.item_links(recs)
    return normalise.ingestion_report(
        normalise.entity_table(recs, links), links, normalise.child_rows(recs),
        normalise.assembled_text(recs))


# --- bundles --------------------------------------------------------------------

def _mining_inputs(spark: SparkSession, sf: str):
    people = mining.population(b.entities(spark, sf))
    needed = mining.min_bundle_count(people.total)
    items = cut_lineage(mining.ranked_items(b.links(spark, sf), max(15, needed)))
    return needed, items, cut_lineage(
        mining.coded_links(b.entities(spark, sf), b.links(spark, sf), items))


def _with_names(counted: DataFrame, items: DataFrame, ranks: list[str]) -> DataFrame:
    for r in ranks:
        counted = counted.join(
            items.select(F.col("r").alias(r), F.col("item_name").alias(f"item_{r}")), r)
    return counted.drop(*ranks)


@query
def pair_support(spark: SparkSession, sf: str) -> DataFrame:
    needed, items, coded = _mining_inputs(spark, sf)
    return _with_names(mining.pair_counts(coded, needed), items, ["i", "j"])


@query
def triple_support(spark: SparkSession, sf: str) -> DataFrame:
    needed, items, coded = _mining_inputs(spark, sf)
    pairs = cut_lineage(mining.pair_counts(coded, needed))
    return _with_names(mining.triple_counts(coded, mining.seed_pairs(pairs), needed),
                       items, ["i", "j", "k"])


BUNDLE_COLUMNS = [
    "bundle_name", "bundle_items", "bundle_size", "entity_count", "support",
    "expected_prevalence", "lift", "top_count", "top_rate", "top_lift", "odds_ratio",
]


@query
def bundle_table(spark: SparkSession, sf: str) -> DataFrame:
    df = b.bundles(spark, sf).withColumn("bundle_items", naming.json_list(F.col("members")))
    return rounded(df.select(*BUNDLE_COLUMNS, "ci_lower", "ci_upper", "chi2"), 6,
                   "ci_lower", "ci_upper")


@query
def bundle_fdr(spark: SparkSession, sf: str) -> DataFrame:
    df = b.all_bundles(spark, sf).select(
        "bundle_name", "p_value", "adjusted_p_value", "is_significant")
    return rounded(df, 9, "p_value", "adjusted_p_value")


@query
def bundle_ols_single(spark: SparkSession, sf: str) -> DataFrame:
    chosen = mining.by_top_lift(b.bundles(spark, sf)).limit(30)
    out = regression.single_regressor_ols(b.entities(spark, sf), b.links(spark, sf), chosen)
    return rounded(out, 6, "slope", "intercept", "r2")


@query
def bundle_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return regression.bundle_regressions(
        b.entities(spark, sf), b.links(spark, sf), b.bundles(spark, sf)).drop("members")


@query
def odds_ratio_chart(spark: SparkSession, sf: str) -> DataFrame:
    return views.odds_ratio_chart(regression.bundle_regressions(
        b.entities(spark, sf), b.links(spark, sf), b.bundles(spark, sf)))


@query
def bundle_evidence(spark: SparkSession, sf: str) -> DataFrame:
    df = b.bundles(spark, sf).select(
        "bundle_name", "chi2", association.chi2_evidence(F.col("chi2")).alias("neg_log10_p"))
    return rounded(df, 6, "chi2", "neg_log10_p")


REGIONAL = ["top_rate", "top_lift", "odds_ratio", "chi2", "p_value", "adjusted_p_value"]


def _regional(spark: SparkSession, sf: str) -> DataFrame:
    return b.once(spark, sf, "region_bundles", lambda: regional.region_bundles(
        b.entities(spark, sf), b.links(spark, sf)), cut_lineage)


@query
def region_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_regional(spark, sf), 6, *REGIONAL)


@query
def region_leading_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regional.leading_bundles(_regional(spark, sf)), 6, *REGIONAL)


@query
def bundle_members(spark: SparkSession, sf: str) -> DataFrame:
    return views.bundle_members(b.bundles(spark, sf))


@query
def bundle_explorer(spark: SparkSession, sf: str) -> DataFrame:
    return views.bundle_explorer(b.bundles(spark, sf), 25, 3, "WIDGET").select(
        "bundle_name", "entity_count", "top_rate", "top_lift", "odds_ratio")


# --- graph ----------------------------------------------------------------------

@query
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return b.edges(spark, sf)


@query
def entity_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    top = graph.top_items(b.item_stats(spark, sf))
    return graph.cooccurrence_edges(b.links(spark, sf), top)


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes_of(b.edges(spark, sf))


@query
def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(b.edges(spark, sf))


def _name_length_partition(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes_of(b.edges(spark, sf)).select(
        "node", F.length("node").alias("community"))


@query
def graph_modularity(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.modularity(b.edges(spark, sf), _name_length_partition(spark, sf))
    return rounded(out, 9, "modularity")


@query
def graph_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.betweenness(b.edges(spark, sf)), 9, "betweenness")


@query
def graph_closeness(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closeness(b.edges(spark, sf))


@query
def bridge_scores(spark: SparkSession, sf: str) -> DataFrame:
    edges = b.edges(spark, sf)
    both = graph.degrees(edges).join(graph.betweenness(edges), "node")
    return rounded(both.select("node", graph.bridge_score(
        F.col("betweenness"), F.col("degree_centrality")).alias("bridge_score")),
        7, "bridge_score")


def _partition(spark: SparkSession, sf: str) -> DataFrame:
    return b.once(spark, sf, "partition",
                   lambda: graph.communities(b.edges(spark, sf)), cut_lineage)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return b.once(
        spark, sf, "nodes",
        lambda: graph.node_table(b.edges(spark, sf), b.item_stats(spark, sf),
                                 _partition(spark, sf)), cut_lineage)


@query
def graph_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any partition: every node once, and no single move that gains."""
    edges, partition = b.edges(spark, sf), cut_lineage(_partition(spark, sf))
    placed = partition.agg(F.count(F.lit(1)).alias("placed"),
                           F.count_distinct("node").alias("different"))
    gaining = graph.gaining_moves(edges, partition).agg(F.count(F.lit(1)).alias("gaining_moves"))
    return placed.join(gaining)


@query
def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    return _partition(spark, sf)


@query
def graph_node_table(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf)


@query
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.community_summary(_nodes(spark, sf))


@query
def name_length_summary(spark: SparkSession, sf: str) -> DataFrame:
    stats = b.item_stats(spark, sf).select(
        F.col("item_name").alias("node"),
        F.length("item_name").cast("bigint").alias("community"),
        "entity_count", "top_rate", "median_metric")
    return rounded(graph.community_summary(stats), 9, "avg_top_rate")


@query
def bridge_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return views.bridge_leaderboard(_nodes(spark, sf))


@query
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    members = _name_length_partition(spark, sf).where(F.col("community") <= 9)
    floor = b.edges(spark, sf).agg(F.percentile("weight", F.lit(0.5))).scalar()
    return graph.subgraph(b.edges(spark, sf), members, floor)


# --- text -----------------------------------------------------------------------

@query
def clean_text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf)
    words = tokens(F.col("clean"), stop_words())
    return docs.select("doc_id", "clean", words.alias("w")).select(
        "doc_id", "clean", F.array_join("w", " ").alias("tokens"),
        F.size(unigrams_and_bigrams(F.col("w"))).alias("n_terms"))


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf)
    return text_terms.vocabulary(
        text_terms.document_terms(docs), docs.count(), **text_terms.TERM_VOCABULARY)


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf)
    n = docs.count()
    terms = cut_lineage(text_terms.document_terms(docs))
    vocab = cut_lineage(text_terms.vocabulary(terms, n, **text_terms.TERM_VOCABULARY))
    return rounded(text_terms.tfidf(terms, vocab, n), 9, "weight").drop("label")


def _document_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the documents, read for the weights and for the topics."""
    return b.once(spark, sf, "document_terms", lambda: text_terms.document_terms(
        b.documents(spark, sf)), cut_lineage)


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return b.once(spark, sf, "terms", lambda: text_terms.differential_terms(
        b.documents(spark, sf), terms=_document_terms(spark, sf)), cut_lineage)


def _rounded_terms(df: DataFrame) -> DataFrame:
    return rounded(df, 9, "top_mean", "other_mean", "diff_ratio", "log_diff_score",
                   "abs_diff_score")


@query
def differential_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_terms(_terms(spark, sf))


@query
def term_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return views.term_extremes(_terms(spark, sf)).select(
        "side", "term", F.round("log_diff_score", 7).alias("log_diff_score"))


@query
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_terms(summary.top_terms(_terms(spark, sf)))


_fits: dict[tuple[str, str], tuple] = {}


def _fit(spark: SparkSession, sf: str) -> tuple:
    """Model, vocabulary and shares per document, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        _fits[key] = text_terms.fit_topics(
            b.documents(spark, sf), terms=_document_terms(spark, sf))
    return _fits[key]


def _topic_table(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        meta = b.table(spark, sf, "documents", "doc_id", "n_chars").join(
            b.documents(spark, sf).select("doc_id", "label"), "doc_id").select(
            "doc_id", "label", F.col("n_chars").cast("double").alias("metric"))
        return text_terms.topic_table(*_fit(spark, sf), meta)
    return b.once(spark, sf, "topics", build, cut_lineage)


@query
def lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_table(spark, sf)


@query
def lda_dominant(spark: SparkSession, sf: str) -> DataFrame:
    return text_terms.dominant_topic(_fit(spark, sf)[2]).select("doc_id", "topic")


@query
def lda_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any fit: each document, and each labelled one, is in one topic."""
    shares = _fit(spark, sf)[2]
    table = _topic_table(spark, sf)
    placed = text_terms.dominant_topic(shares).agg(F.count(F.lit(1)).alias("documents"))
    total = table.agg(F.sum("entity_count").alias("in_topics"),
                      F.sum("top_count").alias("labelled_top"))
    return placed.join(total)


@query
def topic_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return summary.rank_topics(_topic_table(spark, sf)).select(
        "topic_id", "topic_label", "entity_count", "top_rate", "median_metric")


# --- geography ------------------------------------------------------------------

@query
def country_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return geography.region_statistics(b.entities(spark, sf))


@query
def city_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return geography.locality_statistics(b.entities(spark, sf))


@query
def country_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return geography.region_item_counts(b.entities(spark, sf), b.links(spark, sf))


@query
def country_top_items(spark: SparkSession, sf: str) -> DataFrame:
    return geography.region_top_items(b.entities(spark, sf), b.links(spark, sf))


@query
def country_report(spark: SparkSession, sf: str) -> DataFrame:
    return geography.region_report(b.entities(spark, sf), b.links(spark, sf))


@query
def top_countries(spark: SparkSession, sf: str) -> DataFrame:
    regions = geography.region_report(b.entities(spark, sf), b.links(spark, sf))
    return summary.top_regions_by_count(regions).select(
        "region", "entity_count", "top_rate", "median_metric", "median_rate", "top_items")


@query
def city_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return views.locality_leaders(geography.locality_statistics(b.entities(spark, sf)))


# --- extracts and views ----------------------------------------------------------

@query
def top_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return summary.top_bundles(b.bundles(spark, sf)).select(
        "bundle_name", "bundle_size", "entity_count", "support", "lift", "top_rate",
        "top_lift", "odds_ratio")


@query
def top_items_popular(spark: SparkSession, sf: str) -> DataFrame:
    return summary.popular_items(b.item_stats(spark, sf)).select(
        "item_name", "entity_count", "prevalence", "median_metric", "top_rate")


@query
def top_items_rate(spark: SparkSession, sf: str) -> DataFrame:
    return summary.items_by_rate(b.item_stats(spark, sf)).select(
        "item_name", "entity_count", "prevalence", "median_metric", "top_rate")


@query
def item_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return summary.popular_items(b.item_stats(spark, sf), 15).select(
        "item_name", "entity_count", "top_rate")


@query
def item_rate_leaders(spark: SparkSession, sf: str) -> DataFrame:
    return summary.items_by_rate(b.item_stats(spark, sf), 15, 30).select(
        "item_name", "entity_count", "top_rate")


@query
def community_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return summary.rank_communities(graph.community_summary(_nodes(spark, sf)))


@query
def metric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.metric_histogram(b.entities(spark, sf)), 6, "bin_start")


@query
def item_count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(views.item_count_histogram(b.entities(spark, sf)), 6, "bin_start")


@query
def summary_document(spark: SparkSession, sf: str) -> DataFrame:
    ents, links, bundles = b.entities(spark, sf), b.links(spark, sf), b.bundles(spark, sf)
    doc = summary.summary_document(
        item_stats.overview(ents, links), bundles, b.item_stats(spark, sf),
        graph.community_summary(_nodes(spark, sf)), _terms(spark, sf),
        _topic_table(spark, sf), geography.region_report(ents, links),
        regression.bundle_regressions(ents, links, bundles))
    return doc.select(*[F.to_json(c).alias(c) if c == "overview" else
                        F.to_json(F.struct(c)).alias(c) for c in doc.columns])


# --- files ----------------------------------------------------------------------

def _write_pages(spark: SparkSession, sf: str) -> str:
    """Documents as JSON page files of up to 100 records, one valid document per file.

    The text is many times that of the documents, most of it repeats, and files are compressed.
    """
    path = scratch_path(spark, "pages")
    pages = b.document_json(spark, sf).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join(
        F.transform("rows", lambda r: r["json"]), ",\n"), F.lit("]"))
    pages.select("file", text.alias("value")).write.partitionBy("file").option(
        "compression", "gzip").text(path)
    return path


def _write_document_files(spark: SparkSession, sf: str) -> str:
    """Every document as two JSON files: one whole, one without its last character.

    A folder holds the files of one kind of about ``SPREAD_ROWS`` documents, named by the writer.
    """
    path = scratch_path(spark, "files")
    docs = b.document_json(spark, sf)
    folders = parts_of(spark, b.table(spark, sf, "documents").count())
    kinds = F.array(
        F.struct(F.lit("ok").alias("kind"), F.col("json").alias("value")),
        F.struct(F.lit("cut").alias("kind"),
                 F.expr("substr(json, 1, length(json) - 1)").alias("value")))
    folder = F.pmod(F.xxhash64("json"), F.lit(folders))
    docs.select(folder.alias("folder"), "json").repartition(folders, "folder").select(
        "folder", F.explode(kinds).alias("x")).select("folder", "x.*").write.partitionBy(
        "kind", "folder").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


# Folders of files that are listed and read at once, so that the driver holds a bounded list.
FOLDERS_READ = 64


def _read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, doc)`` of every file, stored; of the document only whether there is one."""
    found = scratch_path(spark, "read")
    listed = [f for kind in tables.folders(spark, path) if kind.split("/")[-1].startswith("kind=")
              for f in tables.folders(spark, kind)]
    cores = spark.sparkContext.defaultParallelism
    empty = spark.createDataFrame([], "file string, doc variant")
    for i in range(0, max(1, len(listed)), FOLDERS_READ):
        some = listed[i:i + FOLDERS_READ]
        pages = raw_json.read_pages(spark, some) if some else empty
        pages.select("file", F.when(F.col("doc").isNotNull(), F.parse_json(F.lit("1"))).alias(
            "doc")).coalesce(4 * cores).write.mode("append").parquet(found)
    return spark.read.parquet(found)


@query
def raw_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    recs = raw_json.type_records(raw_json.explode_records(
        raw_json.read_pages(spark, _write_pages(spark, sf))))
    return recs.select(
        F.regexp_extract("file", "file=([0-9]+)", 1).alias("page"), "pos", "entity_id",
        clean.float_or_zero(F.col("metric")).alias("metric"), "n_items",
        F.length(clean.clean_string(F.col("profile"))).cast("bigint").alias("profile_length"),
        F.size("children").alias("n_children"))


@query
def bad_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's file once whole and once cut short: the cut ones must be reported."""
    pages = _read_document_files(spark, _write_document_files(spark, sf))
    listed = scratch_path(spark, "quarantine")
    raw_json.bad_files(pages).write.parquet(listed)
    bad = tables.read_table(spark, listed, ["file"]).agg(
        F.count_if(F.col("file").contains("kind=cut"))).scalar()
    return raw_json.file_counts(pages).withColumn("quarantined", bad)


@query
def shown_names(spark: SparkSession, sf: str) -> DataFrame:
    """Title case, weighted names and topic labels of the parts."""
    words = F.split(F.concat_ws(" ", "p_name", F.lower(F.translate("p_brand", "#", "-"))), " ")
    return b.table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size",
                   "p_retailprice").select(
        "p_partkey", naming.title_case(F.concat_ws("'s 3d ", "p_name", "p_brand")).alias("title"),
        naming.topic_label(F.col("p_size"), words).alias("label"),
        naming.weighted(F.col("p_name"), F.floor("p_retailprice") / 4).alias("weighted"))


@query
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    state = incremental.ingest_available(
        spark, _write_pages(spark, sf), scratch_path(spark, "state"))
    return incremental.current_records(spark, state).select(
        "entity_id", "n_items", clean.float_or_zero(F.col("metric")).alias("metric"))


@query
def artifact_status(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "tables")
    results = {
        "entities": b.entities(spark, sf),
        "links": b.links(spark, sf),
        "bundles": b.bundles(spark, sf),
        "edges": b.edges(spark, sf),
        "regions": geography.region_report(b.entities(spark, sf), b.links(spark, sf)),
    }
    for name, df in results.items():
        tables.write_table(df, f"{root}/{name}")
    return tables.table_row_counts({
        name: tables.read_table(spark, f"{root}/{name}", ["*"]) for name in results})


@query
def json_artifact(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "overview")
    tables.write_json(headline_metrics(spark, sf), path)
    return tables.read_json_artifact(spark, path).select(
        "total_entities", "total_top", "median_metric", "total_distinct_items")
