"""Registered queries of ordered windows and of as-of and interval joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.operators import grouping, ordered, time_joins
from tierlift.plans.bindings import entities, table

DAY = 86_400_000_000


def _events(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return events if kind is None else events.where(F.col("event_type") == kind)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def asof_views(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the last view of the same user."""
    clicks = _events(spark, sf, "click").select("event_id", "user_id", "ts")
    views = _events(spark, sf, "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"),
        F.col("value").alias("view_value"))
    return time_joins.asof_join(clicks, views, ["user_id"], "ts", "view_ts", tie=["view_id"])


def asof_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the last error of anyone in the ten minutes before it; one key for all."""
    errors = _events(spark, sf, "error").select(
        F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return time_joins.asof_join(
        _events(spark, sf).select("event_id", "ts"), errors, [], "ts", "error_ts",
        tolerance=F.expr("interval 10 minutes"), how="inner", tie=["error_id"])


def events_around_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases within ten minutes of each error."""
    spans = _events(spark, sf, "error").select(
        F.col("event_id").alias("error_id"),
        (F.col("ts") - F.expr("interval 10 minutes")).alias("start"),
        (F.col("ts") + F.expr("interval 10 minutes")).alias("end"))
    bought = _events(spark, sf, "purchase").select("event_id", "ts", "value")
    pairs = time_joins.interval_join(spans, bought, [], ("start", "end"), ("ts", "ts"), unit=1e6)
    return pairs.groupBy("error_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total_value"))


def overlapping_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of orders of one customer that were open at the same time."""
    shipped = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped"))
    spans = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(
        shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("first_order"),
        F.col("o_orderdate").alias("first_start"), F.col("shipped").alias("first_end"))
    other = spans.withColumnsRenamed({
        "first_order": "second_order", "first_start": "second_start", "first_end": "second_end"})
    pairs = time_joins.interval_join(spans, other, ["customer"], ("first_start", "first_end"),
                                     ("second_start", "second_end"), unit=float(DAY))
    return pairs.where("first_order < second_order").select(
        "customer", "first_order", "second_order")


def event_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The hundredth of all events into which each falls by value."""
    return ordered.with_ntile(_events(spark, sf).select("event_id", "value"), [],
                              ["value", "event_id"], 100, "hundredth")


def event_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each event by value among those of its type, the largest first."""
    return ordered.with_rank(_events(spark, sf).select("event_id", "event_type", "value"),
                             ["event_type"], ["value"], descending=True)


def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Microseconds since the event before and until the one after of the same type."""
    rows = _events(spark, sf).select("event_id", "event_type", _micros("ts").alias("at"))
    order = ["at", "event_id"]
    both = ordered.with_neighbour(
        ordered.with_neighbour(rows, ["event_type"], order, "at", "before"),
        ["event_type"], order, "at", "after", offset=-1)
    return both.select("event_id", "event_type", (F.col("at") - F.col("before")).alias("since"),
                       (F.col("after") - F.col("at")).alias("until"))


def weekly_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and value of the seven days up to each order of a customer."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = orders.select("o_orderkey", "o_custkey", _micros("o_orderdate").alias("at"),
                         F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    framed = ordered.with_range_sum(rows, ["o_custkey"], "at", 7 * DAY, "price", "spent", "n_orders")
    return framed.select("o_orderkey", "o_custkey", F.col("spent").cast("double").alias("spent"),
                         "n_orders")


def region_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90th percentile of the metric for all subsets of region and locality."""
    out = grouping.grouping_sets(
        entities(spark, sf), grouping.cube(["region", "locality"]), "metric",
        {"median_metric": 0.5, "p90_metric": 0.9}, rows="entity_count")
    return out.withColumns({c: F.round(c, 6) for c in ("median_metric", "p90_metric")})


QUERIES = {f.__name__: f for f in (
    asof_views, asof_errors, events_around_errors, overlapping_orders, event_percentiles,
    event_ranks, event_gaps, weekly_spend, region_cube)}

ORACLE = {
    "asof_views": """
WITH v AS (SELECT user_id, ts AS view_ts, event_id AS view_id, value AS view_value
           FROM events WHERE event_type = 'view')
SELECT c.event_id, c.user_id, c.ts, view_ts, view_id, view_value
FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.view_ts""",
    "asof_errors": """
WITH r AS (SELECT ts AS error_ts, event_id AS error_id FROM events WHERE event_type = 'error')
SELECT e.event_id, e.ts, error_ts, error_id FROM events e ASOF JOIN r ON e.ts >= r.error_ts
WHERE error_ts + INTERVAL 10 MINUTES >= e.ts""",
    "events_around_errors": """
SELECT e.event_id AS error_id, count(*) AS n_events, min(p.event_id) AS first_event,
       sum(p.value::decimal(18,4))::double AS total_value
FROM events e JOIN events p ON p.ts BETWEEN e.ts - INTERVAL 10 MINUTES AND e.ts + INTERVAL 10 MINUTES
WHERE e.event_type = 'error' AND p.event_type = 'purchase' GROUP BY e.event_id""",
    "overlapping_orders": """
WITH s AS (
  SELECT o_custkey, o_orderkey, o_orderdate, max(l_shipdate) AS shipped
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT a.o_custkey AS customer, a.o_orderkey AS first_order, b.o_orderkey AS second_order
FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE a.o_orderdate <= a.shipped AND b.o_orderdate <= b.shipped
  AND a.o_orderdate <= b.shipped AND b.o_orderdate <= a.shipped""",
    "event_percentiles": """
SELECT event_id, value, ntile(100) OVER (ORDER BY value NULLS FIRST, event_id)::int AS hundredth
FROM events""",
    "event_ranks": """
SELECT event_id, event_type, value,
       rank() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST) AS rank FROM events""",
    "event_gaps": """
SELECT event_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS since,
       lead(epoch_us(ts)) OVER w - epoch_us(ts) AS until
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "weekly_spend": """
SELECT o_orderkey, o_custkey, (sum(o_totalprice::decimal(18,2)) OVER w)::double AS spent,
       count(o_totalprice) OVER w AS n_orders
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate
                         RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
}
