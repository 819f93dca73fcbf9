"""Mix sources to target weights by replicating documents.

A source with weight w of the sum W, holding s of the corpus's S characters, gets the mean
repetition rate (w / W) * (S / s), so the mixture has about as many characters as the corpus
and the shares asked for. A document's number of copies is a Poisson number with that mean:
a hash of seed, id and text gives a uniform number, and the Poisson distribution is inverted
at it. So the result depends on nothing but the rows, and rows that are alike get the same
number of copies. A second hash, of the copy too, is its place in the global order.

Defined cases: a null source is a source of its own; a source without a target weight, or
with weight 0, is not in the mixture; a null or empty text counts as one character; repeated
rows are each replicated; an empty table gives an empty mixture. Columns of the input named
like an output (``copy``, ``n_copies``, ``place``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlift.llm.common import fresh_name, stored, whole_text
from tierlift.session import broadcast_if_small

SEED = 17
OUTPUTS = ["copy", "n_copies", "place"]


def _size(text_column: str):
    return F.greatest(F.length(whole_text(text_column)), F.lit(1)).cast("bigint")


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, size)``: characters per source, added up before the shuffle."""
    return docs.select(F.col(source).alias("source"), _size(text).alias("size")).groupBy(
        "source").agg(F.sum("size").alias("size"))


def tempered_targets(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Weights between the natural shares and equal ones: the root of each source's size."""
    return source_sizes(docs, source, text).select("source", F.sqrt("size").alias("weight"))


def repetition_rates(docs: DataFrame, targets: DataFrame, source: str = "source",
                     text: str = "text") -> DataFrame:
    """``(source, rate, cdf)``, one row per source with a weight above 0.

    ``cdf[k]`` is the probability of at most k copies, up to where it cannot be told from 1.
    """
    wanted = targets.select(F.col("source").alias("wanted"),
                            F.col("weight").cast("decimal(30,6)").alias("weight"))
    sizes = source_sizes(docs, source, text)
    held = sizes.join(wanted.where("weight > 0"), F.col("source").eqNullSafe(F.col("wanted")))
    held = held.select("source", "size", "weight")
    sums = held.agg(F.sum("weight").cast("double").alias("all_weight"),
                    F.sum("size").alias("all_size"))
    rates = held.join(sums).select(  # one row
        "source", (F.col("weight").cast("double") * F.col("all_size")
                   / (F.col("all_weight") * F.col("size"))).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("sum"),
                 F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda a, j: _step(a, j))
    return rates.select("source", "rate", steps.getField("cdf").alias("cdf"))


def _step(a, j):
    log_p = a.getField("log_p") + F.log("rate") - F.log(j.cast("double"))
    total = a.getField("sum") + F.exp(log_p)
    return F.struct(log_p.alias("log_p"), total.alias("sum"),
                    F.concat(a.getField("cdf"), F.array(total)).alias("cdf"))


def _hex(text, digits: int):
    """The first hexadecimal digits of a text's MD5 as an integer."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = SEED, id_column: str = "doc_id",
                source: str = "source", text: str = "text") -> DataFrame:
    """The mixture: input columns, ``copy`` (from 1), ``n_copies``, ``place``, in global order.

    ``targets`` has ``(source, weight)``. The rates, one row per source, are stored and
    broadcast if a count shows that they are few; a join with skew handling does it otherwise.
    """
    rates = stored(repetition_rates(docs, targets, source, text))
    key, held, cdf = (fresh_name(docs, x) for x in ("mix_key", "mix_source", "mix_cdf"))
    right = rates.select(F.col("source").alias(held), F.col("cdf").alias(cdf))
    keep = [c for c in docs.columns if c not in OUTPUTS]
    key_of = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"),
                                                           F.lit("")), F.md5(whole_text(text)))
    joined = docs.select(*keep, key_of.alias(key)).join(
        broadcast_if_small(right), F.col(source).eqNullSafe(F.col(held)))
    uniform = _hex(F.col(key), 13) / F.lit(float(1 << 52))
    counted = joined.withColumn("n_copies", F.size(F.filter(F.col(cdf), lambda c: c <= uniform)))
    copies = counted.where("n_copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = _hex(F.concat_ws(":", F.col(key), F.col("copy").cast("string")), 15)
    placed = copies.withColumn("place", place)
    return placed.repartitionByRange("place").sortWithinPartitions(
        "place", key).select(*keep, *OUTPUTS)


ORACLE_SQL = f"""
WITH d AS (
    SELECT *, greatest(length(coalesce(text, '')), 1) AS size,
           '{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key
    FROM documents),
sizes AS (
    SELECT source, sum(size)::BIGINT AS size, sqrt(sum(size)::DOUBLE)::DECIMAL(30,6) AS weight
    FROM d GROUP BY source),
rates AS (
    SELECT source, weight::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE
           / ((SELECT sum(weight) FROM sizes)::DOUBLE * size) AS rate FROM sizes),
steps AS (
    SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j
    FROM rates),
logs AS (
    SELECT source, j, sum(CASE WHEN j = 0 THEN -rate ELSE ln(rate) - ln(j) END)
        OVER (PARTITION BY source ORDER BY j) AS log_p FROM steps),
cdf AS (
    SELECT source, j, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY j) AS below FROM logs),
counted AS (
    SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source
        AND c.below <= ('0x' || substr(md5(d.key), 1, 13))::BIGINT / 4503599627370496.0)
        AS n_copies FROM d),
copies AS (
    SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0)
SELECT doc_id, source, text, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies,
       ('0x' || substr(md5(key || ':' || copy), 1, 15))::BIGINT AS place
FROM copies
"""
