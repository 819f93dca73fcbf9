"""Grouping sets with exact quantiles and distinct counts.

Rows are counted once per finest cell and value. The cells of a coarser set are sums over those
of the smallest set above it that is already there, never over the rows again; a different
value is a row of a set's cells, so distinct counts are row counts. Order statistics are read
from running counts over all sets at once, which are cut into blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlift.operators.ordered import join_same, with_running_sum
from tierlift.session import cut_lineage


def cube(dimensions: list[str]) -> list[tuple[str, ...]]:
    """All subsets, the largest first."""
    return [s for n in range(len(dimensions), -1, -1) for s in combinations(dimensions, n)]


def rollup(dimensions: list[str]) -> list[tuple[str, ...]]:
    return [tuple(dimensions[:n]) for n in range(len(dimensions), -1, -1)]


def value_cells(df: DataFrame, sets: list[tuple[str, ...]], value: str) -> DataFrame:
    """``(_set, dimensions, _value, _rows)``: rows per set, its cell and value.

    ``_set`` is the place in ``sets``; dimensions outside a set are null.
    """
    dimensions = list(dict.fromkeys(d for s in sets for d in s))
    finest = df.groupBy(*dimensions, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows"))
    tables = {frozenset(dimensions): cut_lineage(finest)}
    parts = []
    for s in sorted(set(sets), key=lambda s: (-len(s), sets.index(s))):
        if frozenset(s) not in tables:
            above = min((t for t in tables if t > frozenset(s)), key=len)
            tables[frozenset(s)] = cut_lineage(
                tables[above].groupBy(*s, "_value").agg(F.sum("_rows").alias("_rows")))
        parts.append(tables[frozenset(s)].select(
            F.lit(sets.index(s)).alias("_set"), *[
                F.col(d) if d in s else F.lit(None).cast(df.schema[d].dataType).alias(d)
                for d in dimensions], "_value", "_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], value: str,
                  quantiles: dict[str, float], rows: str = "n_rows",
                  distinct: str = "n_distinct", level: str = "level") -> DataFrame:
    """A row per set and cell: rows, distinct values and exact quantiles of ``value``.

    ``level`` is the place of the set in ``sets``, so a null dimension value and a dimension
    that is summed over differ. Null values are rows but no values.
    """
    dimensions = list(dict.fromkeys(d for s in sets for d in s))
    keys = ["_set", *dimensions]
    cells = value_cells(df, sets, value)
    totals = cells.groupBy(*keys).agg(
        F.sum("_rows").alias(rows), F.count("_value").alias(distinct),
        F.sum(F.when(F.col("_value").isNotNull(), F.col("_rows"))).alias("_n"))
    scanned = with_running_sum(cells.where("_value is not null"), keys, ["_value"], "_rows", "_upto")
    ranked = join_same(scanned, totals.select(*keys, "_n"), keys, "inner")
    picked, mixed = [], []
    for i, (out, q) in enumerate(quantiles.items()):
        at = (F.col("_n") - 1) * F.lit(float(q))
        for name, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            picked.append(F.min(F.when(F.col("_upto") > rank, F.col("_value").cast("double")))
                          .alias(f"_{name}{i}"))
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        mixed.append(F.when(a == b, a).otherwise(
            (F.ceil(at) - at) * a + (at - F.floor(at)) * b).alias(out))
    found = ranked.groupBy(*keys).agg(*picked)
    return join_same(totals, found, keys, "left").select(
        F.col("_set").alias(level), *dimensions, rows, distinct, *mixed)
