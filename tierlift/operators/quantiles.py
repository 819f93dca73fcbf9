"""Exact grouped quantiles with linear interpolation, one way for every size.

The order statistics of a group are read from counts of its different values, combined before
the shuffle. A task may hold so many of them only, so a group with more values is narrowed
first: bounded sketches bracket each wanted rank, and values outside its bracket become minus
or plus infinity, which keeps every rank in its place. Narrowing goes on until what lies inside
the brackets fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlift.session import broadcast_if_small, cut_lineage

Spec = tuple[str, float]
# Values of one group and column that a task may hold, about 60 bytes each.
HELD = 200_000
# A sketch errs by a tenth of a step; a bracket reaches two steps past the wanted rank.
STEPS = 500
INFINITY = float("inf")


def _at(column: str) -> Column:
    """The value as it is ordered: sketches compare numbers, so NaN counts as infinite."""
    return F.nanvl(F.col(column).cast("double"), F.lit(INFINITY))


def _matched(df: DataFrame, brackets: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(brackets[f"_of_{k}"])
    return df.join(broadcast_if_small(brackets), on, how)


def _brackets(df: DataFrame, keys: list[str], quantiles: dict[str, Spec],
              large: DataFrame, held: int) -> DataFrame:
    """``(_of_<key> …, _low<i>, _high<i>)`` for the large groups."""
    specs = list(enumerate(quantiles.values()))
    now = large.select(*[F.col(f"`{k}`").alias(f"_of_{k}") for k in keys],
                       *[F.lit(sign * INFINITY).alias(f"_{side}{i}") for i, _ in specs
                         for side, sign in (("low", -1), ("high", 1))])
    while True:
        rows = _matched(df, now, keys, "inner")
        parts = []
        for i, (c, _) in specs:
            at, low, high = _at(c), F.col(f"_low{i}"), F.col(f"_high{i}")
            inside = F.when((at >= low) & (at <= high), at)
            grid = [s / STEPS for s in range(STEPS + 1)]
            parts += [F.percentile_approx(inside, grid, 10 * STEPS).alias(f"_s{i}"),
                      F.count(inside).alias(f"_m{i}"), F.count_if(at < low).alias(f"_b{i}"),
                      F.count(c).alias(f"_n{i}")]
        sketched = rows.groupBy(*[c for c in now.columns if c.startswith("_of_")]).agg(*parts)
        edges, left = [], F.lit(0)
        for i, (_, q) in specs:
            m, rank = F.col(f"_m{i}"), (F.col(f"_n{i}") - 1) * F.lit(float(q))
            # A column without values in the group has no rank and no bracket.
            first = F.floor(F.try_divide(F.floor(rank) - F.col(f"_b{i}"), m) * STEPS) - 2
            last = F.ceil(F.try_divide(F.ceil(rank) - F.col(f"_b{i}") + 1, m) * STEPS) + 2
            first = F.when(m > 0, F.greatest(first, F.lit(0)).cast("int"))
            last = F.when(m > 0, F.least(last, F.lit(STEPS)).cast("int"))
            low, high = F.get(f"_s{i}", first), F.get(f"_s{i}", last)
            edges += [low.alias(f"_low{i}"), high.alias(f"_high{i}")]
            # Equal values are one, so a bracket that is one value needs no room.
            wide = low < high
            left = F.greatest(left, F.when(wide, m * (last - first + 1) / STEPS))
        narrowed = cut_lineage(sketched.select(
            *[c for c in now.columns if c.startswith("_of_")], *edges, left.alias("_left"),
            F.greatest(F.lit(0), *[f"_m{i}" for i, _ in specs]).alias("_had")))
        now = narrowed.drop("_left", "_had")
        # Brackets of few different values can't get narrower; these fit as they are.
        if narrowed.where((F.col("_left") > held) & (F.col("_left") < F.col("_had"))).isEmpty():
            return now


def aggregate_with_quantiles(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    quantiles: dict[str, Spec],
    held: int = HELD,
) -> DataFrame:
    """``groupBy(keys).agg(aggregates)`` plus exact quantile columns ``{out: (column, q)}``.

    Nulls do not count; NaN is larger than any number; a group without values gets null. Null
    keys are a group like any other.
    """
    columns = sorted({c for c, _ in quantiles.values()})
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)])
    large = cut_lineage(counts.where(F.greatest(
        F.lit(0), *[f"_{i}" for i in range(len(columns))]) > held))
    narrow = not large.isEmpty()
    rows = df
    if narrow:
        rows = _matched(df, _brackets(df, keys, quantiles, large, held), keys, "left")
    found = []
    for i, (out, (c, q)) in enumerate(quantiles.items()):
        value = F.col(c).cast("double")
        if not narrow:
            found.append(F.percentile(value, float(q)).alias(out))
            continue
        at, low, high = _at(c), F.col(f"_low{i}"), F.col(f"_high{i}")
        kept = F.when(at < low, -INFINITY).when(at > high, INFINITY).otherwise(value)
        rank = (F.count(c) - 1) * F.lit(float(q))
        missed = (F.count_if(at < low) > F.floor(rank)) | (
            F.count(c) - F.count_if(at > high) <= F.ceil(rank))
        found.append(F.when(missed & (F.count(c) > 0), F.raise_error(
            F.lit("quantile sketch missed its rank"))).otherwise(
            F.percentile(kept, float(q))).alias(out))
    return rows.groupBy(*[df[k] for k in keys]).agg(*aggregates, *found)


def quantile_value(df: DataFrame, column: str, q: float) -> Column:
    """One global quantile as a scalar subquery; nulls count as zero."""
    filled = df.select(F.coalesce(F.col(column), F.lit(0.0)).alias("_v"))
    return aggregate_with_quantiles(filled, [], [], {"q": ("_v", q)}).scalar()
