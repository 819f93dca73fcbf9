"""Running aggregates that stay distributed when one key holds most of the rows.

A plain window puts all rows of a key into one task. Here the rows of a key are cut
into order-preserving blocks: a window runs inside each block, the block totals are
scanned by a second, far smaller window, and the two are combined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))),
    "max": (F.max, lambda x, y: F.greatest(x, y)),
    "min": (F.min, lambda x, y: F.least(x, y)),
}


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    value: str,
    how: str,
    out: str,
    include_current: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Add ``out`` = aggregate of ``value`` over all rows before (and at) each row.

    ``block`` must be non-null and monotone in ``order``: rows of a lower block come
    earlier. ``descending`` scans from the largest row down.
    """
    fn, combine = AGGREGATES[how]
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    last = Window.currentRow if include_current else -1

    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, last)
    )
    # One row per (key, block); without keys this is one row per block in total.
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(direction(block))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        df.groupBy(*keys, block)
        .agg(fn(F.col(value)).alias("_total"))
        .select(*keys, block, fn(F.col("_total")).over(earlier).alias("_carry"))
    )
    scanned = df.withColumn("_inside", fn(F.col(value)).over(inside))
    return (
        scanned.join(carry, [*keys, block], "left")
        .withColumn(out, combine(F.col("_inside"), F.col("_carry")))
        .drop("_inside", "_carry")
    )
