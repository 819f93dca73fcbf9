"""As-of and interval joins without a task per key and without comparing everything.

``asof_join`` merges both sides into one order, cut into range partitions, and carries the last
row of the right side forward; a key that holds most rows covers many partitions.

``interval_join`` deals intervals into bins as wide as the intervals are long, so an interval
touches few bins and a bin holds few rows that do not overlap. Bins of different widths meet at
the wider one. A pair is found in the bin where the later of the two starts, and only there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.operators.ordered import with_last_value


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str,
              right_time: str, tolerance: Column | None = None, how: str = "left",
              tie: list[str] | None = None) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of its key at or before its time.

    Keys are columns of both sides; null keys and null times match nothing. Of right rows of
    one time that with the largest ``tie`` columns counts (else the largest row). The columns of
    ``right`` follow those of ``left``; names must differ but for the keys. ``tolerance`` is an
    interval: older matches do not count. ``how`` is left or inner.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    values = [c for c in right.columns if c not in keys]
    first = [*(tie or []), *[c for c in values if c not in (tie or [])]]
    usable = right.where(F.col(right_time).isNotNull())
    for k in keys:
        usable = usable.where(F.col(f"`{k}`").isNotNull())
    time = usable.schema[right_time].dataType
    # One row per key and time, combined before the shuffle.
    events = usable.groupBy(*keys, F.col(right_time).alias("_time")).agg(
        F.max(F.struct(*first)).alias("_right"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rows = left.select(*keys, F.col(left_time).cast(time).alias("_time"), row.alias("_left"))
    none = F.lit(None)
    both = events.select(*keys, "_time", F.lit(0).alias("_side"), "_right",
                         none.cast(rows.schema["_left"].dataType).alias("_left")).unionByName(
        rows.select(*keys, "_time", F.lit(1).alias("_side"),
                    none.cast(events.schema["_right"].dataType).alias("_right"), "_left"))
    filled = with_last_value(both, keys, [F.col("_time").asc_nulls_first(), "_side"],
                             "_right", "_match").where("_side = 1")
    usable_row = F.col("_time").isNotNull()
    for k in keys:
        usable_row = usable_row & F.col(f"`{k}`").isNotNull()
    if tolerance is not None:
        usable_row = usable_row & (F.col(f"_match.`{right_time}`") + tolerance >= F.col("_time"))
    matched = filled.withColumn("_match", F.when(usable_row, F.col("_match")))
    if how == "inner":
        matched = matched.where("_match is not null")
    return matched.select("_left.*", *[F.col(f"_match.`{c}`").alias(c) for c in values])


# An interval is dealt at a width between one and ``STEP`` times its length.
STEP = 4.0


def _number(df: DataFrame, column: str) -> Column:
    """Times in microseconds, dates in days, numbers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def _levels(df: DataFrame) -> list[int]:
    """Widths that occur; there are as many as powers of ``STEP`` between the lengths."""
    return sorted(r["_level"] for r in df.select("_level").distinct().collect())


def _binned(df: DataFrame, levels: list[int]) -> DataFrame:
    """A row per interval, level at or above its own, and bin it touches there."""
    at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_level")))
    wide = df.withColumn("_at", at)
    width = F.pow(F.lit(STEP), F.col("_at"))
    return wide.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("_from") / width).cast("bigint"),
        F.floor(F.col("_to") / width).cast("bigint"))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str],
                  right_span: tuple[str, str], unit: float = 1.0) -> DataFrame:
    """Pairs of rows whose closed intervals overlap: ``l.start <= r.end and r.start <= l.end``.

    A point is an interval from a column to itself. Keys are columns of both sides; null keys,
    ends that are null, NaN or infinite, and intervals that end before they start match nothing. The columns of ``right``
    follow those of ``left``; names must differ but for the keys. Ends are compared as doubles
    (times in microseconds). ``unit`` is the narrowest bin; it only steers speed.
    """
    def prepared(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        start, end = (_number(df, c) for c in span)
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns if side == "_left" or c not in keys])
        out = df.select(*keys, start.alias("_from"), end.alias("_to"), row.alias(side)).where(
            "_from <= _to and abs(_from) < double('inf') and abs(_to) < double('inf')")
        for k in keys:
            out = out.where(F.col(f"`{k}`").isNotNull())
        length = F.greatest(F.col("_to") - F.col("_from"), F.lit(unit))
        return out.withColumn("_level", F.ceil(F.log(length) / F.log(F.lit(STEP)) - 1e-9).cast("int"))

    a, b = prepared(left, left_span, "_left"), prepared(right, right_span, "_right")
    levels = sorted({*_levels(a), *_levels(b)}) or [0]
    a = _binned(a, levels)
    b = _binned(b, levels).withColumnsRenamed(
        {"_from": "_from2", "_to": "_to2", "_level": "_level2"})
    width = F.pow(F.lit(STEP), F.col("_at"))
    # The wider of the two has its own level; the later start names the bin that reports.
    owner = (F.col("_at") == F.greatest("_level", "_level2")) & (
        F.col("_bin") == F.floor(F.greatest("_from", "_from2") / width))
    overlap = (F.col("_from") <= F.col("_to2")) & (F.col("_from2") <= F.col("_to"))
    joined = a.join(b, [*keys, "_at", "_bin"]).where(owner & overlap)
    return joined.select("_left.*", "_right.*")
