"""Window functions over an order, without a task per key.

A plain window puts a key, or without keys the whole table, into one task. Here the table is
sorted into range partitions of (keys, order), so a large key covers many of them. Each range
partition is a block. What a window needs from earlier blocks is one row per block and key; a
later scan over those few rows gives it to each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlift.session import cut_lineage

BLOCK, PLACE = "_block", "_place"


def in_blocks(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` stored in range partitions, with ``_block`` and, ascending inside it, ``_place``.

    Rows that are equal in all of it are parted by the number of their reading, so a value held
    by most rows is cut as well. The table is stored since Spark samples the borders anew
    whenever it sorts.
    """
    columns = [F.col(f"`{k}`").asc_nulls_first() for k in keys] + list(order)
    numbered = df.withColumn("_copy", F.monotonically_increasing_id())
    dealt = (numbered.repartitionByRange(*columns, "_copy")
             .sortWithinPartitions(*columns, "_copy").drop("_copy"))
    number = F.monotonically_increasing_id()
    return cut_lineage(dealt.withColumn(BLOCK, F.shiftright(number, 33)).withColumn(
        PLACE, number.bitwiseAND((1 << 33) - 1)))


def _earlier(keys: list[str]) -> Window:
    return (Window.partitionBy(*keys).orderBy(BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join null-safely on ``keys``, which stay once, those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`"))
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def with_row_numbers(df: DataFrame, keys: list[str], order: list[Column | str],
                     out: str = "row_number", total: str | None = None) -> DataFrame:
    """Add ``row_number() over (partition by keys order by order)`` and, if named, the rows of
    the key. Rows that tie in the order are numbered in any order."""
    blocked = in_blocks(df, keys, order)
    # A block's rows of one key lie side by side, so the number is the place less the first one.
    sizes = blocked.groupBy(*keys, BLOCK).agg(
        F.min(PLACE).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    placed = sizes.select(
        *keys, BLOCK, (F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0))
                       - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_total"))
    out_columns = [(F.col(PLACE) + F.col("_shift") + 1).alias(out)]
    if total:
        out_columns.append(F.col("_total").alias(total))
    kept = [c for c in df.columns if c not in (out, total)]
    return join_same(blocked, placed, [BLOCK, *keys], "inner").select(
        *[F.col(f"`{c}`") for c in kept], *out_columns)


def with_ntile(df: DataFrame, keys: list[str], order: list[Column | str], tiles: int,
               out: str = "ntile") -> DataFrame:
    """Add ``ntile(tiles) over (partition by keys order by order)``: the first tiles are one
    longer where rows do not divide evenly."""
    numbered = with_row_numbers(df, keys, order, "_number", "_of")
    place, short = F.col("_number") - 1, F.floor(F.col("_of") / tiles)
    long_tiles = F.col("_of") % tiles
    border = long_tiles * (short + 1)
    tile = F.when(place < border, F.floor(place / (short + 1))).otherwise(
        long_tiles + F.floor((place - border) / short)) + 1
    return numbered.withColumn(out, tile.cast("int")).drop("_number", "_of")


def with_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank",
              descending: bool = False) -> DataFrame:
    """Add ``rank() over (partition by keys order by order)``, nulls last.

    Ranks are those of the distinct order values, counted before anything is sorted.
    """
    values = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_rows"))
    columns = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
               for c in order]
    summed = with_running_sum(values, keys, columns, "_rows", "_upto")
    ranked = summed.select(*keys, *order, (F.col("_upto") - F.col("_rows") + 1).alias(out))
    return join_same(df, ranked, [*keys, *order], "inner")


def with_running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: str,
                     out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and with this one."""
    blocked = in_blocks(df, keys, order)
    inside = (Window.partitionBy(BLOCK, *keys).orderBy(PLACE)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = blocked.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_sum")).select(
        *keys, BLOCK, F.sum("_sum").over(_earlier(keys)).alias("_carry")).where(
        "_carry is not null")
    # Only the first key of a block began before it, so there is a row per block at most.
    summed = blocked.withColumn("_inside", F.sum(value).over(inside))
    return join_same(summed, F.broadcast(carried), [BLOCK, *keys], "left").withColumn(
        out, F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop(
        "_inside", "_carry", BLOCK, PLACE)


def with_last_value(df: DataFrame, keys: list[str], order: list[Column | str], value: str,
                    out: str) -> DataFrame:
    """Add the last value that is not null at or before each row of the key."""
    blocked = in_blocks(df, keys, order)
    inside = (Window.partitionBy(BLOCK, *keys).orderBy(PLACE)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(PLACE)))
    carried = blocked.groupBy(*keys, BLOCK).agg(last.alias("_last")).select(
        *keys, BLOCK, F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_carry")
    ).where("_carry is not null")
    # Only the first key of a block began before it, so there is a row per block at most.
    filled = blocked.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return join_same(filled, F.broadcast(carried), [BLOCK, *keys], "left").withColumn(
        out, F.coalesce("_inside", "_carry")).drop("_inside", "_carry", BLOCK, PLACE)


def with_neighbour(df: DataFrame, keys: list[str], order: list[Column | str], value: str,
                   out: str, offset: int = 1) -> DataFrame:
    """Add ``value`` of the row ``offset`` places before (behind, if negative); null if none."""
    numbered = cut_lineage(with_row_numbers(df, keys, order, "_number"))
    other = numbered.select(*keys, (F.col("_number") + offset).alias("_number"),
                            F.col(value).alias(out))
    return join_same(numbered, other, [*keys, "_number"], "left").drop("_number")


def with_range_sum(df: DataFrame, keys: list[str], at: str, reach: int | float, value: str,
                   out_sum: str, out_count: str) -> DataFrame:
    """Sum and count of ``value`` over rows of the key with ``at`` in ``[at - reach, at]``.

    ``at`` is a number; nulls have no frame and get null. Values are first summed per distinct
    ``at``. The frame is the running sum at its end less that before its start; the latter is
    found by carrying running sums forward over the union of both kinds of places. Sums of
    decimals and integers are exact; those of doubles are as good as differences of running sums.
    """
    points = df.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"))
    upto = with_running_sum(
        points.withColumn("_sc", F.col("_c")), keys, [at], "_s", "_upto_s")
    upto = cut_lineage(with_running_sum(upto, keys, [at], "_sc", "_upto_c"))
    zero = upto.select(*keys, F.col(at).alias("_p"), F.lit(0).alias("_kind"),
                       F.struct("_upto_s", "_upto_c").alias("_held"),
                       F.lit(None).cast(df.schema[at].dataType).alias("_of"))
    # The value exactly ``reach`` before belongs to the frame, so starts come before points.
    starts = upto.select(*keys, (F.col(at) - reach).cast(df.schema[at].dataType).alias("_p"),
                         F.lit(-1).alias("_kind"),
                         F.lit(None).cast(zero.schema["_held"].dataType).alias("_held"),
                         F.col(at).alias("_of"))
    before = with_last_value(zero.unionByName(starts), keys, ["_p", "_kind"], "_held", "_before")
    before = before.where("_kind = -1").select(*keys, F.col("_of").alias(at), "_before")
    frames = join_same(upto, before, [*keys, at], "inner").select(
        *keys, at,
        (F.col("_upto_s") - F.coalesce("_before._upto_s", F.lit(0))).alias(out_sum),
        (F.col("_upto_c") - F.coalesce("_before._upto_c", F.lit(0))).alias(out_count))
    return join_same(df, frames, [*keys, at], "left")
