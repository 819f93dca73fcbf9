"""Compare the rows of each bucket with each other, in tasks of bounded memory.

Rows with the same key stand next to each other after one shuffle, and a task compares them
bucket by bucket. A bucket with more than ``limit`` rows is only counted there; a second pass
cuts it into blocks and compares every pair of blocks in a task of its own, so it is compared
as completely as the small ones. What a comparison returns is a few rows per input row, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlift.llm.common import stored
from tierlift.session import broadcast_if_small

LIMIT = 2000
# compare(rows, first): links among rows, or, where ``first`` is a number, only between the
# first so many rows and the others.
Compare = Callable[[pa.Table, int | None], pa.Table | None]
Screen = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]
Pairs = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]
Reach = Callable[[np.ndarray], np.ndarray]
SCREENED = 16
# Pairs of rows that are screened at once.
AT_ONCE = 1 << 18


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        starts = _starts(rest, keys)
        if len(starts) > 1:
            yield rest.slice(0, int(starts[-1]))
            rest = rest.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def bucket_links(
    rows: DataFrame,
    keys: list[str],
    compare: Compare,
    schema: T.StructType,
    spread_by: str,
    limit: int = LIMIT,
    screen: Screen | None = None,
    pairs: Pairs | None = None,
    made: list[DataFrame] | None = None,
    screened: int = SCREENED,
    rising: str | None = None,
    reach: Reach | None = None,
) -> DataFrame:
    """Everything ``compare`` returns for the buckets; keys must be integers and not null.

    ``spread_by`` is the column by which the rows of a large bucket are dealt into blocks.
    ``screen`` tells at once for two sets of rows, pairwise, which might link; buckets of up to
    ``screened`` rows without such a pair are passed over, and ``pairs``, if given, makes the rows
    of all others of that size at once, from their pairs that might link. With ``rising``, a column
    by which the rows of a bucket ascend, ``reach`` tells the greatest value there of rows that a
    row might link to. Stored tables that the result reads are added to ``made``, for the caller to
    drop.
    """
    names = [f.name for f in schema.fields]
    marks = T.StructType([T.StructField("large", T.LongType())]
                         + [T.StructField(k, rows.schema[k].dataType) for k in keys]
                         + list(schema.fields))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(batches, keys, limit):
            if isinstance(table, tuple):
                yield _marked(table, keys, marks)
                continue
            starts = _starts(table, keys)
            ends = np.append(starts[1:], table.num_rows)
            many = np.flatnonzero(ends - starts > 1)
            done = []
            if screen is not None and len(many):
                left, right = _near_pairs(table, starts, ends, screened, screen,
                                          _last_near(table, starts, ends, rising, reach))
                if pairs is not None:
                    many = many[(ends - starts)[many] > screened]
                    done = [pairs(table, left, right)] if len(left) else []
                else:
                    run = np.repeat(np.arange(len(starts)), ends - starts)
                    good = np.union1d(run[left], many[(ends - starts)[many] > screened])
                    many = good.astype(many.dtype)
            found = done + [compare(table.slice(int(starts[i]), int(ends[i] - starts[i])), None)
                     for i in many]
            yield from _plain([f for f in found if f is not None and f.num_rows], marks)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [*keys, "low", "high"]
        for table in _runs(batches, pair):
            starts = _starts(table, pair)
            for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
                block = table.slice(int(a), int(b - a))
                own, low = block.column("own").to_numpy(), block.column("low")[0].as_py()
                same = low == block.column("high")[0].as_py()
                found = compare(block, None if same else int((own == low).sum()))
                if found is not None and found.num_rows:
                    yield from _plain([found], marks)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *([rising] if rising else []))
    first = stored(dealt.mapInArrow(first_pass, marks))
    if made is not None:
        made.append(first)
    large = first.where("large is not null").select(*keys, "large")
    out = first.where("large is null").select(*names)
    if large.isEmpty():
        return out
    blocks = F.ceil(F.col("large") / limit).cast("int")
    hot = rows.join(broadcast_if_small(large), keys).withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64(spread_by), F.col("blocks")).cast("int"))
    paired = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("low", F.least("own", "other")).withColumn(
        "high", F.greatest("own", "other")).drop("large", "blocks", "other")
    pair = [*keys, "low", "high"]
    dealt = paired.repartition(*pair).sortWithinPartitions(*pair, "own")
    return out.union(dealt.mapInArrow(second_pass, marks).select(*names))


def _last_near(table: pa.Table, starts: np.ndarray, ends: np.ndarray, rising: str | None,
               reach: Reach | None) -> np.ndarray | None:
    """For every row the last one of its bucket that it reaches."""
    if rising is None:
        return None
    value = table.column(rising).to_numpy().astype(np.int64)
    bucket = np.repeat(np.arange(len(starts)) << 40, ends - starts)
    return np.searchsorted(bucket + value, bucket + reach(value), "right") - 1


def _near_pairs(table: pa.Table, starts: np.ndarray, ends: np.ndarray, screened: int,
                screen: Screen, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of buckets of up to ``screened`` rows that might link, none beyond ``last``."""
    sizes = ends - starts
    place = np.arange(table.num_rows)
    # Rows that come after each one in its bucket.
    after = np.repeat(ends, sizes) - 1
    after = (after if last is None else np.minimum(after, last)) - place
    after[np.repeat(sizes > screened, sizes)] = 0
    rows = np.flatnonzero(after > 0)
    after = after[rows]
    total = np.cumsum(after)
    none = np.array([], dtype=np.int64)
    left, right, a = [none], [none], 0
    while a < len(rows):
        before = total[a] - after[a]
        b = max(a + 1, int(np.searchsorted(total, before + AT_ONCE, "right")))
        first = np.repeat(rows[a:b], after[a:b])
        second = first + 1 + np.arange(len(first)) - np.repeat(total[a:b] - after[a:b] - before, after[a:b])
        good = screen(table, first, second)
        left.append(first[good])
        right.append(second[good])
        a = b
    return np.concatenate(left), np.concatenate(right)


def _bounded(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int):
    """Tables of whole small buckets; ``(key values, rows)`` for each bucket over the limit."""
    rest: pa.Table | None = None
    over: tuple | None = None  # key and rows of a large bucket that goes on
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if over is not None:
            same = np.ones(now.num_rows, dtype=bool)
            for k, v in zip(keys, over[0]):
                same &= now.column(k).to_numpy() == v
            n = int(same.sum())  # sorted, so they come first
            over = (over[0], over[1] + n)
            if n == now.num_rows:
                continue
            yield over
            over, now = None, now.slice(n)
        rest = now if rest is None else pa.concat_tables([rest, now])
        starts = _starts(rest, keys)
        ends = np.append(starts[1:], rest.num_rows)
        low = 0
        for i in np.flatnonzero(ends - starts > limit):
            a, b = int(starts[i]), int(ends[i])
            if a > low:
                yield rest.slice(low, a - low)
            key = tuple(rest.column(k)[a].as_py() for k in keys)
            if b == rest.num_rows:
                over = (key, b - a)
            else:
                yield key, b - a
            low = b
        if over is not None:
            rest = None
        else:
            last = max(int(starts[-1]), low)
            if last > low:
                yield rest.slice(low, last - low)
            rest = rest.slice(last)
    if over is not None:
        yield over
    elif rest is not None and rest.num_rows:
        yield rest


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _marked(mark: tuple, keys: list[str], marks: T.StructType) -> pa.RecordBatch:
    values = {"large": mark[1], **dict(zip(keys, mark[0]))}
    return pa.RecordBatch.from_pydict({
        f.name: pa.array([values.get(f.name)], type=_arrow_type(f.dataType))
        for f in marks.fields})


def _plain(found: list[pa.Table], marks: T.StructType) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    table = pa.concat_tables(found)
    columns = {
        f.name: table.column(f.name).cast(_arrow_type(f.dataType))
        if f.name in table.column_names
        else pa.nulls(table.num_rows, type=_arrow_type(f.dataType)) for f in marks.fields}
    yield from pa.table(columns).combine_chunks().to_batches(max_chunksize=50_000)


def local_components(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def hamming_near(bits: np.ndarray, radius: int, first: int | None, step: int = 512) -> np.ndarray:
    """Which rows of 64-bit words differ in at most ``radius`` bits, as a symmetric matrix."""
    n = len(bits)
    near = np.zeros((n, n), dtype=bool)
    for i in range(0, n, step):
        apart = np.zeros((min(step, n - i), n), dtype=np.uint16)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[i:i + step, w, None] ^ bits[None, :, w])
        near[i:i + step] = apart <= radius
    if first is not None:
        near[:first, :first] = False
        near[first:, first:] = False
    np.fill_diagonal(near, False)
    return near
