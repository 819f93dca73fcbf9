"""Pairs and triples of the items of an entity, made and counted as arrays.

Rows come to a task sorted by entity, or by the part of a wide one, and rank. Some hundred thousand
rows at a time are expanded into pairs of row numbers, so an entity that comes with several rows an
item counts for each of them, as in a join; counts leave the task added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows looked at together, combinations made at once, counters of a plain table of counts, and
# rows of counts that a task holds.
POOL_ROWS = 200_000
MADE_AT_ONCE = 1 << 20
COUNTERS = 1 << 21
HELD_COUNTS = 1_000_000


def pools(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Batches of sorted rows put together; rows of one key are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= POOL_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.flatnonzero(_changes(table, key))[-1]
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row is the first one or differs from the row before."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for c in columns:
        values = table.column(c)
        out[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy()
    return out


def _ends(first: np.ndarray) -> np.ndarray:
    """For every row the end of its run; ``first`` marks the rows that begin one."""
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(first)))
    return np.repeat(starts + sizes, sizes)


def _expanded(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(x, y)`` for every place ``x`` and all ``y`` from its start to its end, some at a time."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = total[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(total, before + MADE_AT_ONCE, "right")))
        some = sizes[a:b]
        shift = starts[a:b] - (total[a:b] - some - before)
        yield (np.repeat(np.arange(a, b), some),
               np.arange(total[b - 1] - before) + np.repeat(shift, some))
        a = b


def _groups(pool: pa.Table, by: list[str]) -> tuple[np.ndarray, int, Callable]:
    """Numbers for the values of ``by``, how many there may be, and the way back to values."""
    number, kinds, listed = np.zeros(pool.num_rows, dtype=np.int64), 1, []
    for c in by:
        coded = pool.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        number = number * len(coded.dictionary) + coded.indices.to_numpy()
        kinds *= len(coded.dictionary)
        listed.append(coded.dictionary)

    def values(numbers: np.ndarray) -> list[pa.Array]:
        out = []
        for dictionary in reversed(listed):
            out.append(dictionary.take(pa.array(numbers % len(dictionary))))
            numbers = numbers // len(dictionary)
        return out[::-1]

    return number, kinds, values


def _tops(pool: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Label bits, and which are known if not all are."""
    top = pool.column("top")
    known = top.is_valid().to_numpy().astype(np.float64) if top.null_count else None
    return top.fill_null(0).to_numpy().astype(np.float64), known


def _tally(key: np.ndarray, kinds: int, top: np.ndarray, known: np.ndarray | None):
    """``(keys, rows, sum of top or null)`` of the different keys, numbers below ``kinds``."""
    if kinds <= COUNTERS:
        counts = np.bincount(key, minlength=kinds)
        at = np.flatnonzero(counts)
        n, place = counts[at], key
    else:
        at, place, n = np.unique(key, return_inverse=True, return_counts=True)

    def total(weights: np.ndarray) -> np.ndarray:
        sums = np.bincount(place, weights=weights)
        return sums[at] if kinds <= COUNTERS else sums

    a = pa.array(total(top).astype(np.int64), mask=None if known is None else total(known) == 0)
    return at, pa.array(n.astype(np.int64)), a


def _added(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Tables whose last columns are ``n`` and ``a``, added up by the others."""
    held: list[pa.Table] = []
    for part in parts:
        held.append(part)
        if sum(t.num_rows for t in held) > HELD_COUNTS:
            held = [_sum(held)]
            if held[0].num_rows > HELD_COUNTS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _sum(held).to_batches()


def _sum(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    keys = whole.column_names[:-2]
    return whole.group_by(keys).aggregate([("n", "sum"), ("a", "sum")]).select(
        [*keys, "n_sum", "a_sum"]).rename_columns(whole.column_names)


def pairs_of(by: list[str], block: list[str]):
    """Counts ``(*by, i, j, n, a)`` of pairs ``i < j`` of the ranks of a block.

    With columns ``_p`` and ``_q`` that differ, only pairs of rows of different ``_tile`` count.
    """
    def count(pool: pa.Table) -> Iterator[pa.Table]:
        first = _changes(pool, block)
        ranks, code = np.unique(pool.column("r").to_numpy(), return_inverse=True)
        group, kinds, values = _groups(pool, by)
        top, known = _tops(pool)
        m = len(ranks)
        mixed = None
        if "_tile" in pool.column_names:
            mixed = pool.column("_p").to_numpy() != pool.column("_q").to_numpy()
            tile = pool.column("_tile").to_numpy()
        for x, y in _expanded(_ends(first | _changes(pool, ["r"])), _ends(first)):
            if mixed is not None:
                kept = ~mixed[x] | (tile[x] != tile[y])
                x, y = x[kept], y[kept]
            at, n, a = _tally((group[x] * m + code[x]) * m + code[y], kinds * m * m, top[x],
                              None if known is None else known[x])
            yield pa.Table.from_arrays(
                [*values(at // (m * m)), pa.array(ranks[at // m % m]), pa.array(ranks[at % m]),
                 n, a], names=[*by, "i", "j", "n", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(t for pool in pools(batches, block) for t in count(pool))

    return run


def triples_of(seeds: np.ndarray, by: list[str], block: list[str]):
    """Counts ``(*by, i, j, k, n, a)`` of the pairs listed, ``i < j``, with every rank ``k > j``.

    With columns ``_part`` and ``_parts`` a block makes the triples of its own first members only.
    """
    codes = np.unique(seeds[:, 0] << 32 | seeds[:, 1])
    listed = np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1)
    members = np.unique(listed)

    def count(pool: pa.Table) -> Iterator[pa.Table]:
        first = _changes(pool, block)
        r = pool.column("r").to_numpy()
        ranks, code = np.unique(r, return_inverse=True)
        group, kinds, values = _groups(pool, by)
        top, known = _tops(pool)
        m, s = len(ranks), len(listed)
        run_end, last = _ends(first | _changes(pool, ["r"])), _ends(first)
        # Pairs are made of the rows of listed items only.
        rows = np.flatnonzero(np.isin(r, members))
        own = None
        if "_part" in pool.column_names:
            own = r % pool.column("_parts").to_numpy() == pool.column("_part").to_numpy()
        places = np.searchsorted(rows, run_end[rows]), np.searchsorted(rows, last[rows])
        if own is not None:
            places = places[0], np.where(own[rows], places[1], places[0])
        for x, y in _expanded(*places):
            x, y = rows[x], rows[y]
            pair = r[x].astype(np.int64) << 32 | r[y]
            seed = np.minimum(np.searchsorted(codes, pair), s - 1)
            found = codes[seed] == pair
            x, y, seed = x[found], y[found], seed[found]
            for p, z in _expanded(run_end[y], last[y]):
                at, n, a = _tally((group[x[p]] * s + seed[p]) * m + code[z], kinds * s * m,
                                  top[x[p]], None if known is None else known[x[p]])
                pick = listed[at // m % s].astype(r.dtype)
                yield pa.Table.from_arrays(
                    [*values(at // (m * s)), pa.array(pick[:, 0]), pa.array(pick[:, 1]),
                     pa.array(ranks[at % m]), n, a], names=[*by, "i", "j", "k", "n", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(listed):
            yield from _added(t for pool in pools(batches, block) for t in count(pool))

    return run
