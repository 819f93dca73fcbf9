from itertools import product

import pyarrow as pa
import pytest

from tierlift.operators import bundles as mining
from tierlift.operators import combinations

ROWS = [
    # (entity, rank, top, region): entity 1 comes twice, in two regions; labels may be unknown.
    (1, 1, 1, "a"), (1, 1, 0, "b"), (1, 2, 1, "a"), (1, 2, 0, "b"), (1, 4, 1, "a"), (1, 4, 0, "b"),
    (2, 1, None, None), (2, 3, None, None), (2, 4, None, None), (3, 2, 1, "a"), (3, 3, 1, "a"),
    (3, 4, 1, "a"), (4, 5, 1, "b"), *[(5, r, 0, "b") for r in range(1, 8)],
]


def brute(rows, seeds=None, by_region=True):
    sums = {}
    for x, y in product(rows, rows):
        if x[0] != y[0] or x[1] >= y[1]:
            continue
        ends = [()] if seeds is None else [
            (z[1],) for z in rows if z[0] == x[0] and z[1] > y[1] and (x[1], y[1]) in seeds]
        for end in ends:
            key = (*([x[3]] if by_region else []), x[1], y[1], *end)
            n, a = sums.get(key, (0, None))
            sums[key] = (n + 1, a if x[2] is None else (a or 0) + x[2])
    return sums


@pytest.mark.parametrize("tile", [2, 512])
@pytest.mark.parametrize("pool", [3, 200_000])
def test_repeated_entities_unknown_labels_and_regions(spark, monkeypatch, tile, pool):
    monkeypatch.setattr(combinations, "POOL_ROWS", pool)
    monkeypatch.setattr(combinations, "MADE_AT_ONCE", pool)
    coded = spark.createDataFrame(ROWS, "entity_id long, r int, top int, region string")
    for by in ((), ("region",)):
        got = {tuple(r)[:-2]: tuple(r)[-2:] for r in mining.pair_counts(
            coded, 1, tile_items=tile, by=by).collect()}
        assert got == brute(ROWS, by_region=bool(by))
    seeds = [(1, 2), (2, 4), (3, 4)]
    got = {tuple(r)[:-2]: tuple(r)[-2:] for r in mining.triple_counts(
        coded, spark.createDataFrame(seeds, "i int, j int"), 1, by=("region",)).collect()}
    assert got == brute(ROWS, seeds)


def test_combinations_in_arrays_equal_brute_force(monkeypatch):
    monkeypatch.setattr(combinations, "POOL_ROWS", 3)
    monkeypatch.setattr(combinations, "MADE_AT_ONCE", 2)
    monkeypatch.setattr(combinations, "COUNTERS", 1)
    monkeypatch.setattr(combinations, "HELD_COUNTS", 4)
    rows = sorted(ROWS, key=lambda r: r[:2])
    whole = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([
        ("entity_id", pa.int64()), ("r", pa.int32()), ("top", pa.int32()), ("region", pa.string())])})
    run = combinations.pairs_of(["region"], ["entity_id"])
    sums = {}
    for batch in run(iter(whole.to_batches(max_chunksize=2))):
        for r in batch.to_pylist():
            key = (r["region"], r["i"], r["j"])
            n, a = sums.get(key, (0, None))
            sums[key] = (n + r["n"], a if r["a"] is None else (a or 0) + r["a"])
    assert sums == brute(ROWS)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_and_triples_are_not_joined(spark):
    coded = spark.createDataFrame(ROWS, "entity_id long, r int, top int, region string")
    seeds = spark.createDataFrame([(1, 2)], "i int, j int")
    assert "Join" not in plan_of(mining.pair_counts(coded, 1))
    assert "Join" not in plan_of(mining.triple_counts(coded, seeds, 1))


@pytest.mark.parametrize("tile", [None, 2, 512])
def test_triples_of_all_pairs_in_parts(spark, tile):
    coded = spark.createDataFrame(ROWS, "entity_id long, r int, top int, region string")
    seeds = sorted({k[-2:] for k in brute(ROWS, by_region=False)})
    got = {tuple(r)[:-2]: tuple(r)[-2:] for r in mining.triple_counts(
        coded, spark.createDataFrame(seeds, "i int, j int"), 1, by=("region",),
        tile_items=tile).collect()}
    assert got == brute(ROWS, seeds)


def test_triples_extend_all_frequent_pairs(spark):
    """Only the 300 most frequent pairs were extended."""
    entities = spark.createDataFrame([(e, e % 10 == 0) for e in range(30)],
                                     "entity_id long, is_top boolean")
    links = spark.createDataFrame([(e, f"item {k:02d}") for e in range(30) for k in range(26)],
                                  "entity_id long, item_name string")
    sizes = [r["bundle_size"] for r in mining.mine_bundles(entities, links).collect()]
    assert sizes.count(2) == 26 * 25 // 2 and sizes.count(3) == 26 * 25 * 24 // 6
    limited = mining.mine_bundles(entities, links, seeds=300).collect()
    assert 0 < sum(r["bundle_size"] == 3 for r in limited) < 26 * 25 * 24 // 6
