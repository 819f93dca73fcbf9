"""Ordered windows, as-of and interval joins and grouping sets against pandas and brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierlift.operators import grouping, ordered
from tierlift.operators.time_joins import asof_join, interval_join


def some_rows(n=900, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot"] * 8 + ["a", None]), rnd.choice([None, *range(40)]),
             rnd.randint(-9, 9)) for i in range(n)]


@pytest.fixture(autouse=True, scope="module")
def small_blocks(spark):
    """Else Spark joins partitions of so few rows to one, and nothing is carried over a border."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(some_rows(), "id bigint, k string, t bigint, v bigint").repartition(5)


def test_numbers_and_tiles_equal_the_plain_window(rows):
    got = ordered.with_ntile(ordered.with_row_numbers(rows, ["k"], ["t", "id"], "n", "of"),
                             ["k"], ["t", "id"], 7, "tile")
    rows.createOrReplaceTempView("ordered_rows")
    want = rows.sparkSession.sql(
        "select *, row_number() over w n, count(*) over (partition by k) of, ntile(7) over w tile "
        "from ordered_rows window w as (partition by k order by t, id)")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str)


def test_a_hot_key_covers_many_blocks(rows):
    blocks = ordered.in_blocks(rows.withColumn("k", F.lit("all")), ["k"], ["t"])
    sizes = [r["count"] for r in blocks.groupBy(ordered.BLOCK).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 450
    equal = ordered.in_blocks(rows.select(F.lit(1).alias("k")), ["k"], [])
    assert equal.select(ordered.BLOCK).distinct().count() > 4


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(rows, descending):
    got = ordered.with_rank(rows, ["k"], ["t", "v"], descending=descending)
    way = "desc nulls last" if descending else "asc nulls last"
    rows.createOrReplaceTempView("ordered_rows")
    want = rows.sparkSession.sql(f"select *, rank() over (partition by k order by t {way}, v {way}) "
                                 "rank from ordered_rows")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str)


def test_neighbours_sums_and_last_values(rows):
    got = ordered.with_neighbour(rows, ["k"], ["t", "id"], "v", "lag2", 2)
    got = ordered.with_neighbour(got, ["k"], ["t", "id"], "v", "lead1", -1)
    got = ordered.with_running_sum(got, ["k"], ["t", "id"], "v", "upto")
    got = ordered.with_last_value(
        got.withColumn("some", F.when(F.col("v") > 7, F.col("v"))), ["k"], ["t", "id"], "some", "last")
    rows.createOrReplaceTempView("ordered_rows")
    want = rows.sparkSession.sql(
        "select *, lag(v, 2) over w lag2, lead(v) over w lead1, sum(v) over w upto, "
        "last(case when v > 7 then v end, true) over w last "
        "from ordered_rows window w as (partition by k order by t, id)")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str)


def test_range_frames(rows):
    got = ordered.with_range_sum(rows, ["k"], "t", 5, "v", "s", "c").collect()
    for r in got:
        frame = [v for _, k, t, v in some_rows() if k == r["k"] and t is not None
                 and r["t"] is not None and r["t"] - 5 <= t <= r["t"]]
        assert (r["s"], r["c"]) == ((sum(frame), len(frame)) if r["t"] is not None else (None, None))
    assert len(got) == 900


def test_empty_tables(rows):
    none = rows.where("id < 0")
    assert ordered.with_row_numbers(none, ["k"], ["t"]).collect() == []
    assert ordered.with_ntile(none, [], ["t"], 3).collect() == []
    assert ordered.with_rank(none, ["k"], ["t"]).collect() == []
    assert ordered.with_range_sum(none, ["k"], "t", 5, "v", "s", "c").collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof_join(spark, how):
    rnd = random.Random(4)
    left = [(i, rnd.choice(["hot"] * 6 + ["x", "y", None]), rnd.choice([None, *range(60)]))
            for i in range(400)]
    right = [(rnd.choice(["hot"] * 6 + ["x", None]), rnd.choice([None, *range(60)]), i, float(i))
             for i in range(150)]
    got = asof_join(spark.createDataFrame(left, "id bigint, k string, t bigint").repartition(4),
                    spark.createDataFrame(right, "k string, at bigint, n bigint, v double"),
                    ["k"], "t", "at", tolerance=F.lit(9), how=how, tie=["n"])
    assert got.columns == ["id", "k", "t", "at", "n", "v"]
    want = []
    for i, k, t in left:
        fit = [(at, n, v) for k2, at, n, v in right
               if None not in (k, t, at) and k2 == k and at <= t]
        best = max(fit, default=None)
        best = best if best and best[0] + 9 >= t else None
        if best or how == "left":
            want.append((i, k, t, *(best or (None, None, None))))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_interval_join_finds_each_pair_once_and_compares_few(spark):
    rnd = random.Random(6)
    inf, nan = float("inf"), float("nan")

    def spans(n, seed):
        rnd.seed(seed)
        out = []
        for i in range(n):
            start = rnd.choice([rnd.uniform(0, 1000), float(rnd.randint(0, 40) * 25)])
            length = rnd.choice([0.0, 0.0, rnd.uniform(0, 3), rnd.uniform(0, 900), 25.0, -1.0])
            out.append((i, rnd.choice(["hot"] * 5 + ["x", None]), start, start + length))
        return out + [(n, "hot", None, 5.0), (n + 1, "hot", 1.0, inf), (n + 2, "hot", nan, nan)]

    a, b = spans(250, 1), spans(200, 2)
    left = spark.createDataFrame(a, "i bigint, k string, s double, e double").repartition(3)
    right = spark.createDataFrame(b, "j bigint, k string, s2 double, e2 double")
    joined = interval_join(left, right, ["k"], ("s", "e"), ("s2", "e2"))
    assert joined.columns == ["i", "k", "s", "e", "j", "s2", "e2"]
    sound = [[r for r in x if r[1] is not None and r[2] is not None and r[2] <= r[3] < inf] for x in (a, b)]
    want = sorted((i, j) for i, k, s, e in sound[0] for j, k2, s2, e2 in sound[1]
                  if k == k2 and s <= e2 and s2 <= e)
    assert sorted((r["i"], r["j"]) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_one_wide_interval_among_points(spark):
    points = spark.range(4000).select(F.col("id").alias("p"), F.col("id").cast("double").alias("x"))
    wide = spark.createDataFrame([(1, 0.0, 1e12), (2, 10.5, 10.9), (3, 20.0, 20.0)],
                                 "w int, s double, e double")
    got = interval_join(points, wide, [], ("x", "x"), ("s", "e")).groupBy("w").count().collect()
    assert {r["w"]: r["count"] for r in got} == {1: 4000, 3: 1}


def test_grouping_sets_equal_pandas(spark):
    rnd = np.random.default_rng(2)
    data = pd.DataFrame({"a": rnd.choice(["x", "y", None], 700), "b": rnd.choice([1, 2, 3], 700),
                         "v": np.where(rnd.random(700) < 0.1, np.nan, rnd.integers(0, 30, 700))})
    rows = [(a, int(b), None if v != v else float(v)) for a, b, v in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a string, b bigint, v double")
    sets = grouping.cube(["a", "b"])
    got = grouping.grouping_sets(df, sets, "v", {"q50": 0.5, "q33": 0.33}).collect()
    seen = 0
    for r in got:
        part = [v for a, b, v in rows if ("a" not in sets[r["level"]] or a == r["a"])
                and ("b" not in sets[r["level"]] or b == r["b"])]
        held = [v for v in part if v is not None]
        assert (r["n_rows"], r["n_distinct"]) == (len(part), len(set(held)))
        assert r["q50"] == pytest.approx(np.percentile(held, 50))
        assert r["q33"] == pytest.approx(np.percentile(held, 33))
        seen += 1
    assert seen == 9 + 3 + 3 + 1
    assert [len(s) for s in grouping.rollup(["a", "b"])] == [2, 1, 0]
    assert grouping.grouping_sets(df.where("b > 9"), sets, "v", {"q50": 0.5}).collect() == []
