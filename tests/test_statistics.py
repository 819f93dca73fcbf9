import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlift.functions import association as assoc
from tierlift.operators import bundles as mining
from tierlift.operators import item_stats, regression
from tierlift.operators import region_bundles as regional
from tierlift.operators.quantiles import aggregate_with_quantiles
from tierlift.operators.running import running


@pytest.fixture(scope="module")
def people(spark):
    """300 entities, 12 items, one of them held by nearly everybody."""
    rng = random.Random(5)
    ents, links = [], []
    for e in range(300):
        held = {"common"} if rng.random() < 0.9 else set()
        held |= {f"i{k}" for k in range(11) if rng.random() < 0.1 + 0.06 * k}
        metric = round(math.exp(rng.gauss(5, 1)) + 200 * ("i3" in held), 2)
        ents.append((e, metric, rng.randint(0, 30), len(held), rng.choice("ABCDEFG")))
        links += [(e, k) for k in held]
    cut = np.percentile([x[1] for x in ents], 80)
    rows = [(e, m, math.log1p(m), r, n, g, bool(m >= cut)) for e, m, r, n, g in ents]
    entities = spark.createDataFrame(
        rows, "entity_id long, metric double, log_metric double, event_count long, "
              "item_count long, region string, is_top boolean")
    table = spark.createDataFrame(links, "entity_id long, item_name string")
    return entities.cache(), table.cache(), rows, links


def test_tail_probability(spark):
    xs = [0.0, 1e-6, 0.5, 1.0, 3.84, 10.0, 100.0, 600.0, 1400.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", assoc.chi2_survival(F.col("x")).alias("p")).collect():
        want = math.erfc(math.sqrt(r["x"] / 2))
        assert 0.0 <= r["p"] <= 1.0
        assert r["p"] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_evidence_where_the_p_value_is_zero(spark):
    xs = [0.0, 1e-9, 0.3, 3.9, 7.9, 8.1, 30.0, 1400.0, 5000.0, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", assoc.chi2_evidence(F.col("x")).alias("e")).collect():
        z = math.sqrt(r["x"] / 2)
        if z < 26:
            want = -math.log10(math.erfc(z)) + 0.0
        else:  # the asymptotic series, exact to 1e-11 there
            want = (z * z + math.log(z * math.sqrt(math.pi))
                    - math.log1p(-1 / (2 * z * z) + 3 / (4 * z ** 4))) / math.log(10)
        assert r["e"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_region_bundles_count_in_their_region(spark, people):
    entities, table, rows, links = people
    tested = regional.region_bundles(entities, table, min_holders=2, min_entities=10,
                                     min_frequency=2, min_count=3, min_support=0.0)
    got = tested.collect()
    region = {e: g for e, _, _, _, _, g, _ in rows}
    top = {e for e, *_, t in rows if t}
    held = {}
    for e, k in links:
        held.setdefault(e, set()).add(k)
    assert got and len({(r["region"], r["bundle_name"]) for r in got}) == len(got)
    for r in got:
        members = set(r["bundle_name"].split(" + "))
        inside = [e for e, x in held.items() if members <= x and region[e] == r["region"]]
        living = [e for e in region if region[e] == r["region"]]
        assert (r["entity_count"], r["top_count"]) == (len(inside), len(top & set(inside)))
        assert r["top_lift"] == pytest.approx(
            len(top & set(inside)) / len(inside) * len(living) / max(1, len(top & set(living))))
    for g in {r["region"] for r in got}:
        family = sorted((r for r in got if r["region"] == g), key=lambda r: r["p_value"])
        least = 1.0
        for place in range(len(family), 0, -1):
            least = min(least, family[place - 1]["p_value"] * len(family) / place)
            assert family[place - 1]["adjusted_p_value"] == pytest.approx(least, rel=1e-9)
    lead = regional.leading_bundles(tested, 3).collect()
    assert lead and max(r["rank"] for r in lead) <= 3 and min(r["top_lift"] for r in lead) > 1


@pytest.mark.parametrize("n, a, total, top", [
    (20, 0, 100, 10), (10, 10, 100, 10), (10, 10, 100, 30), (100, 10, 100, 10), (30, 7, 200, 20)])
def test_table_statistics(spark, n, a, total, top):
    row = spark.createDataFrame([(n, a)], "n long, a long").select(
        F.col("n"), F.col("a"),
        assoc.odds_ratio(assoc.corrected_cells(
            assoc.contingency(F.col("n"), F.col("a"), total, top))).alias("o"),
        assoc.yates_chi2(assoc.contingency(F.col("n"), F.col("a"), total, top)).alias("x")).first()
    cells = np.array([a, n - a, top - a, total - top - (n - a)], dtype=float)
    fixed = cells + 0.5 if (cells == 0).any() else cells
    assert row["o"] == pytest.approx(fixed[0] * fixed[3] / (fixed[1] * fixed[2]))
    ca, cb, cc, cd = cells
    gap = max(abs(ca * cd - cb * cc) - total / 2, 0.0)
    want = total * gap**2 / ((ca + cb) * (cc + cd) * (ca + cc) * (cb + cd) + 1e-9)
    assert row["x"] == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_false_discovery_with_ties(spark, seed):
    rng = random.Random(seed)
    values = [(rng.randint(1, 6), rng.randint(0, 3)) for _ in range(60)]
    p_of = {v: rng.choice([0.0, 1.0, round(rng.random() ** 3, 3), 1e-300, 1 - 1e-9])
            for v in sorted(set(values))}
    rows = [(f"b{i}", n, a, p_of[(n, a)]) for i, (n, a) in enumerate(values)]
    df = spark.createDataFrame(
        rows, "bundle_name string, entity_count long, top_count long, p_value double")
    got = {r["bundle_name"]: r["adjusted_p_value"]
           for r in mining.false_discovery(df).collect()}
    order = sorted(rows, key=lambda r: -r[3])
    low, want = 1.0, {}
    for k, r in enumerate(order):
        low = min(low, r[3] * len(rows) / (len(rows) - k))
        want[r[0]] = low
    assert got == pytest.approx(want)
    by_p = sorted((r[3], got[r[0]]) for r in rows)
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(by_p, by_p[1:]))


@pytest.mark.parametrize("tile", [2, 512])
def test_pairs_and_triples_equal_brute_force(spark, people, tile):
    entities, table, rows, links = people
    top = {r[0] for r in rows if r[6]}
    held = {}
    for e, k in links:
        held.setdefault(e, set()).add(k)
    items = mining.ranked_items(table, 15).cache()
    rank = {r["item_name"]: r["r"] for r in items.collect()}
    coded = mining.coded_links(entities, table, items)
    brute = {}
    for e, ks in held.items():
        for i, j in combinations(sorted(rank[k] for k in ks if k in rank), 2):
            n, a = brute.get((i, j), (0, 0))
            brute[(i, j)] = (n + 1, a + (e in top))
    want = {k: v for k, v in brute.items() if v[0] >= 20}
    pairs = mining.pair_counts(coded, 20, tile_items=tile).cache()
    got = {(r["i"], r["j"]): (r["n"], r["a"]) for r in pairs.collect()}
    assert got == want
    seeds = sorted(want, key=lambda k: (-want[k][0], k))[:10]
    triples = {}
    for e, ks in held.items():
        ranks = sorted(rank[k] for k in ks if k in rank)
        for i, j in combinations(ranks, 2):
            if (i, j) in seeds:
                for k in ranks:
                    if k > j:
                        n, a = triples.get((i, j, k), (0, 0))
                        triples[(i, j, k)] = (n + 1, a + (e in top))
    want3 = {k: v for k, v in triples.items() if v[0] >= 20}
    got3 = {(r["i"], r["j"], r["k"]): (r["n"], r["a"]) for r in mining.triple_counts(
        coded, mining.seed_pairs(pairs, 10), 20).collect()}
    assert got3 == want3


def test_bundle_table_bounds(people):
    entities, table, _, _ = people
    df = mining.mine_bundles(entities, table).toPandas()
    assert set(df.bundle_size) == {2, 3} and df.bundle_name.is_unique
    assert ((df.support > 0) & (df.support <= 1)).all() and (df.lift > 0).all()
    assert (df.odds_ratio > 0).all() and (df.ci_upper >= df.ci_lower).all()
    for p in ("p_value", "adjusted_p_value"):
        assert df[p].between(0, 1).all()
    assert (df.adjusted_p_value >= df.p_value - 1e-12).all()


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        cov = np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)
        beta = beta + cov @ (x.T @ (y - mu))
    return beta, np.sqrt(np.diag(cov))


def test_regressions_equal_numpy(people):
    entities, table, rows, links = people
    bundles = mining.mine_bundles(entities, table).cache()
    out = regression.bundle_regressions(entities, table, bundles, top_n=6).toPandas()
    members = {r["bundle_name"]: set(r["members"]) for r in bundles.collect()}
    regions = regression.top_regions(entities)
    assert len(regions) == 5 and len(out) == 6
    held = {}
    for e, k in links:
        held.setdefault(e, set()).add(k)
    y = np.array([float(r[6]) for r in rows])
    m = np.array([r[2] for r in rows])
    for rec in out.to_dict("records"):
        x = np.array([[1.0, members[rec["bundle_name"]] <= held.get(r[0], set()), r[4],
                       math.log1p(r[3]), *[r[5] == g for g in regions]] for r in rows], float)
        beta, *_ = np.linalg.lstsq(x, m, rcond=None)
        resid = m - x @ beta
        assert rec["ols_coefficient"] == pytest.approx(beta[1], rel=1e-8)
        assert rec["ols_r2"] == pytest.approx(1 - resid @ resid / ((m - m.mean()) ** 2).sum())
        if rec["logit_converged"]:
            b, se = newton(x, y)
            assert rec["controlled_odds_ratio"] == pytest.approx(math.exp(b[1]), rel=1e-6)
            assert rec["controlled_ci_upper"] == pytest.approx(
                math.exp(b[1] + 1.96 * se[1]), rel=1e-6)
        else:
            assert rec["controlled_odds_ratio"] == rec["raw_odds_ratio"]
    assert out.logit_converged.any()


def test_separated_bundle_falls_back_to_the_raw_odds_ratio(spark):
    rows = [(e, float(e), math.log1p(e), e % 7, 2, "ABCDEFGH"[e % 8], e >= 80)
            for e in range(100)]
    entities = spark.createDataFrame(
        rows, "entity_id long, metric double, log_metric double, event_count long, "
              "item_count long, region string, is_top boolean")
    links = spark.createDataFrame(
        [(e, k) for e in range(75, 100) for k in ("p", "q") if e >= 80 or k == "p"],
        "entity_id long, item_name string")
    bundles = mining.mine_bundles(entities, links)
    out = regression.bundle_regressions(entities, links, bundles).collect()
    assert len(out) == 1 and not out[0]["logit_converged"]
    assert out[0]["controlled_odds_ratio"] == out[0]["raw_odds_ratio"]


def test_student_tail():
    # Closed forms for one and two degrees of freedom.
    for t in (0.1, 1.0, 2.5, 30.0):
        assert regression.student_two_sided(t, 1) == pytest.approx(
            1 - 2 * math.atan(t) / math.pi, rel=1e-9)
        assert regression.student_two_sided(t, 2) == pytest.approx(
            1 - t / math.sqrt(2 + t * t), rel=1e-9)
    normal = math.erfc(1.96 / math.sqrt(2))
    for df in (1e9, 1e11, 1e13, 1e14):
        assert regression.student_two_sided(1.96, df) == pytest.approx(normal, rel=1e-8)
    # Both ways agree where they meet, from the centre to the far tail.
    for df in (1000.0, 1001.0, 2500.0, 1e4):
        for t in (0.01, 0.5, 1.0, 1.96, 3.0, 6.0):
            exact = regression.incomplete_beta(df / 2, 0.5, df / (df + t * t))
            assert regression.student_two_sided(t, df) == pytest.approx(exact, rel=1e-8)


@pytest.mark.parametrize("held", [200_000, 20])
def test_quantiles_equal_numpy(spark, held):
    rng = np.random.default_rng(3)
    inf = float("inf")
    groups = {"hot": rng.lognormal(3, 2, 6000).round(2), "ties": np.repeat([1.0, 2.0], 300),
              "one": np.array([4.0]), None: rng.integers(0, 5, 3700).astype(float),
              "three": np.array([1.0, 5.0, 9.0]), "equal": np.repeat(7.0, 900),
              "ends": np.array([-inf] * 5 + [1.0, 2.0, 3.0] + [inf] * 5)}
    rows = [(g, float(v), float(i)) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("hot", None, None), ("nothing", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    spec = {"v50": ("v", 0.5), "v90": ("v", 0.9), "w25": ("w", 0.25), "v0": ("v", 0.0),
            "v100": ("v", 1.0)}
    out = aggregate_with_quantiles(df, ["g"], [F.count("v").alias("n")], spec, held)
    found = {r["g"]: r for r in out.collect()}
    assert set(found) == {*groups, "nothing"}
    assert [found["nothing"][c] for c in ("n", *spec)] == [0] + [None] * 5
    for g, vs in groups.items():
        assert found[g]["n"] == len(vs)
        # NumPy makes NaN of infinite neighbours; these groups have none at the ranks asked for.
        assert found[g]["v50"] == pytest.approx(np.percentile(vs, 50), rel=1e-12)
        assert found[g]["w25"] == pytest.approx(np.percentile(np.arange(len(vs)), 25))
        assert (found[g]["v0"], found[g]["v100"]) == (vs.min(), vs.max())
        if g != "ends":
            assert found[g]["v90"] == pytest.approx(np.percentile(vs, 90), rel=1e-12)
    assert found["ends"]["v90"] == inf
    finite = df.where("g is null or g <> 'ends'")
    whole = aggregate_with_quantiles(finite, [], [], {"q": ("v", 0.9)}, held).first()
    everything = np.concatenate([v for g, v in groups.items() if g != "ends"])
    assert whole["q"] == pytest.approx(np.percentile(everything, 90), rel=1e-12)


def test_large_groups_are_narrowed_more_than_once(spark):
    n = 60_000
    df = spark.range(n, numPartitions=4).select(
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"), (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id")).cast("double").alias("w"))
    values = df.toPandas()
    spec = {"a": ("v", 0.5), "b": ("v", 0.999), "c": ("w", 0.25)}
    got = {r["g"]: r for r in aggregate_with_quantiles(df, ["g"], [], spec, held=5).collect()}
    for g, part in values.groupby("g"):
        assert got[g]["a"] == pytest.approx(np.percentile(part["v"], 50), rel=1e-12)
        assert got[g]["b"] == pytest.approx(np.percentile(part["v"], 99.9), rel=1e-12)
    assert got[0]["c"] is None
    assert got[1]["c"] == pytest.approx(np.percentile(values["w"].dropna(), 25), rel=1e-12)


def test_nan_is_the_largest_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, nan, 3.0, nan, None]], "v double")
    spec = {"a": ("v", 0.5), "b": ("v", 0.75), "c": ("v", 1.0), "d": ("v", 0.0)}
    r = aggregate_with_quantiles(df, [], [], spec).first()
    assert (r["a"], r["d"]) == (3.0, 1.0) and np.isnan(r["b"]) and np.isnan(r["c"])


def test_running_across_blocks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn(
        "b", F.floor(F.col("t") / 10))
    up = {(r["k"], r["t"]): r["s"] for r in running(
        df, ["k"], "b", ["t"], "v", "sum", "s").collect()}
    down = {(r["k"], r["t"]): r["s"] for r in running(
        df, ["k"], "b", ["t"], "v", "min", "s", include_current=False,
        descending=True).collect()}
    for k, t, _ in rows:
        mine = [(a, v) for kk, a, v in rows if kk == k]
        assert up[(k, t)] == sum(v for a, v in mine if a <= t)
        later = [v for a, v in mine if a > t]
        assert down[(k, t)] == (min(later) if later else None)


def test_item_statistics_join_links_once(spark):
    entities = spark.createDataFrame(
        [(e, float(e), float(e), 1.0, 1, e > 3) for e in range(6)],
        "entity_id long, metric double, log_metric double, rate double, item_count long, "
        "is_top boolean")
    links = spark.createDataFrame([(e, 1, "x") for e in range(5)],
                                  "entity_id long, item_id long, item_name string")
    out = item_stats.item_statistics(entities, links, 2)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = out.first()
    assert (row["entity_count"], row["median_metric"], row["top_rate"]) == (5, 2.0, 0.2)
