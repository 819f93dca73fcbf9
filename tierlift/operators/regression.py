"""Controlled logistic and linear models, one per bundle, fitted together.

The controls are counts and region dummies, so entities collapse into cells of equal
controls. One aggregation builds the cells; every Newton step is one aggregation of the
cells into small moment sums per bundle, from which 9 x 9 systems are solved on the driver.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlift.functions.association import Z95
from tierlift.operators.bundles import bundle_holders, by_top_lift
from tierlift.params import DEFAULTS
from tierlift.session import cut_lineage

MAX_ITERATIONS = 35
TOLERANCE = 1e-8
# A standard error this large means the likelihood has no finite maximum.
SEPARATION_SE = 1e3

RESULT_SCHEMA = (
    "bundle_name string, controlled_odds_ratio double, controlled_ci_lower double, "
    "controlled_ci_upper double, controlled_p_value double, ols_coefficient double, "
    "ols_p_value double, ols_r2 double, logit_converged boolean"
)


def top_regions(entities: DataFrame, n: int = DEFAULTS.regression_regions) -> list[str]:
    """The most frequent regions by name; at most ``n`` strings reach the driver."""
    rows = (entities.groupBy("region").agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.col("c").desc(), "region").limit(n).collect())
    return [r["region"] for r in rows]


def control_names(regions: list[str]) -> list[str]:
    return ["item_count", "log_event_count", *[f"region_{r}" for r in regions]]


def design_cells(entities: DataFrame, holders: DataFrame, names: list[str],
                 regions: list[str]) -> DataFrame:
    """Cells ``(bundle_name, region, x0, x1, x2)`` with count, label and metric sums.

    ``x0`` is the bundle indicator, ``x1`` the item count, ``x2`` the log event count;
    regions without a dummy are blank. Cells of non-holders are the cells of everybody
    minus those of the holders, so no entity row is ever repeated per bundle.
    """
    listed = F.col("region").isin(regions) if regions else F.lit(False)
    base = entities.select(
        "entity_id", F.when(listed, F.col("region")).otherwise(F.lit("")).alias("region"),
        F.col("item_count").cast("double").alias("x1"),
        F.log1p(F.col("event_count").cast("double")).alias("x2"),
        F.col("is_top").cast("double").alias("y"), F.col("log_metric").alias("m"))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"),
            F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")]
    controls = ["region", "x1", "x2"]
    totals = ["n", "y", "m", "mm"]
    everybody = base.groupBy(*controls).agg(*sums)
    holding = cut_lineage(
        base.join(holders, "entity_id").groupBy("bundle_name", *controls).agg(*sums))
    copies = everybody.withColumn("bundle_name", F.explode(F.lit(names)))
    held = holding.select("bundle_name", *controls, *[F.col(c).alias(f"h_{c}") for c in totals])
    rest = copies.join(held, ["bundle_name", *controls], "left").select(
        "bundle_name", *controls, F.lit(0.0).alias("x0"),
        *[(F.col(c) - F.coalesce(f"h_{c}", F.lit(0.0))).alias(c) for c in totals])
    return rest.where(F.col("n") > 0).unionByName(holding.withColumn("x0", F.lit(1.0)))


def _groups(cells: DataFrame, weight: Column, gradient: Column, extra: list[Column]) -> list:
    """Per (bundle, region, x0): weighted second moments of (1, x1, x2) and gradient sums.

    The dummies and the indicator are constant inside a group, so nine sums are enough.
    """
    x = [F.lit(1.0), F.col("x1"), F.col("x2")]
    scored = cells.withColumn("_w", weight).withColumn("_g", gradient)
    return scored.groupBy("bundle_name", "region", "x0").agg(
        *[F.sum(F.col("_w") * x[p] * x[q]).alias(f"w{p}{q}")
          for p, q in combinations_with_replacement(range(3), 2)],
        *[F.sum(F.col("_g") * x[p]).alias(f"g{p}") for p in range(3)],
        *extra).collect()


def _assemble(rows: list, regions: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram matrix and gradient of ``[1, x0, x1, x2, dummies]`` for every bundle."""
    size = 4 + len(regions)
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in rows:
        lift = np.zeros((size, 3))
        lift[0, 0] = lift[2, 1] = lift[3, 2] = 1.0
        lift[1, 0] = row["x0"]
        if row["region"] in regions:
            lift[4 + regions.index(row["region"]), 0] = 1.0
        moments = np.array([[row[f"w{min(p, q)}{max(p, q)}"] for q in range(3)]
                            for p in range(3)])
        gram, grad = out.setdefault(
            row["bundle_name"], (np.zeros((size, size)), np.zeros(size)))
        gram += lift @ moments @ lift.T
        grad += lift @ np.array([row[f"g{p}"] for p in range(3)])
    return out


def fit_linear(cells: DataFrame, regions: list[str]) -> dict[str, tuple[float, float, float]]:
    """OLS of the log metric: ``{bundle: (coefficient, p-value, R squared)}``."""
    rows = _groups(cells, F.col("n"), F.col("m"), [
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("mm").alias("mm")])
    out = {}
    for name, (gram, grad) in _assemble(rows, regions).items():
        mine = [r for r in rows if r["bundle_name"] == name]
        n, m, mm = (sum(r[c] for r in mine) for c in ("n", "m", "mm"))
        inverse = np.linalg.pinv(gram, hermitian=True)
        beta = inverse @ grad
        residual = max(mm - float(beta @ grad), 0.0)
        spread = mm - m * m / n
        df = n - int(np.linalg.matrix_rank(gram, hermitian=True))
        if df <= 0 or spread <= 0:
            out[name] = (0.0, 1.0, 0.0)
            continue
        se = math.sqrt(max(residual / df * inverse[1, 1], 0.0))
        p = student_two_sided(float(beta[1]) / se, float(df)) if se > 0 else 1.0
        out[name] = (float(beta[1]), p, 1.0 - residual / spread)
    return out


def separated(cells: DataFrame) -> set[str]:
    """Bundles whose holders, or whose non-holders, all share one label."""
    rows = cells.groupBy("bundle_name", "x0").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    return {r["bundle_name"] for r in rows if r["y"] <= 0.0 or r["y"] >= r["n"]}


def fit_logit(cells: DataFrame, regions: list[str], names: list[str],
              max_iterations: int = MAX_ITERATIONS) -> dict[str, tuple[float, float]]:
    """Newton fits of the label: ``{bundle: (coefficient, standard error)}``.

    All bundles advance together, one aggregation per step. A bundle without a finite
    solution (separated, singular, or not converged) has no entry.
    """
    spark = cells.sparkSession
    size = 4 + len(regions)
    active = sorted(set(names) - separated(cells))
    beta = {name: np.zeros(size) for name in active}
    fitted: dict[str, tuple[float, float]] = {}
    for _ in range(max_iterations):
        if not active:
            break
        # At most bundles x (regions + 1) x 2 rows of coefficients.
        rows = [
            (name, region, x0,
             float(beta[name][0] + x0 * beta[name][1]
                   + (beta[name][4 + regions.index(region)] if region else 0.0)),
             float(beta[name][2]), float(beta[name][3]))
            for name in active for region in ["", *regions] for x0 in (0.0, 1.0)]
        current = F.broadcast(spark.createDataFrame(
            rows, "bundle_name string, region string, x0 double, b0 double, b1 double, "
                  "b2 double"))
        eta = F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")
        scored = cells.join(current, ["bundle_name", "region", "x0"]).withColumn(
            "_mu", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
        mu, n = F.col("_mu"), F.col("n")
        steps = _assemble(
            _groups(scored, n * mu * (1.0 - mu), F.col("y") - n * mu, []), regions)
        going = []
        for name in active:
            gram, grad = steps[name]
            try:
                inverse = np.linalg.inv(gram)
            except np.linalg.LinAlgError:
                continue
            step = inverse @ grad
            beta[name] = beta[name] + step
            variance = float(inverse[1, 1])
            if not np.all(np.isfinite(beta[name])) or not 0 < variance < SEPARATION_SE**2:
                continue
            if float(np.max(np.abs(step))) < TOLERANCE:
                fitted[name] = (float(beta[name][1]), math.sqrt(variance))
            else:
                going.append(name)
        active = going
    return fitted


# Degrees of freedom from which Student's tail is taken from the normal one.
NORMAL_DF = 1000.0


def student_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t.

    Through the regularised incomplete beta function; from ``NORMAL_DF`` degrees of freedom on
    through the normal tail of a corrected argument, whose error shrinks with their fourth power.
    """
    if not math.isfinite(t):
        return 0.0
    if df >= NORMAL_DF:
        a = df - 0.5
        y, b = a * math.log1p(t * t / df), 48.0 * a * a
        first = y + 3.0
        second = (((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b)
        return math.erfc(math.sqrt(y / 2.0) * (1.0 + (first + second) / b))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated with Lentz's method."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 100_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError("the continued fraction did not converge")
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a)
                     - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    return front * value


def bundle_regressions(
    entities: DataFrame,
    links: DataFrame,
    bundles: DataFrame,
    top_n: int = DEFAULTS.regression_bundles,
    n_regions: int = DEFAULTS.regression_regions,
) -> DataFrame:
    """The ``top_n`` bundles with controlled odds ratios and log-metric coefficients.

    When a logit has no finite solution the raw odds ratio, interval and p-value stand in.
    """
    spark = entities.sparkSession
    chosen = cut_lineage(by_top_lift(bundles).limit(top_n))
    regions = top_regions(entities, n_regions)
    names = [r["bundle_name"] for r in chosen.select("bundle_name").collect()]
    cells = cut_lineage(
        design_cells(entities, bundle_holders(chosen, links), names, regions))
    linear = fit_linear(cells, regions)
    logit = fit_logit(cells, regions, names)

    rows = []
    for name in names:
        coefficient, p_ols, r2 = linear.get(name, (0.0, 1.0, 0.0))
        fit = logit.get(name)
        if fit is None:
            rows.append((name, None, None, None, None, coefficient, p_ols, r2, False))
            continue
        b, se = fit
        rows.append((name, _exp(b), _exp(b - Z95 * se), _exp(b + Z95 * se),
                     math.erfc(abs(b / se) / math.sqrt(2.0)), coefficient, p_ols, r2, True))
    fits = spark.createDataFrame(rows, RESULT_SCHEMA)
    joined = chosen.join(F.broadcast(fits), "bundle_name")
    return by_top_lift(joined.select(
        "bundle_name", "members", "bundle_size", "entity_count", "top_lift",
        F.col("odds_ratio").alias("raw_odds_ratio"),
        F.coalesce("controlled_odds_ratio", "odds_ratio").alias("controlled_odds_ratio"),
        F.coalesce("controlled_ci_lower", "ci_lower").alias("controlled_ci_lower"),
        F.coalesce("controlled_ci_upper", "ci_upper").alias("controlled_ci_upper"),
        F.coalesce("controlled_p_value", "p_value").alias("controlled_p_value"),
        "ols_coefficient", "ols_p_value", "ols_r2", "logit_converged"))


def _exp(x: float) -> float:
    return math.exp(x) if x < 700.0 else math.inf


def single_regressor_ols(entities: DataFrame, links: DataFrame, bundles: DataFrame) -> DataFrame:
    """Slope, intercept and R squared of the log metric on each bundle's indicator alone.

    Only sums over holders and over everybody are needed, so no entity is repeated.
    """
    m = F.col("log_metric")
    everybody = entities.agg(
        F.count(F.lit(1)).alias("N"), F.sum(m).alias("S"), F.sum(m * m).alias("SS")).first()
    total, s, ss = float(everybody["N"]), float(everybody["S"]), float(everybody["SS"])
    held = (
        bundle_holders(bundles, links)
        .join(entities.select("entity_id", "log_metric"), "entity_id")
        .groupBy("bundle_name").agg(F.count(F.lit(1)).alias("k"), F.sum(m).alias("h"))
    )
    k, h = F.col("k"), F.col("h")
    inside, outside = h / k, (F.lit(s) - h) / (F.lit(total) - k)
    slope = inside - outside
    sxx = k * (F.lit(total) - k) / F.lit(total)
    syy = F.lit(ss - s * s / total)
    return held.where(F.col("k") < total).select(
        "bundle_name", F.col("k").alias("entity_count"), slope.alias("slope"),
        outside.alias("intercept"), (slope * slope * sxx / syy).alias("r2"))
