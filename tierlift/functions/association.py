"""2x2-table statistics as Column arithmetic.

``n`` entities hold the bundle, ``a`` of them carry the label, ``total`` entities
exist and ``top`` of them carry the label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96

# Below BORDER the tail of the normal distribution is 1 minus a series, above it a continued
# fraction; both have so many terms that doubles show no difference.
BORDER = 2.0
TERMS = 40


def _tail_series(x: Column) -> Column:
    """erfc by Kummer's series of erf, all terms positive; for small ``x >= 0``."""
    total = F.lit(1.0)
    for n in range(TERMS, 0, -1):
        total = F.lit(1.0) + total * x * x * F.lit(2.0 / (2 * n + 1))
    return F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * x * F.exp(-x * x) * total


def _tail_fraction(x: Column) -> Column:
    """exp(x^2) * erfc(x) by a continued fraction, which neither over- nor underflows."""
    below = x
    for k in range(TERMS, 0, -1):
        below = x + F.lit(k / 2.0) / below
    return F.lit(1.0 / math.sqrt(math.pi)) / below


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``, to the precision of doubles.

    ``x`` stands in the expression once per term, so it had better be a plain column.
    """
    return F.when(x < BORDER, _tail_series(x)).otherwise(F.exp(-x * x) * _tail_fraction(x))


def chi2_survival(stat: Column) -> Column:
    """P(chi-square with one degree of freedom > stat)."""
    return F.least(F.lit(1.0), erfc(F.sqrt(stat / F.lit(2.0))))


def chi2_evidence(stat: Column) -> Column:
    """-log10 of ``chi2_survival``, also where the p-value itself is too small for a double."""
    x = F.sqrt(stat / F.lit(2.0))
    log_p = F.when(x < BORDER, F.log(F.least(F.lit(1.0), _tail_series(x)))).otherwise(
        F.log(_tail_fraction(x)) - x * x)
    # Minus zero would not equal zero as a value.
    return F.lit(0.0) - log_p / F.lit(math.log(10.0))


def contingency(n: Column, a: Column, total: int | Column, top: int | Column) -> dict[str, Column]:
    """The four cells; totals are numbers or, for a population per row, columns."""
    total, top = (x if isinstance(x, Column) else F.lit(x) for x in (total, top))
    a = a.cast("double")
    b = n.cast("double") - a
    return {
        "a": a,
        "b": b,
        "c": top.cast("double") - a,
        "d": (total - top).cast("double") - b,
    }


def corrected_cells(cells: dict[str, Column]) -> dict[str, Column]:
    """Add 0.5 to all four cells when any of them is zero."""
    empty = F.least(*cells.values()) == 0.0
    return {k: F.when(empty, v + 0.5).otherwise(v) for k, v in cells.items()}


def odds_ratio(cc: dict[str, Column]) -> Column:
    return (cc["a"] * cc["d"]) / (cc["b"] * cc["c"])


def log_odds_se(cc: dict[str, Column]) -> Column:
    one = F.lit(1.0)
    return F.sqrt(one / cc["a"] + one / cc["b"] + one / cc["c"] + one / cc["d"])


def wald_bounds(log_value: Column, se: Column) -> tuple[Column, Column]:
    return F.exp(log_value - Z95 * se), F.exp(log_value + Z95 * se)


def yates_chi2(cells: dict[str, Column]) -> Column:
    """Continuity-corrected chi-square; the correction never goes below zero."""
    a, b, c, d = cells["a"], cells["b"], cells["c"], cells["d"]
    total = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - total / 2.0, F.lit(0.0))
    return (total * (gap * gap)) / ((a + b) * (c + d) * (a + c) * (b + d) + 1e-9)
