"""Tail probabilities of single test statistics, for columns with one value per test.

Spark SQL has no error function, so these run in an Arrow function over the few rows a test leaves.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def gamma_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - s)
        b += 2
        d = 1 / (num * d + b or tiny)
        c = b + num / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def correlation_p(r: float | None, n: float | None) -> float | None:
    """Two-sided p of a correlation of n pairs under the t distribution."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    return t_two_sided(r * math.sqrt(dof / (1 - r * r)), dof)


def chi2_p(stat: float | None, dof: float | None) -> float | None:
    if stat is None or dof is None or math.isnan(stat) or dof <= 0:
        return None
    return gamma_q(dof / 2, stat / 2)


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else min(1.0, 2 * normal_sf(abs(z)))


def _column(fn, *cols) -> Column:
    @F.pandas_udf("double")
    def apply(*parts: pd.Series) -> pd.Series:
        clean = [p.astype(object).where(p.notna(), None) for p in parts]
        return pd.Series([fn(*row) for row in zip(*clean)], dtype="float64")

    return apply(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols])


def p_of_correlation(r, n) -> Column:
    return _column(correlation_p, r, n)


def p_of_chi2(stat, dof) -> Column:
    return _column(chi2_p, stat, dof)


def p_of_normal(z) -> Column:
    return _column(normal_two_sided, z)
