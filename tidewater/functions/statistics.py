"""Distribution functions and tests in plain Python, and the same as column functions over a few numbers per row.

Spark has no cumulative distribution functions. The column forms are Arrow-batched and are meant
for aggregated rows, a handful per series, never for raw data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def z_p(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return 1.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t that has probability p below it, by bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - t_p(mid, df) / 2 if mid >= 0 else t_p(mid, df) / 2
        low, high = (mid, high) if below < p else (low, mid)
    return (low + high) / 2


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1.0 - front * h)


def chi2_p(x: float, df: float) -> float:
    return 1.0 - gamma_inc(df / 2, x / 2)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more successes in n trials."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_inc(k, n - k + 1, p)


def welch_p(m1, s1, n1, m2, s2, n2) -> float:
    """Two-sided p-value of Welch's test from means, sample deviations and counts; 1 where it has none."""
    if n1 < 2 or n2 < 2:
        return 1.0
    a, b = s1 * s1 / n1, s2 * s2 / n2
    below = a * a / (n1 - 1) + b * b / (n2 - 1)
    if a + b <= 0 or not math.isfinite(a + b) or below == 0:
        return 1.0
    return t_p((m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / below)


def correlation_p(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def autocorrelation_p(r: float, n: int, lag: int) -> float:
    """By Fisher's z, the lag taken off the sample."""
    if n - lag <= 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return z_p(math.atanh(r) * math.sqrt(n - lag - 3))


def kolmogorov_p(ks: float, n1: int, n2: int) -> float:
    """The first five terms of Kolmogorov's series."""
    n = math.sqrt(n1 * n2 / (n1 + n2))
    x = (n + 0.12 + 0.11 / n) * ks
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 6))))


def concentration_p(hhi: float, segments: int, rows: int) -> float:
    """Chi-square of shares against equal ones."""
    if segments < 2 or rows < segments:
        return 1.0
    return chi2_p(max(0.0, rows * segments * (hhi - 1 / segments)), segments - 1)


def cluster_p(size: int, tested: int, periods: int) -> float:
    """So many of the columns tested beyond two deviations on one side, for any period and side."""
    if size < 2 or tested < size:
        return 1.0
    return min(1.0, binomial_tail(size, tested, 0.0228) * 2 * max(1, periods))


def churn_p(added: int, removed: int, before: int) -> float:
    churn, exposed = added + removed, before + added
    return 1.0 if churn == 0 or exposed == 0 else binomial_tail(churn, exposed, 0.05)


def column(fn: Callable[..., float], *args: Column) -> Column:
    """A function of numbers, row by row in Arrow batches; null in, null out."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else float(fn(*row)) for row in frame.itertuples(index=False)], dtype="float64")

    return run(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(args)]))
