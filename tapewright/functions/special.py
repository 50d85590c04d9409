"""Distribution functions without a statistics library, as vectorised Python UDFs; null where undefined."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(x: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return 0.5 * (1 + math.erf((x - mu) / (sigma * math.sqrt(2))))


def normal_quantile(p: float) -> float:
    """By bisection on the distribution function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_cdf(t: float, df: float) -> float:
    tail = t_two_sided(t, df) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1 - beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 1.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 2_000):
        an = -k * (k - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def binomial_log(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return 0.0 if (k == 0) == (p <= 0) and k in (0, n) else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def binomial_tail(k: int, n: int, p: float, side: str = "greater") -> float:
    """Exact: P(X >= k), P(X <= k), or the sum of all outcomes no likelier than k."""
    if side == "greater":
        return 1.0 if k <= 0 else beta_cdf(p, k, n - k + 1)
    if side == "less":
        return 1.0 if k >= n else 1 - beta_cdf(p, k + 1, n - k)
    at = binomial_log(k, n, p)
    return min(1.0, math.fsum(math.exp(v) for i in range(n + 1) if (v := binomial_log(i, n, p)) <= at + 1e-9))


def _udf(f):  # noqa: ANN001, ANN202
    def run(*cols: pd.Series) -> pd.Series:
        def one(row: tuple) -> float | None:
            try:
                return None if any(x is None or x != x for x in row) else f(*row)
            except (ValueError, ZeroDivisionError, OverflowError):
                return None

        return pd.Series([one(r) for r in zip(*cols)], dtype="float64")

    if f.__code__.co_argcount == 1 or f is normal_cdf:
        def u(a: pd.Series) -> pd.Series:
            return run(a)
    elif f.__code__.co_argcount == 2:
        def u(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    else:
        def u(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)
    return F.pandas_udf(u, T.DoubleType())


normal_cdf_col = _udf(normal_cdf)
t_two_sided_col = _udf(t_two_sided)
t_quantile_col = _udf(t_quantile)
chi2_upper_col = _udf(chi2_upper)
f_upper_col = _udf(f_upper)
binomial_greater_col = _udf(lambda k, n, p: binomial_tail(int(k), int(n), p))
