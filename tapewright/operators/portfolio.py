"""Portfolio measures: covariances in Spark, weights on the driver for a bounded set of assets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.stats import correlation

MOST_ASSETS = 500


def covariance_pairs(returns: DataFrame, asset: str, time: str, value: str) -> DataFrame:
    """(a, b, n, cov, corr): sample covariance of two assets over common times, a <= b.

    A time's returns are one array (as long as there are assets, at most MOST_ASSETS), paired inside it.
    """
    rows = returns.where(F.col(value).isNotNull()).groupBy(time).agg(F.array_sort(F.collect_list(F.struct(F.col(asset).alias("a"), F.col(value).alias("x")))).alias("v"))
    p = rows.select(F.explode("v").alias("l"), "v").select("l", F.explode(F.filter("v", lambda r: r["a"] >= F.col("l.a"))).alias("r"))
    return p.groupBy(F.col("l.a").alias("a"), F.col("r.a").alias("b")).agg(F.count("*").alias("n"), F.covar_samp("l.x", "r.x").alias("cov"), correlation("l.x", "r.x").alias("corr"))


def moments(returns: DataFrame, asset: str, time: str, value: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(assets, mean vector, covariance matrix) of at most MOST_ASSETS assets; more raise."""
    names = [r[0] for r in returns.select(asset).distinct().orderBy(asset).limit(MOST_ASSETS + 1).collect()]
    if len(names) > MOST_ASSETS:
        raise ValueError(f"more than {MOST_ASSETS} assets")
    mu = {r[0]: r[1] for r in returns.groupBy(asset).agg(F.avg(value)).collect()}
    at = {n: i for i, n in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in covariance_pairs(returns, asset, time, value).collect():
        c[at[r.a], at[r.b]] = c[at[r.b], at[r.a]] = r.cov or 0.0
    return names, np.array([mu[n] for n in names]), c


def _simplex(w: np.ndarray) -> np.ndarray:
    """The nearest point with weights at least 0 that sum to 1."""
    u = np.sort(w)[::-1]
    c = np.cumsum(u) - 1
    k = np.nonzero(u - c / np.arange(1, len(w) + 1) > 0)[0][-1]
    return np.maximum(w - c[k] / (k + 1), 0)


def minimum_variance(cov: np.ndarray, short: bool = False, rounds: int = 2_000) -> np.ndarray:
    """Weights of least variance: closed form with short sales, else projected gradient."""
    n = len(cov)
    if short:
        w = np.linalg.solve(cov + 1e-12 * np.trace(cov) * np.eye(n), np.ones(n))
        return w / w.sum()
    w, rate = np.full(n, 1 / n), 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-30)
    for _ in range(rounds):
        w = _simplex(w - rate * (cov @ w))
    return w


def maximum_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float = 0.0, short: bool = False, rounds: int = 2_000) -> np.ndarray:
    """Weights of the largest ratio of excess mean to deviation; the best ones seen are kept."""
    n = len(mu)
    if short:
        w = np.linalg.solve(cov + 1e-12 * np.trace(cov) * np.eye(n), mu - rf)
        return w / w.sum() if abs(w.sum()) > 1e-12 else np.full(n, 1 / n)
    score = lambda w: (w @ mu - rf) / np.sqrt(max(w @ cov @ w, 1e-30))
    w = best = np.full(n, 1 / n)
    for k in range(rounds):
        s = np.sqrt(max(w @ cov @ w, 1e-30))
        g = (mu - rf) / s - (w @ mu - rf) * (cov @ w) / s**3
        w = _simplex(w + 0.5 / (1 + k / 50) * g / max(np.abs(g).max(), 1e-30))
        if score(w) > score(best):
            best = w
    return best


def frontier(mu: np.ndarray, cov: np.ndarray, points: int = 20) -> list[tuple[float, float, np.ndarray]]:
    """(mean, deviation, weights) of least variance for a grid of target means (closed form, short sales)."""
    n = len(mu)
    inv = np.linalg.inv(cov + 1e-12 * np.trace(cov) * np.eye(n))
    one = np.ones(n)
    a, b, c = one @ inv @ one, one @ inv @ mu, mu @ inv @ mu
    out = []
    for m in np.linspace(mu.min(), mu.max(), points):
        det = a * c - b * b
        w = inv @ (one * (c - b * m) + mu * (a * m - b)) / det if abs(det) > 1e-300 else np.full(n, 1 / n)
        out.append((float(m), float(np.sqrt(max(w @ cov @ w, 0))), w))
    return out


def risk_contributions(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Each asset's share of the portfolio's deviation (Euler)."""
    v = w @ cov @ w
    return w * (cov @ w) / v if v > 0 else np.zeros(len(w))


def exposure(positions: DataFrame, value: str = "notional") -> DataFrame:
    """gross, net, long and short sums."""
    x = F.col(value)
    return positions.agg(F.sum(F.abs(x)).alias("gross"), F.sum(x).alias("net"), F.sum(F.greatest(x, F.lit(0.0))).alias("long"), F.sum(F.least(x, F.lit(0.0))).alias("short"))
