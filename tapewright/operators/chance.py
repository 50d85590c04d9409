"""Probability models: conjugate updates, counts, likelihood grids, hidden chains, calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.folds import Step, ordered_fold


def beta_posterior(successes: Column, failures: Column, a: float = 1.0, b: float = 1.0) -> dict[str, Column]:
    """alpha, beta, mean and variance of the Beta posterior of a proportion."""
    al, be = successes + a, failures + b
    n = al + be
    return {"alpha": al, "beta": be, "mean": al / n, "variance": al * be / (n * n * (n + 1))}


def beta_binomial_pmf(n: int, a: float, b: float) -> list[float]:
    """Predictive probabilities of 0..n successes."""
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + lb(k + a, n - k + b) - lb(a, b)) for k in range(n + 1)]


def conditional(joint: Column, condition: Column) -> Column:
    """P(A and B) / P(B) from counts, null without B."""
    return F.try_divide(joint.cast("double"), condition.cast("double"))


def bayes(like_k: Column, like_n: Column, prior_k: Column, prior_n: Column, evid_k: Column, evid_n: Column) -> Column:
    """P(H | E) from counts, at most 1; null where undefined."""
    q = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return F.least(F.lit(1.0), F.try_divide(q(like_k, like_n) * q(prior_k, prior_n), q(evid_k, evid_n)))


def normal_fit(x: str) -> dict[str, Column]:
    """mu, sigma (population) and log-likelihood of a normal distribution, as aggregates."""
    n, s = F.count(x), F.stddev_pop(x)
    return {"mu": F.avg(x), "sigma": s, "log_likelihood": F.when(s > 0, -n / 2 * (F.ln(2 * math.pi * s * s) + 1))}


def student_fit(df: DataFrame, keys: Sequence[str], x: str, grid: Sequence[float] = (3, 4, 5, 6, 8, 10, 15, 20, 30)) -> DataFrame:
    """(keys, df, scale, log_likelihood): the best degrees of freedom of a grid, the scale by moments; the first maximum wins."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    d = df.where(F.col(x).isNotNull()).join(m, list(keys)).where("_s > 0")
    lls = []
    for v in grid:
        sc = F.col("_s") * math.sqrt((v - 2) / v)
        c = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
        z = (F.col(x) - F.col("_m")) / sc
        lls.append(F.struct(F.sum(c - F.ln(sc) - (v + 1) / 2 * F.log1p(z * z / v)).alias("ll"), F.lit(-float(v)).alias("neg"), F.first(sc).alias("scale")))
    g = d.groupBy(*keys).agg(F.array_max(F.array(*lls)).alias("b"))
    return g.select(*keys, (-F.col("b.neg")).alias("df"), F.col("b.scale").alias("scale"), F.col("b.ll").alias("log_likelihood"))


def kernel_density(df: DataFrame, keys: Sequence[str], x: str, points: Sequence[float]) -> DataFrame:
    """(keys, x, density): Gaussian kernels of width 1.06 sigma n^-0.2 at a short list of points."""
    m = df.groupBy(*keys).agg(F.stddev_pop(x).alias("_s"), F.count(x).alias("_n"))
    d = df.join(m, list(keys)).withColumn("_h", 1.06 * F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where("_h > 0")
    k = [F.struct(F.lit(float(p)).alias("x"), F.avg(F.exp(-F.pow((F.lit(float(p)) - F.col(x)) / F.col("_h"), F.lit(2.0)) / 2) / (F.col("_h") * math.sqrt(2 * math.pi))).alias("density")) for p in points]
    return d.groupBy(*keys).agg(F.array(*k).alias("a")).select(*keys, F.explode("a").alias("a")).select(*keys, "a.x", "a.density")


def forward(start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> Step:
    """(state, probability, log_likelihood): scaled forward recursion of a hidden chain; null observations only move the state."""
    a, b = np.array(trans, float), np.array(emit, float)
    p, ll, first = np.array(start, float), 0.0, True

    def step(o: int | None) -> tuple:
        nonlocal p, ll, first
        q = p if first else p @ a
        first = False
        if o is not None:
            q = q * b[:, o]
            s = q.sum()
            ll += math.log(s) if s > 0 else -math.inf
            q = q / s if s > 0 else np.full(len(q), 1 / len(q))
        p = q
        k = int(p.argmax())
        return k, float(p[k]), ll

    return step


def hidden_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], observation: str, keep: Sequence[str], start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> DataFrame:
    """`keep`, state, probability, log_likelihood per row, filtered forward in constant memory."""
    return ordered_fold(df, keys, order, [observation], keep, lambda: forward(start, trans, emit), [("state", T.IntegerType()), ("probability", T.DoubleType()), ("log_likelihood", T.DoubleType())])


def viterbi(observations: Sequence[int], start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> list[int]:
    """The likeliest state path of one sequence."""
    with np.errstate(divide="ignore"):
        s, a, b = (np.log(np.array(x, float) + 1e-12) for x in (start, trans, emit))
    v, back = s + b[:, observations[0]], []
    for o in observations[1:]:
        m = v[:, None] + a
        back.append(m.argmax(axis=0))
        v = m.max(axis=0) + b[:, o]
    path = [int(v.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return path[::-1]


def isotonic_steps(df: DataFrame, p: str, y: str, bins: int = 1000) -> pd.DataFrame:
    """(low, value): a monotone calibration by pooling adjacent violators over `bins` score bins of [0, 1]; the bins' sums are all that leaves the rows.

    Scores below 0 and from 1 on are in the first and the last bin.
    """
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins), F.floor(F.col(p) * bins))).alias("k")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.min(p).alias("low")).orderBy("k").toPandas()
    blocks: list[list[float]] = []
    for n, s, lo in zip(g.n, g.s, g.low):
        blocks.append([float(n), float(s), float(lo)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n2, s2, _ = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += s2
    return pd.DataFrame([(lo, s / n) for n, s, lo in blocks], columns=["low", "value"])


def apply_steps(p: Column, steps: pd.DataFrame) -> Column:
    """The calibrated value of a score: the last step that starts at or below it."""
    out = F.lit(float(steps.value.iloc[0]))
    for lo, v in zip(steps.low.iloc[1:], steps.value.iloc[1:]):
        out = F.when(p >= float(lo), float(v)).otherwise(out)
    return out


def platt(df: DataFrame, p: str, y: str) -> tuple[float, float]:
    """(a, b) of the calibrated score 1 / (1 + exp(-(a + b * logit(p)))), by logistic regression; scores of 0 and 1 are left out."""
    from tapewright.operators.linear import logistic

    d = df.where((F.col(p) > 0) & (F.col(p) < 1) & F.col(y).isNotNull()).select(F.ln(F.col(p) / (1 - F.col(p))).alias("_x"), F.col(y).cast("double").alias("_y"))
    a, b = logistic(d, ["_x"], "_y", l2=0.0)
    return float(a), float(b)


def temperature(df: DataFrame, p: str, y: str, grid: Sequence[float] = tuple(round(0.25 * 1.1**i, 6) for i in range(40)), least: int = 50) -> float:
    """The temperature of a grid with the least log loss; 1 with fewer than `least` rows. One aggregation for all."""
    logit = F.ln(F.col(p) / (1 - F.col(p)))
    d = df.where((F.col(p) > 0) & (F.col(p) < 1) & F.col(y).isNotNull())
    row = d.agg(F.count("*").alias("n"), *[(-F.avg(F.col(y) * F.ln(1 / (1 + F.exp(-logit / t))) + (1 - F.col(y)) * F.ln(1 - 1 / (1 + F.exp(-logit / t))))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    if row.n < least:
        return 1.0
    loss = [row[f"t{i}"] for i in range(len(grid))]
    return float(grid[int(np.nanargmin(np.array(loss, float)))])


def pool(df: DataFrame, keys: Sequence[str], p: str, weight: str) -> DataFrame:
    """(keys, probability, n): linear opinion pool, weights normalised; null without positive weight."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    return df.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.try_divide(F.sum(F.col(p) * w), F.sum(w)).alias("probability"), F.count("*").alias("n"))


def likelihood_ratio_p(base: Column, full: Column) -> Column:
    """p of twice the gain in log-likelihood against chi-square with one degree of freedom; 1 without a gain."""
    from tapewright.functions.special import chi2_upper_col

    gain = 2 * (full - base)
    return F.when(gain > 0, chi2_upper_col(gain, F.lit(1.0))).otherwise(1.0)
