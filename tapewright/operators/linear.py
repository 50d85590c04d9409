"""Regression and econometrics: moments of features in Spark, small dense algebra on what they add up to.

A key's means and covariances (features squared numbers) are all that leaves the rows; keys are solved side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import special
from tapewright.operators.blocks import Frames, with_halo
from tapewright.operators.stats import correlation


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, m_i, c_i_j): means and population covariances of the columns over rows where all are given.

    Spark merges central moments, so no digits cancel where a column varies little about a large mean (price levels).
    """
    ok = None
    for c in columns:
        x = F.col(c).isNotNull() & ~F.isnan(F.col(c))
        ok = x if ok is None else ok & x
    k = len(columns)
    pair = lambda i, j: F.var_pop(columns[i]) if i == j else F.covar_pop(columns[i], columns[j])
    aggs = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)] + [pair(i, j).alias(f"c_{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def _unpack(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred sums of products."""
    m = np.array([row[f"m_{i}"] for i in range(k)], dtype=float)
    c = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = row[f"c_{i}_{j}"] * row["n"]
    return m, c


def fit(g: np.ndarray, n: int, ridge: float = 0.0) -> dict:
    """Least squares of the last column on the constant (the first) and the others, from a Gram matrix."""
    m = g[0, 1:] / g[0, 0]
    return fit_centred(m, g[1:, 1:] - g[0, 0] * np.outer(m, m), n, ridge)


def fit_centred(m: np.ndarray, c: np.ndarray, n: int, ridge: float = 0.0) -> dict:
    """Least squares of the last column on a constant and the others, from means and centred sums of products. Singular systems take a small ridge."""
    k = len(m)
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], float(c[-1, -1])
    size = np.sqrt(np.maximum(np.diag(xx), 0))
    try:
        # columns of one length, so that scale is no ill condition
        scaled = xx / np.outer(size, size) if (size > 0).all() else xx
        if not np.isfinite(scaled).all() or (len(xx) and np.linalg.cond(scaled) > 1e12):
            raise np.linalg.LinAlgError
        inv = np.linalg.inv(xx + ridge * np.eye(len(xx)))
    except np.linalg.LinAlgError:
        inv = np.linalg.inv(xx + 1e-8 * max(1.0, np.trace(xx) / max(len(xx), 1)) * np.eye(len(xx)))
    slope = inv @ xy
    b = np.r_[m[-1] - slope @ m[:-1], slope]
    rss = max(float(yy - slope @ xy), 0.0)
    s2 = rss / (n - k) if n > k else float("nan")
    var = np.r_[1 / n + m[:-1] @ inv @ m[:-1], np.diag(inv)] * s2
    se = np.sqrt(np.maximum(var, 0))
    return {"b": b, "se": se, "t": np.divide(b, se, out=np.full(k, np.nan), where=se > 0), "rss": rss, "r2": 1 - rss / yy if yy > 0 else float("nan"), "k": k, "n": n}


def _solve(found: DataFrame, keys: Sequence[str], names: Sequence[str], row: Callable[[np.ndarray, np.ndarray, int], list[tuple]], ddl: str) -> DataFrame:
    """Solves each key's `moments` in its own row; `row` gives output rows."""
    k = len(names)
    kinds = dict(found.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keys] + [ddl])
    cols = [x.split()[0] for x in ddl.split(", ")]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                for made in row(*_unpack(r, k), int(r["n"])):
                    out.append((*[r[c] for c in keys], *made))
            yield pd.DataFrame(out, columns=[*keys, *cols])

    return found.mapInPandas(run, schema)


def regression(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, term, coefficient, se, t, p, r2, n): ordinary least squares per key; polynomial terms are just columns."""
    def row(m: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:
        f = fit_centred(m, c, n)
        return [(t, float(b), float(s), float(v), special.t_two_sided(float(v), n - f["k"]) if n > f["k"] and np.isfinite(v) else None, f["r2"], n) for t, b, s, v in zip(["intercept", *xs], f["b"], f["se"], f["t"])]

    return _solve(moments(df, keys, [*xs, y]), keys, [*xs, y], row, "term string, coefficient double, se double, t double, p double, r2 double, rows bigint")


def vif(df: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """(keys, term, vif): diagonal of the inverse correlation matrix; infinite when singular."""
    def row(m: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:  # noqa: ARG001
        s = np.sqrt(np.diag(c))
        try:
            v = np.diag(np.linalg.inv(c / np.outer(s, s)))
        except np.linalg.LinAlgError:
            v = np.full(len(s), np.inf)
        return [(t, float(x)) for t, x in zip(xs, v)]

    return _solve(moments(df, keys, xs), keys, xs, row, "term string, vif double")


def _lagged(df: DataFrame, keys: Sequence[str], columns: dict[str, Callable[[Frames], Column]], most: int) -> DataFrame:
    """Rows of `numbered` with lagged columns."""
    f = Frames(keys=(*keys, "block"))
    return with_halo(df, before=most + 2).withColumns({n: c(f) for n, c in columns.items()}).where("not halo").drop("block", "halo")


def dickey_fuller(df: DataFrame, keys: Sequence[str], value: str, lags: int = 1, trend: bool = False) -> DataFrame:
    """(keys, statistic, lags, rows, stationary): augmented Dickey-Fuller with a constant, or with a straight trend too; 5 % critical values -2.86 and -3.41."""
    cols = {"_dy": lambda f: F.col(value) - f.lag(value), "_level": lambda f: f.lag(value), **{f"_l{i}": (lambda f, i=i: f.lag(value, i) - f.lag(value, i + 1)) for i in range(1, lags + 1)}}
    d = _lagged(df, keys, cols, lags + 1)
    xs = ["_level", *[f"_l{i}" for i in range(1, lags + 1)]]
    if trend:
        d, xs = d.withColumn("_trend", F.col("rn").cast("double")), [*xs, "_trend"]

    def row(m: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:
        t = float(fit_centred(m, c, n)["t"][1])
        return [(t, lags, n, bool(t < (-3.41 if trend else -2.86)))]

    return _solve(moments(d, keys, [*xs, "_dy"]), keys, [*xs, "_dy"], row, "statistic double, lags int, rows bigint, stationary boolean")


def granger(df: DataFrame, keys: Sequence[str], x: str, y: str, lags: int = 1) -> DataFrame:
    """(keys, f, p, rows): whether lags of x help to explain y beyond y's own lags."""
    cols = {**{f"_y{i}": (lambda f, i=i: f.lag(y, i)) for i in range(1, lags + 1)}, **{f"_x{i}": (lambda f, i=i: f.lag(x, i)) for i in range(1, lags + 1)}}
    d = _lagged(df, keys, cols, lags)
    names = [*[f"_y{i}" for i in range(1, lags + 1)], *[f"_x{i}" for i in range(1, lags + 1)], y]

    def row(m: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:
        full = fit_centred(m, c, n)
        keep = [*range(lags), len(m) - 1]
        less = fit_centred(m[keep], c[np.ix_(keep, keep)], n)
        df2 = n - full["k"]
        stat = (less["rss"] - full["rss"]) / lags / (full["rss"] / df2) if df2 > 0 and full["rss"] > 0 else float("nan")
        return [(stat, special.f_upper(stat, lags, df2) if np.isfinite(stat) else None, n)]

    return _solve(moments(d, keys, names), keys, names, row, "f double, p double, rows bigint")


def autoregression(df: DataFrame, keys: Sequence[str], value: str, order: int = 2) -> DataFrame:
    """(keys, term, coefficient, se, t, p, r2, rows): AR by least squares on lags."""
    cols = {f"lag{i}": (lambda f, i=i: f.lag(value, i)) for i in range(1, order + 1)}
    return regression(_lagged(df, keys, cols, order), keys, value, list(cols))


def vector_autoregression(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: int = 1) -> DataFrame:
    """One regression per value on the lags of all: (keys, target, term, coefficient, ...)."""
    cols = {f"{v}_lag{i}": (lambda f, v=v, i=i: f.lag(v, i)) for v in values for i in range(1, order + 1)}
    d = _lagged(df, keys, cols, order)
    out = None
    for v in values:
        r = regression(d, keys, v, list(cols)).withColumn("target", F.lit(v))
        out = r if out is None else out.union(r)
    return out


def autocorrelations(df: DataFrame, keys: Sequence[str], value: str, most: int = 10) -> DataFrame:
    """(keys, lag, acf, pacf, ljung_box, p): sample autocorrelations, Durbin-Levinson partial ones, cumulative Ljung-Box."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    c = df.join(m, keys).withColumn("_e", F.col(value) - F.col("_m"))
    d = _lagged(c, keys, {f"_e{i}": (lambda f, i=i: f.lag("_e", i)) for i in range(1, most + 1)}, most)
    s = d.groupBy(*keys).agg(F.count("_e").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("c0"), *[F.sum(F.col("_e") * F.col(f"_e{i}")).alias(f"c{i}") for i in range(1, most + 1)])
    kinds = dict(s.dtypes)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                rho = [r[f"c{i}"] / r["c0"] if r["c0"] else np.nan for i in range(1, most + 1)]
                phi, q, n = np.zeros((most + 1, most + 1)), 0.0, r["n"]
                for k in range(1, most + 1):
                    num = rho[k - 1] - sum(phi[k - 1, j] * rho[k - 1 - j] for j in range(1, k))
                    den = 1 - sum(phi[k - 1, j] * rho[j - 1] for j in range(1, k))
                    phi[k, k] = num / den if den else np.nan
                    for j in range(1, k):
                        phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
                    q += n * (n + 2) * rho[k - 1] ** 2 / (n - k) if n > k else np.nan
                    out.append((*[r[c] for c in keys], k, rho[k - 1], phi[k, k], q, special.chi2_upper(q, k) if np.isfinite(q) else None))
            yield pd.DataFrame(out, columns=[*keys, "lag", "acf", "pacf", "ljung_box", "p"])

    return s.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "lag int, acf double, pacf double, ljung_box double, p double"]))


def cross_lags(df: DataFrame, keys: Sequence[str], x: str, y: str, most: int = 10) -> DataFrame:
    """(keys, lag, corr): correlation of x with y `lag` rows later, for lags from -most to most."""
    f = Frames(keys=(*keys, "block"))
    shifted = {f"_s{i + most}": (f.lead(y, i) if i > 0 else f.lag(y, -i) if i < 0 else F.col(y)) for i in range(-most, most + 1)}
    d = with_halo(df, before=most, after=most).withColumns(shifted).where("not halo")
    g = d.groupBy(*keys).agg(F.array(*[F.struct(F.lit(i).alias("lag"), correlation(x, f"_s{i + most}").alias("corr")) for i in range(-most, most + 1)]).alias("a"))
    return g.select(*keys, F.explode("a").alias("a")).select(*keys, "a.lag", "a.corr")


def johansen(series: np.ndarray, lag: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, trace statistics) of the error-correction form; rows are times, columns series."""
    d, level = np.diff(series, axis=0)[lag - 1 :], series[lag - 1 : -1]
    n = len(d)
    s00, s11, s01 = d.T @ d / n, level.T @ level / n, d.T @ level / n
    m = np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)
    e = np.sort(np.clip(np.linalg.eigvals(m).real, 0, 1 - 1e-12))[::-1]
    return e, np.array([-n * np.log1p(-e[i:]).sum() for i in range(len(e))])


def logistic(df: DataFrame, xs: Sequence[str], y: str, l2: float = 1.0, rounds: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Coefficients (intercept first, not penalised) by Newton steps; each step is one aggregation of weighted moments."""
    k = len(xs) + 1
    b = np.zeros(k)
    for _ in range(rounds):
        eta = F.lit(float(b[0]))
        for c, x in zip(b[1:], xs):
            eta = eta + float(c) * F.col(x)
        p = 1 / (1 + F.exp(-eta))
        d = df.withColumn("_p", p).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12))).withColumn("_r", F.col(y) - F.col("_p"))
        names = ["_1", *xs]
        d = d.withColumn("_1", F.lit(1.0))
        got = d.agg(*[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col("_r") * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)]).first()
        if got["s0"] is None:
            return b
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        pen = np.diag([0.0, *[l2] * (k - 1)])
        step = np.linalg.solve(h + pen + 1e-10 * np.eye(k), np.array([got[f"s{i}"] for i in range(k)]) - pen @ b)
        b = b + step
        if np.abs(step).max() < tol:
            break
    return b
