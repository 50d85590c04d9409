"""Aggregates, performance and risk measures, tests and probability models as aggregate columns and grouped queries.

Builders return aggregate columns for groupBy().agg(); all are algebraic, so they combine map-side. Where two
definitions go by one name, a `variant` chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import special
from tapewright.operators.orderstats import ordered_counts
from tapewright.runtime import cut


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _guard(ok: Column, v: Column, other: float | None = 0.0) -> Column:
    return F.when(ok, v).otherwise(F.lit(other).cast("double"))


# moments

def skewness(x: Column | str, variant: str = "population") -> Column:
    """population: m3 / m2^1.5; adjusted: n / ((n - 1)(n - 2)) times the sum of cubed population z; 0 when flat or too few."""
    x = _c(x)
    n = F.count(x).cast("double")
    g = F.skewness(x)
    v = g if variant == "population" else g * n * n / F.when(n > 2, (n - 1) * (n - 2))
    return F.coalesce(_guard((n > 2) & (F.var_pop(x) > 0), v), F.lit(0.0))


def kurtosis(x: Column | str, excess: bool = True, variant: str = "population") -> Column:
    """population: m4 / m2^2; adjusted: the usual small-sample correction; sample_factor: its factors on the population deviation. 3 is taken off for the excess."""
    x = _c(x)
    n = F.count(x).cast("double")
    k = F.kurtosis(x)
    if variant == "adjusted":
        k = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    elif variant == "sample_factor":
        k = F.when(n > 3, n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * n * (k + 3) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    return F.coalesce(_guard((n > 3) & (F.var_pop(x) > 0), k + (0.0 if excess else 3.0)), F.lit(0.0))


# returns

def win_rate(r: Column | str) -> Column:
    return F.avg(F.when(_c(r).isNotNull(), (_c(r) > 0).cast("int")))


def loss_rate(r: Column | str) -> Column:
    return F.avg(F.when(_c(r).isNotNull(), (_c(r) < 0).cast("int")))


def average_win(r: Column | str) -> Column:
    return F.coalesce(F.avg(F.when(_c(r) > 0, _c(r))), F.lit(0.0))


def average_loss(r: Column | str) -> Column:
    return F.coalesce(F.avg(F.when(_c(r) < 0, _c(r))), F.lit(0.0))


def win_loss_ratio(r: Column | str) -> Column:
    loss = average_loss(r)
    return _guard(loss != 0, F.abs(average_win(r) / F.when(loss != 0, loss)))


def profit_factor(r: Column | str) -> Column:
    """Gains over losses; infinite without losses, 0 without either."""
    up, dn = F.coalesce(F.sum(F.when(_c(r) > 0, _c(r))), F.lit(0.0)), F.coalesce(F.sum(F.when(_c(r) < 0, -_c(r))), F.lit(0.0))
    return F.when(dn == 0, F.when(up > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(up / F.when(dn != 0, dn))


def omega(r: Column | str, threshold: float = 0.0) -> Column:
    x = _c(r) - threshold
    up, dn = F.sum(F.greatest(x, F.lit(0.0))), F.sum(F.greatest(-x, F.lit(0.0)))
    return F.when(dn == 0, F.when(up > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(up / F.when(dn != 0, dn))


def annual(r: Column | str, ppy: int = 252) -> Column:
    """The mean compounded over a year."""
    return F.pow(1 + F.avg(_c(r)), F.lit(float(ppy))) - 1


def sharpe(r: Column | str, rf: float = 0.0, ppy: int = 252, variant: str = "mean") -> Column:
    """mean: (mean - rf per period) / sample deviation, annualised by the root; compounded: annual mean over annual deviation; plain: not annualised; backtest: population deviation plus 1e-8. 0 when flat."""
    s = F.stddev_samp(_c(r))
    how = {"mean": (F.avg(_c(r)) - rf / ppy) / F.when(s != 0, s) * ppy**0.5, "compounded": (annual(r, ppy) - rf) / F.when(s != 0, s * ppy**0.5), "plain": (F.avg(_c(r)) - rf) / F.when(s != 0, s), "backtest": F.avg(_c(r)) / (F.stddev_pop(_c(r)) + 1e-8) * ppy**0.5}
    return _guard(s != 0, how[variant])


def downside_deviation(r: Column | str, variant: str = "negatives") -> Column:
    """negatives: sample deviation of the negative returns (fewer than two: 0); all: root mean square of losses over all rows."""
    neg = F.when(_c(r) < 0, _c(r))
    if variant == "negatives":
        return F.coalesce(F.when(F.count(neg) > 1, F.stddev_samp(neg)), F.lit(0.0))
    return F.sqrt(F.avg(F.pow(F.least(_c(r), F.lit(0.0)), F.lit(2.0))))


def sortino(r: Column | str, rf: float = 0.0, ppy: int = 252, variant: str = "negatives") -> Column:
    s = downside_deviation(r, variant)
    top = (F.avg(_c(r)) - rf / ppy) * ppy**0.5 if variant == "negatives" else (annual(r, ppy) - rf) / ppy**0.5
    return _guard(s != 0, top / F.when(s != 0, s))


def beta(a: Column | str, m: Column | str) -> Column:
    v = F.var_samp(F.when(_c(a).isNotNull(), _c(m)))
    return _guard(v != 0, F.covar_samp(_c(a), _c(m)) / F.when(v != 0, v))


def tracking_error(a: Column | str, m: Column | str) -> Column:
    return F.stddev_samp(_c(a) - _c(m))


# regression and tests

def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of rows that have both values; null without variance."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    s = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.when(s > 0, s)


def ols(y: Column | str, x: Column | str) -> dict[str, Column]:
    """slope, intercept, r2, see: simple least squares; see is the standard error of estimate."""
    y, x = _c(y), _c(x)
    n = F.regr_count(y, x)
    sse = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2.0)) / F.when(F.regr_sxx(y, x) > 0, F.regr_sxx(y, x))
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x), "see": F.sqrt(F.greatest(sse, F.lit(0.0)) / F.when(n > 2, n - 2))}


def t_statistic(x: Column | str, mu: float = 0.0, variant: str = "sample") -> Column:
    """(mean - mu) / (deviation / root n) with the sample or population deviation; null when flat."""
    s = F.stddev_samp(_c(x)) if variant == "sample" else F.stddev_pop(_c(x))
    return (F.avg(_c(x)) - mu) / F.when(s > 0, s / F.sqrt(F.count(_c(x)).cast("double")))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a proportion, clamped to [0, 1]."""
    n, k = n.cast("double"), k.cast("double")
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def jarque_bera(x: Column | str) -> Column:
    """n / 6 (skewness^2 + excess kurtosis^2 / 4)."""
    x = _c(x)
    return F.count(x) / 6 * (F.pow(F.skewness(x), F.lit(2.0)) + F.pow(F.kurtosis(x), F.lit(2.0)) / 4)


def brier(p: Column | str, y: Column | str) -> Column:
    return F.avg(F.pow(_c(p) - _c(y), F.lit(2.0)))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): Pearson correlation of average-tie ranks of rows that have both values."""
    # equal pairs are one row; the ranks of both values are found on the pairs, not on each other's result
    given = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = cut(df.where(given(x) & given(y)).groupBy(*keys, x, y).agg(F.count("*").alias("_n")))
    rank = lambda v, name: ordered_counts(d, keys, v, "_n").select(*keys, v, (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    r = d.join(rank(x, "_rx"), [*keys, x]).join(rank(y, "_ry"), [*keys, y])
    # centred on the mean rank (n + 1) / 2, which is exact, so no digits cancel
    n = d.groupBy(*keys).agg(F.sum("_n").alias("n"))
    r = r.join(n, [*keys]).withColumns({"_rx": F.col("_rx") - (F.col("n") + 1) / 2, "_ry": F.col("_ry") - (F.col("n") + 1) / 2})
    total = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_n"))
    spread = F.sqrt(total("_rx", "_rx") * total("_ry", "_ry"))
    return r.groupBy(*keys).agg(F.sum("_n").alias("n"), F.when(spread > 0, total("_rx", "_ry") / spread).alias("rho"))


def adjust_p(df: DataFrame, p: str, tie: str, method: str = "bh") -> DataFrame:
    """`df` (one row per hypothesis) plus adjusted: Benjamini-Hochberg step-up (bh), Holm step-down (holm) or Bonferroni's bound (bonferroni).

    Hypotheses are few next to the data (one per group tested), so one window orders them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1).alias("one")).orderBy(p, tie)
    m = F.count(p).over(Window.partitionBy(F.lit(1).alias("one")))
    d = df.where(F.col(p).isNotNull()).withColumn("_k", F.row_number().over(w)).withColumn("_m", m)
    if method == "bonferroni":
        return d.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_k", "_m")
    if method == "bh":
        d = d.withColumn("_a", F.col(p) * F.col("_m") / F.col("_k"))
        back = Window.partitionBy(F.lit(1).alias("one")).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumn("adjusted", F.least(F.lit(1.0), F.min("_a").over(back))).drop("_k", "_m", "_a")
    d = d.withColumn("_a", F.col(p) * (F.col("_m") - F.col("_k") + 1))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("adjusted", F.least(F.lit(1.0), F.max("_a").over(up))).drop("_k", "_m", "_a")


def state_edges(df: DataFrame, fields: Sequence[str], outcome: str, null_p: float = 0.5, least: int = 30, q: float = 0.05) -> DataFrame:
    """One row per state: trials, wins, rate, Wilson interval, exact one-sided p (null below `least` trials), BH-adjusted p, edge."""
    g = df.where(F.col(outcome).isNotNull()).groupBy(*fields).agg(F.count("*").alias("trials"), F.sum(F.col(outcome).cast("int")).alias("wins"))
    lo, hi = wilson(F.col("wins"), F.col("trials"))
    g = g.withColumns({"rate": F.col("wins") / F.col("trials"), "low": lo, "high": hi, "state_key": F.concat_ws("|", *[F.col(f).cast("string") for f in fields])})
    tested = g.where(F.col("trials") >= least).withColumn("p", special.binomial_greater_col(F.col("wins").cast("double"), F.col("trials").cast("double"), F.lit(null_p)))
    tested = adjust_p(tested, "p", "state_key").withColumn("edge", F.col("adjusted") <= q)
    rest = g.where(F.col("trials") < least).withColumns({"p": F.lit(None).cast("double"), "adjusted": F.lit(None).cast("double"), "edge": F.lit(False)})
    return tested.unionByName(rest)


# information and chains

def entropy(df: DataFrame, keys: Sequence[str], x: str, base: float = 2.0) -> DataFrame:
    """(keys, entropy): plug-in Shannon entropy of a discrete column."""
    n = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("t"))
    p = n.join(t, list(keys)).withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(base))).alias("entropy"))


def mutual_information(df: DataFrame, keys: Sequence[str], x: str, y: str, base: float = 2.0) -> DataFrame:
    """(keys, information): plug-in mutual information of two discrete columns."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("n"))
    side = lambda c, name: n.groupBy(*keys, c).agg(F.sum("n").alias(name))
    t = n.groupBy(*keys).agg(F.sum("n").alias("t"))
    j = n.join(side(x, "nx"), [*keys, x]).join(side(y, "ny"), [*keys, y]).join(t, list(keys))
    return j.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))) / F.ln(F.lit(base))).alias("information"))


def transitions(df: DataFrame, keys: Sequence[str], state: str, after: str) -> DataFrame:
    """(keys, state, after, n, p): row-normalised transition counts."""
    n = df.where(F.col(state).isNotNull() & F.col(after).isNotNull()).groupBy(*keys, state, after).agg(F.count("*").alias("n"))
    t = n.groupBy(*keys, state).agg(F.sum("n").alias("_t"))
    return n.join(t, [*keys, state]).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def histogram(df: DataFrame, keys: Sequence[str], x: str, bins: int = 10) -> DataFrame:
    """(keys, bin, low, high, n): equal-width bins, the last one closed; a flat key has all rows in bin 0."""
    e = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    b = F.when(F.col("_b") == F.col("_a"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_a")) / F.when(width > 0, width)), F.lit(bins - 1)))
    d = df.where(F.col(x).isNotNull()).join(e, list(keys)).withColumn("bin", b.cast("int"))
    g = d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return g.select(*keys, "bin", F.round(F.col("_a") + F.col("bin") * width, 8).alias("low"), F.round(F.col("_a") + (F.col("bin") + 1) * width, 8).alias("high"), "n")


def calibration(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """(keys, bin, n, predicted, actual): reliability by floor(p * bins), filled bins only."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual"))


def weighted(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """(keys, n, mean, variance, std, least, most): weighted mean and (population) variance; null where the weights sum to zero."""
    d = df.where(F.col(x).isNotNull() & F.col(w).isNotNull())
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    v = d.join(m.select(*keys, "mean"), list(keys)).groupBy(*keys).agg(F.try_divide(F.sum(F.col(w) * F.pow(F.col(x) - F.col("mean"), F.lit(2.0))), F.sum(w)).alias("variance"))
    return m.join(v, list(keys)).withColumn("std", F.sqrt("variance"))


def empirical_cdf(df: DataFrame, keys: Sequence[str], x: str, points: Sequence[float]) -> DataFrame:
    """(keys, x, p): the share of values at or below each point of a short list."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(p)).alias("x"), F.avg((F.col(x) <= float(p)).cast("int")).alias("p")) for p in points]).alias("_a"))
    return g.select(*keys, F.explode("_a").alias("_a")).select(*keys, "_a.x", "_a.p")


def conditional_frequencies(df: DataFrame, keys: Sequence[str], x: str, label: str, bins: int = 10) -> DataFrame:
    """(keys, bin, label, n, p): label shares within equal-width bins of x; a flat key has all rows in bin 0."""
    d = df.where(F.col(x).isNotNull() & F.col(label).isNotNull())
    e = d.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - F.col("_a")) / ((F.col("_z") - F.col("_a")) / bins))))
    d = d.join(e, list(keys)).withColumn("bin", F.when(F.col("_z") > F.col("_a"), b).otherwise(0).cast("int"))
    return transitions(d.select(*keys, "bin", label), keys, "bin", label)


def grid_likelihood(df: DataFrame, keys: Sequence[str], grid: Sequence[dict[str, float]], log_likelihood: Callable[[dict[str, float]], Column]) -> DataFrame:
    """(keys, parameters, log_likelihood): the parameters of a grid with the largest sum of a row's log-likelihood; equal ones go to the earlier. One aggregation."""
    names = list(grid[0])
    tried = [F.struct(F.sum(log_likelihood(p)).alias("ll"), F.lit(-i).alias("i"), *[F.lit(float(p[n])).alias(n) for n in names]) for i, p in enumerate(grid)]
    return df.groupBy(*keys).agg(F.array_max(F.array(*tried)).alias("_b")).select(*keys, *[F.col(f"_b.{n}").alias(n) for n in names], F.col("_b.ll").alias("log_likelihood"))


def prediction_interval(df: DataFrame, keys: Sequence[str], y: str, x: str, order: str, level: float = 0.95) -> DataFrame:
    """(keys, prediction, scale, df, low, high): a new y at the last x by simple regression, the residuals' error times sqrt(1 + 1 / n), and the bounds at `level`."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    g = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_syy(y, x).alias("_yy"), F.regr_sxx(y, x).alias("_xx"), F.max_by(x, order).alias("_x")).where("_n > 2")
    rss = F.greatest(F.col("_yy") - F.col("_b") * F.col("_b") * F.col("_xx"), F.lit(0.0))
    g = g.withColumns({"prediction": F.col("_a") + F.col("_b") * F.col("_x"), "df": F.col("_n") - 2, "scale": F.sqrt(rss / (F.col("_n") - 2)) * F.sqrt(1 + 1 / F.col("_n"))})
    t = special.t_quantile_col(F.lit((1 + level) / 2), F.col("df").cast("double"))
    return g.select(*keys, "prediction", "scale", "df", (F.col("prediction") - t * F.col("scale")).alias("low"), (F.col("prediction") + t * F.col("scale")).alias("high"))
