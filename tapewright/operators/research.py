"""Event research: condition specs, conditional statistics, episodes, segments, masks, scaling, alignment and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.asof import asof_join
from tapewright.operators.blocks import TABLE_SHARD_S, Frames, numbered, with_halo
from tapewright.operators.islands import runs
from tapewright.operators.orderstats import interpolated, ordered_counts
from tapewright.runtime import cut


def matches(spec: dict, known: Sequence[str]) -> Column:
    """All of a spec's conditions: equality, membership of a list, or a (low, high) range with None open; unknown columns and nulls are false."""
    out = F.lit(True)
    for k, v in spec.items():
        if k not in known:
            return F.lit(False)
        c = F.col(k)
        if isinstance(v, tuple):
            lo, hi = v
            one = (c >= lo if lo is not None else c.isNotNull()) & (c <= hi if hi is not None else F.lit(True))
        else:
            one = c.isin(list(v)) if isinstance(v, (list, set)) else c == v
        out = out & F.coalesce(one, F.lit(False))
    return out


def conditional_statistics(df: DataFrame, keys: Sequence[str], outcome: str, direction: str | None, row: str, reps: int = 500, seed: int = 42) -> DataFrame:
    """(keys, n, p_up, p_with, mean, std, low, high, status): outcomes under each condition with a bootstrap interval of the mean.

    p_with is the share of outcomes that go with `direction` (1 or -1), null unless every row has one. status is
    INSUFFICIENT below 30 rows.
    """
    from tapewright.operators.resample import bootstrap_interval

    d = df.where(F.col(outcome).isNotNull())
    with_ = F.lit(None).cast("double") if direction is None else F.when(F.count(direction) == F.count("*"), F.avg((F.signum(outcome) == F.col(direction)).cast("int")))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(outcome) > 0).cast("int")).alias("p_up"), with_.alias("p_with"), F.stddev_pop(outcome).alias("std"))
    b = bootstrap_interval(d, keys, outcome, row, reps, seed)
    return g.join(b, list(keys)).withColumn("status", F.when(F.col("n") < 30, "INSUFFICIENT").otherwise("OK"))


def amount_batches(df: DataFrame, keys: Sequence[str], amount: str, person: str, least: int = 3, tolerance: float = 0.0) -> DataFrame:
    """(keys, low, high, people, rows): rows of a key whose amounts lie within `tolerance` of the smallest of their batch, with enough people.

    Greedy from the smallest amount. Without tolerance a batch is one amount and needs no ordering; with it, equal
    amounts are aggregated first and a key's distinct amounts are folded.
    """
    g = df.where(F.col(amount).isNotNull()).groupBy(*keys, amount).agg(F.collect_set(person).alias("_p"), F.count("*").alias("_n"))
    if not tolerance:
        return g.where(F.size("_p") >= least).select(*keys, F.col(amount).alias("low"), F.col(amount).alias("high"), F.size("_p").alias("people"), F.col("_n").alias("rows"))
    kinds = dict(df.dtypes)
    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "low double, high double, people int, rows bigint"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, cur = [], None
        for r in pdf.sort_values(amount).to_dict("records"):
            if cur is None or r[amount] > cur[0] + tolerance:
                cur = [r[amount], r[amount], set(), 0]
                out.append(cur)
            cur[1], cur[3] = r[amount], cur[3] + r["_n"]
            cur[2] |= set(r["_p"])
        k = [pdf[c].iloc[0] for c in keys]
        return pd.DataFrame([(*k, a, b, len(p), n) for a, b, p, n in out if len(p) >= least], columns=[*keys, "low", "high", "people", "rows"])

    return g.groupBy(*keys).applyInPandas(run, ddl)


def drawdown_episodes(equity: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, start, end, rows, depth, recovered): runs of rows (of `numbered`, with `peak`) below the running peak."""
    e = equity.withColumn("_u", F.col(value) < F.col("peak"))
    r = runs(e.select(*keys, "rn", "_u"), keys, "rn", "_u").where("_u")
    last = equity.groupBy(*keys).agg(F.max("rn").alias("_last"))
    d = equity.where(F.col(value) < F.col("peak")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("rn").alias("_rn"), F.timestamp_seconds("rn").alias("_t"), (F.col(value) / F.col("peak") - 1).alias("_dd"))
    starts = r.withColumn("_s", F.timestamp_seconds("start"))
    own = asof_join(d, starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_s", "start"), by=[f"_k{i}" for i in range(len(keys))], left_time="_t", right_time="_s", values=["start"])
    deep = own.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("r_start").alias("start")).agg(F.min("_dd").alias("depth"))
    out = r.join(deep, [*keys, "start"]).join(last, list(keys))
    return out.select(*keys, "start", "end", F.col("n").alias("rows"), "depth", (F.col("end") < F.col("_last")).alias("recovered"))


def regime_segments(returns: DataFrame, keys: Sequence[str], r: str, n: int = 20) -> DataFrame:
    """(keys, state, start, end, rows): runs of a state by rolling mean and deviation: calm or storm (deviation above the key's mean), up or down."""
    f = Frames(keys=(*keys, "block"))
    d = with_halo(returns, before=n).withColumns({"_m": F.avg(r).over(f.last(n)), "_s": F.stddev_samp(r).over(f.last(n))}).where(f"not halo and rn > {n}")
    level = d.groupBy(*keys).agg(F.avg("_s").alias("_level"))
    d = d.join(level, list(keys)).withColumn("state", F.concat_ws("_", F.when(F.col("_s") > F.col("_level"), "storm").otherwise("calm"), F.when(F.col("_m") >= 0, "up").otherwise("down")))
    return runs(d, keys, "rn", "state").withColumnRenamed("n", "rows")


def segment_transitions(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state, after, n, p): row-normalised transitions between neighbouring segments. Segments are few next to rows."""
    from pyspark.sql import Window

    from tapewright.operators.stats import transitions

    w = Window.partitionBy(*keys).orderBy("start")
    return transitions(segments.withColumn("after", F.lead("state").over(w)), keys, "state", "after")


def near_events(rows: DataFrame, events: DataFrame, ts: str, event_ts: str, bars: int, ties: Sequence[str]) -> DataFrame:
    """`rows` plus blocked: within `bars` rows of the row at or before an event. Events are joined as-of, then spread by frames."""
    n = numbered(rows.withColumn("_one", F.lit(1)), ["_one"], ts, ties, TABLE_SHARD_S)
    hit = asof_join(events.where(F.col(event_ts).isNotNull()).select(F.col(event_ts).alias("_e"), F.lit(1).alias("_one")), n.select("_one", F.col(ts).alias("_t"), "rn"), by=["_one"], left_time="_e", right_time="_t", values=["rn"], tie="rn")
    marks = hit.where("r_rn is not null").select(F.col("r_rn").alias("rn")).distinct().withColumn("_h", F.lit(1))
    f = Frames(keys=("_one", "block"))
    d = with_halo(n.join(marks, "rn", "left"), before=bars, after=bars)
    return d.withColumn("blocked", F.max("_h").over(f.w.rowsBetween(-bars, bars)).isNotNull()).where("not halo").drop("_one", "rn", "_h", "block", "halo")


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` plus (value - median) / interquartile range per key; 0 where the range is zero."""
    q = ordered_counts(df, keys, value).groupBy(*keys).agg(interpolated(value, 0.5).alias("_m"), interpolated(value, 0.25).alias("_a"), interpolated(value, 0.75).alias("_b"))
    iqr = F.col("_b") - F.col("_a")
    return df.join(q, list(keys), "left").withColumn(name, F.when(iqr > 0, (F.col(value) - F.col("_m")) / F.when(iqr > 0, iqr)).otherwise(0.0)).drop("_m", "_a", "_b")


def misaligned(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has, or that a side has twice: empty means the two align one to one."""
    n = lambda d, c: d.groupBy(*on).agg(F.count("*").alias(c))
    j = n(a, "left_rows").join(n(b, "right_rows"), list(on), "full_outer").fillna(0, ["left_rows", "right_rows"])
    return j.where("left_rows <> 1 or right_rows <> 1")


def conflicts(df: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per key, the first by `order`; keys whose rows differ in content)."""
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"), F.count_distinct(F.xxhash64(*cols)).alias("_n"))
    return g.select(key, "r.*"), g.where("_n > 1").select(key)


def prefix_differences(full: DataFrame, prefix: DataFrame, available: str, cutoff: Column) -> DataFrame:
    """Rows on which a run over the prefix and the full run differ, of outputs available by the cutoff: empty means no look-ahead."""
    a, b = full.where(F.col(available) <= cutoff), prefix.where(F.col(available) <= cutoff)
    return a.exceptAll(b).withColumn("side", F.lit("full")).unionByName(b.exceptAll(a).withColumn("side", F.lit("prefix")))


def effective_sample_size(n: Column, rho: Column) -> Column:
    """Of an AR(1) series, at least 1 and at most n."""
    return F.greatest(F.lit(1.0), F.least(n.cast("double"), n * (1 - rho) / F.when(1 + rho > 0, 1 + rho)))


def chi_square(df: DataFrame, keys: Sequence[str], category: str, expected: dict) -> DataFrame:
    """(keys, statistic, df, p, testable): goodness of fit to given shares; not testable if an expected count is below 5."""
    from tapewright.functions.special import chi2_upper_col

    g = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(category) == c, 1)).alias(f"_o{i}") for i, c in enumerate(expected)])
    parts = [F.pow(F.col(f"_o{i}") - F.col("_n") * p, F.lit(2.0)) / (F.col("_n") * p) for i, p in enumerate(expected.values())]
    s = reduce(lambda a, b: a + b, parts)
    k = float(len(expected) - 1)
    return g.withColumn("statistic", s).select(*keys, "statistic", F.lit(k).alias("df"), chi2_upper_col(F.col("statistic"), F.lit(k)).alias("p"), (F.col("_n") * min(expected.values()) >= 5).alias("testable"))


def heteroscedasticity(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """(keys, lm, p): Breusch-Pagan: n times R^2 of squared residuals on x."""
    from tapewright.functions.special import chi2_upper_col

    f = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    e = df.join(f, list(keys)).withColumn("_e2", F.pow(F.col(y) - F.col("_a") - F.col("_b") * F.col(x), F.lit(2.0)))
    g = e.groupBy(*keys).agg((F.count("_e2") * F.regr_r2("_e2", x)).alias("lm"))
    return g.withColumn("p", chi2_upper_col(F.col("lm"), F.lit(1.0)))


def cointegration(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """(keys, slope, statistic, cointegrated): Engle-Granger: residuals of y on x under Dickey-Fuller; rows come from `numbered`; 5 % value -3.34."""
    from tapewright.operators.linear import dickey_fuller

    f = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("_a"))
    e = df.join(f, list(keys)).withColumn("_res", F.col(y) - F.col("_a") - F.col("slope") * F.col(x))
    t = dickey_fuller(e.select(*keys, "rn", "_res"), keys, "_res").select(*keys, "statistic", (F.col("statistic") < -3.34).alias("cointegrated"))
    return f.select(*keys, "slope").join(t, list(keys))


def arma(df: DataFrame, keys: Sequence[str], value: str, p: int = 1, q: int = 1, d: int = 0, season: int = 0) -> DataFrame:
    """Two-stage ARMA (long autoregression, then lags of values and of its residuals) after d differences and one seasonal one: (keys, term, coefficient, ...)."""
    from tapewright.operators.linear import _lagged, regression

    v, x = value, df
    for i in range(d):
        x = _lagged(x, keys, {f"_d{i}": (lambda f, v=v: F.col(v) - f.lag(v))}, 1)
        v = f"_d{i}"
    if season:
        x = _lagged(x, keys, {"_sd": (lambda f, v=v: F.col(v) - f.lag(v, season))}, season)
        v = "_sd"
    long = p + q + 2
    lags = {f"_L{i}": (lambda f, i=i, v=v: f.lag(v, i)) for i in range(1, long + 1)}
    x = _lagged(x, keys, lags, long)
    fit = regression(x, keys, v, list(lags)).groupBy(*keys).pivot("term", ["intercept", *lags]).agg(F.first("coefficient"))
    fit = fit.select(*keys, *[F.col(c).alias(f"c{c}") for c in ["intercept", *lags]])
    x = x.join(fit, list(keys))
    hat = reduce(lambda a, b: a + b, [F.col(f"c{c}") * F.col(c) for c in lags], F.col("cintercept"))
    x = x.withColumn("_e", F.col(v) - hat).drop(*[f"c{c}" for c in ["intercept", *lags]])
    second = {**{f"ar{i}": (lambda f, i=i, v=v: f.lag(v, i)) for i in range(1, p + 1)}, **{f"ma{i}": (lambda f, i=i: f.lag("_e", i)) for i in range(1, q + 1)}}
    return regression(_lagged(x, keys, second, max(p, q)), keys, v, list(second))


def directional_value(df: DataFrame, keys: Sequence[str], state: str, close: str, horizon: int = 5, holdout: float = 0.3, block: int = 20, reps: int = 999, seed: int = 42) -> DataFrame:
    """(keys, n, mean, p): the mean forward log return signed by UP, DOWN or RANGE over the last `holdout` share of a key's rows (of `numbered`), and its p against zero.

    p is the share of moving-block bootstrap means of the centred outcomes that are at least as far from zero. Rows without a
    state, or without `horizon` rows ahead, have no outcome.
    """
    from tapewright.operators.resample import bootstrap_means

    keys = list(keys)
    f = Frames(keys=(*keys, "block"))
    size = df.groupBy(*keys).agg(F.max("rn").alias("_n"))
    sign = F.when(F.col(state) == "UP", 1.0).when(F.col(state) == "DOWN", -1.0).when(F.col(state) == "RANGE", 0.0)
    d = with_halo(df, after=horizon).withColumn("_y", sign * F.ln(f.lead(close, horizon) / F.col(close))).where("not halo").drop("block", "halo").join(size, keys)
    d = cut(d.where(F.col("_y").isNotNull() & (F.col("rn") > F.floor(F.col("_n") * (1 - holdout)))).select(*keys, "rn", "_y"))
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_y").alias("mean"))
    e = with_halo(d.join(m, keys).withColumn("_e", F.col("_y") - F.col("mean")).select(*keys, "rn", "_e"), after=block)
    w = f.w.rowsBetween(0, block - 1)
    e = e.withColumns({"_m": F.avg("_e").over(w), "_k": F.count("_e").over(w)}).where(f"not halo and _k = {block}")
    b = bootstrap_means(e, keys, "_m", "rn", reps, seed, rate=1.0 / block).withColumnRenamed("mean", "_null").join(m, keys)
    p = b.groupBy(*keys).agg(((1 + F.count(F.when(F.abs("_null") >= F.abs("mean"), 1))) / (reps + 1)).alias("p"))
    return m.join(p, keys, "left")


def reaction_delay(df: DataFrame, keys: Sequence[str], event: str, response: str, threshold: float = 2.0, most: int = 20) -> DataFrame:
    """(keys, lag, mean_abs_z): mean absolute z of the response 0..most rows after events beyond the threshold; the largest per key is the delay."""
    z = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in (event, response) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    d = df.join(z, list(keys)).withColumns({"_ez": F.try_divide(F.col(event) - F.col(f"_m_{event}"), F.col(f"_s_{event}")), "_rz": F.try_divide(F.col(response) - F.col(f"_m_{response}"), F.col(f"_s_{response}"))})
    f = Frames(keys=(*keys, "block"))
    d = with_halo(d, after=most).withColumns({f"_r{i}": (f.lead("_rz", i) if i else F.col("_rz")) for i in range(most + 1)}).where("not halo").where(F.abs("_ez") > threshold)
    g = d.groupBy(*keys).agg(F.array(*[F.struct(F.lit(i).alias("lag"), F.avg(F.abs(f"_r{i}")).alias("mean_abs_z")) for i in range(most + 1)]).alias("a"))
    return g.select(*keys, F.explode("a").alias("a")).select(*keys, "a.lag", "a.mean_abs_z")


def correlation_breaks(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 10, threshold: float = 0.3) -> DataFrame:
    """(keys, at, before, after): the split with the largest change of correlation, by running sums of moments; only changes above the threshold."""
    from tapewright.operators.blocks import running_totals

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_1": F.lit(1.0), "_x": F.col(x), "_y": F.col(y), "_xx": F.col(x) * F.col(x), "_yy": F.col(y) * F.col(y), "_xy": F.col(x) * F.col(y)})
    names = ["_1", "_x", "_y", "_xx", "_yy", "_xy"]
    t = running_totals(d, keys, names)
    total = d.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_all") for c in names])
    t = t.join(total, list(keys))

    def r(g) -> Column:  # noqa: ANN001
        n, sx, sy, xx, yy, xy = (g(c) for c in names)
        den = F.sqrt(F.greatest((n * xx - sx * sx) * (n * yy - sy * sy), F.lit(0.0)))
        return F.when(den > 0, (n * xy - sx * sy) / F.when(den > 0, den))

    t = t.withColumns({"before": r(lambda c: F.col(f"{c}_total")), "after": r(lambda c: F.col(f"{c}_all") - F.col(f"{c}_total"))})
    t = t.where((F.col("_1_total") >= least) & (F.col("_1_all") - F.col("_1_total") >= least) & F.col("before").isNotNull() & F.col("after").isNotNull())
    b = t.groupBy(*keys).agg(F.max_by(F.struct(F.col("rn").alias("at"), "before", "after"), F.struct(F.abs(F.col("before") - F.col("after")), -F.col("rn"))).alias("b"))
    return b.select(*keys, "b.*").where(F.abs(F.col("before") - F.col("after")) > threshold)
