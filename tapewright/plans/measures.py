"""Queries of aggregates, risk, tests and probability models over the returns of all clean bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import orderstats, rolling, stats
from tapewright.operators.blocks import running_totals
from tapewright.plans.base import BARS, W, clean_bars, framed_bars, own
from tapewright.runtime import cut

QUERIES, SQL = {}, {}
_R = f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def returns(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=1)
    return own(df.withColumn("ret", rolling.pct_return(f, "close"))).drop("block", "halo").where("ret is not null")


def _round(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""{_R} SELECT series, count(*) AS n, round(avg(ret), 10) AS mean, round(sum(ret), 8) AS total, min(ret) AS least, max(ret) AS most, round(stddev_samp(ret), 9) AS std, round(sqrt(var_pop(ret)), 9) AS std_pop, round(skewness_pop, 6) AS skew, round(kurt, 5) AS kurt,
  round(quantile_cont(ret, 0.25), 10) AS q1, round(median(ret), 10) AS median, round(quantile_cont(ret, 0.75), 10) AS q3, round(quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25), 9) AS iqr
  FROM v JOIN (SELECT series, sum(power(ret - m, 3)) / count(*) / power(any_value(s), 3) AS skewness_pop, sum(power(ret - m, 4)) / count(*) / power(any_value(s), 4) - 3 AS kurt FROM v JOIN (SELECT series, avg(ret) AS m, stddev_pop(ret) AS s FROM v GROUP BY 1) USING (series) GROUP BY series) USING (series) GROUP BY series, skewness_pop, kurt""")
def m_describe(spark: SparkSession, d: str) -> DataFrame:
    r = cut(returns(spark, d).select("series", "ret"))
    a = r.groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 10).alias("mean"), F.round(F.sum("ret"), 8).alias("total"), F.min("ret").alias("least"), F.max("ret").alias("most"), F.round(F.stddev_samp("ret"), 9).alias("std"), F.round(F.stddev_pop("ret"), 9).alias("std_pop"), F.round(stats.skewness("ret"), 6).alias("skew"), F.round(stats.kurtosis("ret"), 5).alias("kurt"))
    q = orderstats.ordered_counts(r, ["series"], "ret").groupBy("series").agg(*[orderstats.interpolated("ret", p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    q = q.select("series", *[F.round(c, 10).alias(c) for c in ("q1", "median", "q3")], F.round(F.col("q3") - F.col("q1"), 9).alias("iqr"))
    return a.join(q, "series")


@query(f"""{_R}, g AS (SELECT series, avg((ret > 0)::INT) AS win_rate, avg((ret < 0)::INT) AS loss_rate, coalesce(avg(ret) FILTER (ret > 0), 0) AS average_win, coalesce(avg(ret) FILTER (ret < 0), 0) AS average_loss, sum(ret) FILTER (ret > 0) AS up, -sum(ret) FILTER (ret < 0) AS dn, avg(ret) AS m, stddev_samp(ret) AS s,
  stddev_samp(ret) FILTER (ret < 0) AS ds, sqrt(avg(power(least(ret, 0), 2))) AS da FROM v GROUP BY series)
 SELECT series, round(win_rate, 8) AS win_rate, round(loss_rate, 8) AS loss_rate, round(average_win, 9) AS average_win, round(average_loss, 9) AS average_loss, round(abs(average_win / average_loss), 6) AS ratio, round(up / dn, 6) AS profit_factor, round(up / dn, 6) AS omega,
  round(m / s * sqrt(252), 6) AS sharpe, round((power(1 + m, 252) - 1) / (s * sqrt(252)), 6) AS sharpe_compounded, round(m / s, 7) AS sharpe_plain, round(m / ds * sqrt(252), 6) AS sortino, round((power(1 + m, 252) - 1) / (da * sqrt(252)), 6) AS sortino_all FROM g""")
def m_performance(spark: SparkSession, d: str) -> DataFrame:
    g = returns(spark, d).groupBy("series")
    c = {"win_rate": (stats.win_rate("ret"), 8), "loss_rate": (stats.loss_rate("ret"), 8), "average_win": (stats.average_win("ret"), 9), "average_loss": (stats.average_loss("ret"), 9), "ratio": (stats.win_loss_ratio("ret"), 6), "profit_factor": (stats.profit_factor("ret"), 6), "omega": (stats.omega("ret"), 6), "sharpe": (stats.sharpe("ret"), 6), "sharpe_compounded": (stats.sharpe("ret", variant="compounded"), 6), "sharpe_plain": (stats.sharpe("ret", variant="plain"), 7), "sortino": (stats.sortino("ret"), 6), "sortino_all": (stats.sortino("ret", variant="all"), 6)}
    return g.agg(*[F.round(x, n).alias(k) for k, (x, n) in c.items()])


@query(f"""{_R}, o AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM v), k AS (SELECT series, any_value(n) AS n, -max(ret) FILTER (i = CAST(floor(0.05 * n) AS BIGINT)) AS var95 FROM o GROUP BY series),
 h AS (SELECT series, quantile_cont(-ret, 0.95) AS hv FROM v GROUP BY series)
 SELECT o.series, round(any_value(var95), 10) AS var95, round(-avg(ret) FILTER (ret <= -var95), 10) AS cvar95, round(any_value(hv), 10) AS var95_interpolated, round(avg(-ret) FILTER (-ret >= hv), 9) AS shortfall95 FROM o JOIN k USING (series) JOIN h USING (series) GROUP BY o.series""")
def m_value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    """Value at risk by index pick and by interpolation, each with the mean loss beyond it."""
    r = returns(spark, d)
    oc = orderstats.ordered_counts(r, ["series"], "ret")
    q = oc.groupBy("series").agg((-orderstats.at_index("ret", F.floor(F.lit(0.05) * F.col("total")))).alias("var95"), (-orderstats.interpolated("ret", 0.05)).alias("hv"))
    t = oc.join(q, "series").groupBy("series").agg(F.first("var95").alias("var95"), (-F.sum(F.when(F.col("ret") <= -F.col("var95"), F.col("ret") * F.col("n"))) / F.sum(F.when(F.col("ret") <= -F.col("var95"), F.col("n")))).alias("cvar95"), F.first("hv").alias("var95_interpolated"), (-F.sum(F.when(-F.col("ret") >= F.col("hv"), F.col("ret") * F.col("n"))) / F.sum(F.when(-F.col("ret") >= F.col("hv"), F.col("n")))).alias("shortfall95"))
    return t.select("series", *[F.round(c, 10).alias(c) for c in ("var95", "cvar95", "var95_interpolated")], F.round("shortfall95", 9).alias("shortfall95"))


@query(f"""{_R}, e AS (SELECT series, rn, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY rn)) AS equity FROM v), p AS (SELECT *, greatest(100, max(equity) OVER (PARTITION BY series ORDER BY rn)) AS peak FROM e)
 SELECT series, round(arg_max(equity, rn), 6) AS final, round(min(equity / peak - 1), 8) AS max_drawdown, count(*) FILTER (equity < peak) AS under_water FROM p GROUP BY series""")
def m_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Equity from 100, its deepest drawdown and the rows below the peak; products as sums of logs by block."""
    r = running_totals(returns(spark, d).withColumn("ln", F.ln(1 + F.col("ret"))), ["series"], ["ln"])
    r = r.withColumn("equity", 100 * F.exp("ln_total"))
    b = r.withColumn("_b", F.floor(F.col("rn") / F.lit(100_000)))
    from pyspark.sql import Window

    tops = b.groupBy("series", "_b").agg(F.max("equity").alias("_m"))
    before = Window.partitionBy("series").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("series", "_b", F.max("_m").over(before).alias("_p"))
    upto = Window.partitionBy("series", "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    p = b.join(tops, ["series", "_b"]).withColumn("peak", F.greatest(F.lit(100.0), F.max("equity").over(upto), F.col("_p")))
    return p.groupBy("series").agg(F.round(F.max_by("equity", "rn"), 6).alias("final"), F.round(F.min(F.col("equity") / F.col("peak") - 1), 8).alias("max_drawdown"), F.count(F.when(F.col("equity") < F.col("peak"), 1)).alias("under_water"))


@query(f"""{_R}, m AS (SELECT split_part(series, '|', 2) AS symbol, ts, avg(ret) AS mkt FROM v GROUP BY ALL), j AS (SELECT series, ret, mkt FROM v JOIN m ON m.symbol = split_part(v.series, '|', 2) AND m.ts = v.ts)
 SELECT series, round(covar_samp(ret, mkt) / var_samp(mkt), 5) AS beta, round(corr(ret, mkt), 6) AS corr, round(regr_slope(ret, mkt), 5) AS slope, round(regr_intercept(ret, mkt), 9) AS intercept, round(regr_r2(ret, mkt), 5) AS r2, round(avg(ret) / nullif(covar_samp(ret, mkt) / var_samp(mkt), 0), 8) AS treynor, round(stddev_samp(ret - mkt), 9) AS tracking FROM j GROUP BY series HAVING count(*) > 2""")
def m_market_model(spark: SparkSession, d: str) -> DataFrame:
    """Each series against the mean of its symbol over all sources."""
    r = returns(spark, d).withColumn("symbol", F.split("series", r"\|")[1])
    m = r.groupBy("symbol", "ts").agg(F.avg("ret").alias("mkt"))
    g = r.join(m, ["symbol", "ts"]).groupBy("series")
    o, b = stats.ols("ret", "mkt"), stats.beta("ret", "mkt")
    return g.agg(F.count("*").alias("n"), F.round(b, 5).alias("beta"), F.round(stats.correlation("ret", "mkt"), 6).alias("corr"), F.round(o["slope"], 5).alias("slope"), F.round(o["intercept"], 9).alias("intercept"), F.round(o["r2"], 5).alias("r2"), F.round(F.avg("ret") / F.when(b != 0, b), 8).alias("treynor"), F.round(stats.tracking_error("ret", "mkt"), 9).alias("tracking")).where("n > 2").drop("n")


@query(f"""{_R}, k AS (SELECT series, close, volume, (rank() OVER (PARTITION BY series ORDER BY close) + (count(*) OVER (PARTITION BY series, close) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY series ORDER BY volume) + (count(*) OVER (PARTITION BY series, volume) - 1) / 2.0) AS b FROM v)
 SELECT series, count(*) AS n, round(corr(a, b), 7) AS rho FROM k GROUP BY series""")
def m_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(returns(spark, d), ["series"], "close", "volume").withColumn("rho", F.round("rho", 7))


@query(f"""{_R}, l AS (SELECT v.series, rn, ret, ret - avg(ret) OVER (PARTITION BY series) AS e, lag(ret) OVER (PARTITION BY series ORDER BY rn) AS p FROM v), q AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY rn) AS e1, lag(e, 5) OVER (PARTITION BY series ORDER BY rn) AS e5 FROM l)
 SELECT series, round(sum(e * e1) / sum(e * e), 7) AS acf1, round(sum(e * e5) / sum(e * e), 7) AS acf5, round(sum(power(ret - p, 2)) / sum(ret * ret), 7) AS durbin_watson, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t, round(avg(ret) / (stddev_pop(ret) / sqrt(count(*))), 6) AS t_pop FROM q GROUP BY series""")
def m_serial(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation at lags 1 and 5, Durbin-Watson, t statistics."""
    from tapewright.operators.blocks import Frames, with_halo

    r = returns(spark, d)
    r = r.join(r.groupBy("series").agg(F.avg("ret").alias("mean")), "series").withColumn("e", F.col("ret") - F.col("mean"))
    r = with_halo(r, before=5)
    f = Frames()
    r = own(r.withColumns({"p": f.lag("ret"), "e1": f.lag("e"), "e5": f.lag("e", 5)}))
    ss = F.sum(F.col("e") * F.col("e"))
    return r.groupBy("series").agg(F.round(F.sum(F.col("e") * F.col("e1")) / ss, 7).alias("acf1"), F.round(F.sum(F.col("e") * F.col("e5")) / ss, 7).alias("acf5"), F.round(F.sum(F.pow(F.col("ret") - F.col("p"), F.lit(2.0))) / F.sum(F.col("ret") * F.col("ret")), 7).alias("durbin_watson"), F.round(stats.t_statistic("ret"), 6).alias("t"), F.round(stats.t_statistic("ret", variant="population"), 6).alias("t_pop"))


@query(f"""{_R}, n AS (SELECT *, lead(ret) OVER (PARTITION BY series ORDER BY rn) AS nxt FROM v), g AS (SELECT series, sign(ret)::INT AS state, count(*) AS trials, count(*) FILTER (nxt > 0) AS wins FROM n WHERE nxt IS NOT NULL GROUP BY ALL)
 SELECT series, state, trials, CAST(wins AS BIGINT) AS wins, round(wins / trials, 8) AS rate, round(greatest(0, (wins / trials + 3.841458820694124 / (2 * trials)) / (1 + 3.841458820694124 / trials) - 1.959963984540054 * sqrt((wins / trials) * (1 - wins / trials) / trials + 3.841458820694124 / (4.0 * trials * trials)) / (1 + 3.841458820694124 / trials)), 8) AS low FROM g""")
def m_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Wins of the next row by the sign of the present one, with Wilson's lower bound."""
    x = _next(spark, d)
    g = x.groupBy("series", "state").agg(F.count("*").alias("trials"), F.count(F.when(F.col("nxt") > 0, 1)).alias("wins"))
    return g.select("series", "state", "trials", "wins", F.round(F.col("wins") / F.col("trials"), 8).alias("rate"), F.round(stats.wilson(F.col("wins"), F.col("trials"))[0], 8).alias("low"))


def _next(spark: SparkSession, d: str) -> DataFrame:
    from tapewright.operators.blocks import Frames, with_halo

    f = Frames()
    return own(with_halo(returns(spark, d), after=1).withColumn("nxt", f.lead("ret"))).withColumn("state", F.signum("ret").cast("int")).where("nxt is not null")


@query()
def m_state_edges(spark: SparkSession, d: str) -> DataFrame:
    """Exact binomial tests per state with false-discovery control."""
    x = _next(spark, d).withColumn("up", F.col("nxt") > 0)
    return _round(stats.state_edges(x, ["series", "state"], "up"))


@query(f"""{_R}, n AS (SELECT series, sign(ret)::INT AS state, sign(lead(ret) OVER (PARTITION BY series ORDER BY rn))::INT AS after FROM v), c AS (SELECT series, state, after, count(*) AS n FROM n WHERE after IS NOT NULL GROUP BY ALL)
 SELECT series, state, after, n, round(n / sum(n) OVER (PARTITION BY series, state), 8) AS p FROM c""")
def m_transitions(spark: SparkSession, d: str) -> DataFrame:
    x = _next(spark, d).withColumn("after", F.signum("nxt").cast("int"))
    return stats.transitions(x, ["series"], "state", "after").withColumn("p", F.round("p", 8))


@query(f"""{_R}, n AS (SELECT series, sign(ret)::INT AS a, sign(lead(ret) OVER (PARTITION BY series ORDER BY rn))::INT AS b FROM v), c AS (SELECT series, a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY series, a) AS na, sum(n) OVER (PARTITION BY series, b) AS nb, sum(n) OVER (PARTITION BY series) AS t FROM c), e AS (SELECT series, a, sum(n) AS na, any_value(t) AS t FROM m GROUP BY series, a)
 SELECT m.series, round(any_value(h), 7) AS entropy, round(sum(n / t * log2(n * t / (na * nb))), 7) AS information FROM m JOIN (SELECT series, -sum(na / t * log2(na / t)) AS h FROM e GROUP BY series) USING (series) GROUP BY m.series""")
def m_information(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the sign and its mutual information with the next one."""
    x = _next(spark, d).withColumn("after", F.signum("nxt").cast("int"))
    return stats.entropy(x, ["series"], "state").join(stats.mutual_information(x, ["series"], "state", "after"), "series").select("series", F.round("entropy", 7).alias("entropy"), F.round("information", 7).alias("information"))


@query(f"""{_R}, m AS (SELECT series, min(ret) AS a, max(ret) AS b FROM v GROUP BY 1) SELECT series, CAST(CASE WHEN a = b THEN 0 ELSE least(floor((ret - a) / ((b - a) / 10)), 9) END AS INTEGER) AS bin, count(*) AS n FROM v JOIN m USING (series) GROUP BY ALL""")
def m_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(returns(spark, d), ["series"], "ret").select("series", "bin", "n")


@query(f"""{_R} SELECT series, CAST((rn - 2) % 12 AS INTEGER) AS month, round(avg(ret), 10) AS mean, round(avg((ret > 0)::INT), 8) AS hit, count(*) AS n FROM v GROUP BY ALL""")
def m_seasonality(spark: SparkSession, d: str) -> DataFrame:
    """Means and hit rates by the position modulo 12."""
    r = returns(spark, d)
    return r.groupBy("series", ((F.col("rn") - 2) % 12).cast("int").alias("month")).agg(F.round(F.avg("ret"), 10).alias("mean"), F.round(stats.win_rate("ret"), 8).alias("hit"), F.count("*").alias("n"))


@query(f"""WITH {BARS}, h AS (SELECT series, (rn - 1) // 12 AS k, * EXCLUDE (series) FROM x) SELECT series, k, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, round(sum(volume), 2) AS volume, count(*) AS n,
  round(CASE WHEN sum(volume) = 0 THEN 0 ELSE sum((high + low + close) / 3 * volume) / sum(volume) END + 0.0000023, 5) AS vwap FROM h GROUP BY series, k""")
def m_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Bars of twelve rows each (by count, not by calendar); the last one may be partial."""
    df, _ = framed_bars(spark, d)
    g = own(df).groupBy("series", F.floor((F.col("rn") - 1) / 12).alias("k"))
    v = F.sum("volume")
    vw = F.when(v == 0, 0.0).otherwise(F.sum(rolling.typical() * F.col("volume")) / F.when(v != 0, v))
    return g.agg(F.min_by("open", "rn").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "rn").alias("close"), F.round(v, 2).alias("volume"), F.count("*").alias("n"), F.round(vw + 0.0000023, 5).alias("vwap"))


@query(f"""WITH {BARS} SELECT series, epoch_us(time_bucket(INTERVAL 4 HOURS, ts AT TIME ZONE 'UTC', TIMESTAMP '1970-01-01')) AS start_us, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, round(sum(volume), 2) AS volume FROM x GROUP BY ALL""")
def m_resample(spark: SparkSession, d: str) -> DataFrame:
    """Calendar bars of four hours."""
    g = clean_bars(spark, d).groupBy("series", F.window("ts", "4 hours").alias("w"))
    return g.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.round(F.sum("volume"), 2).alias("volume")).select("series", F.unix_micros("w.start").alias("start_us"), "open", "high", "low", "close", "volume")


@query(f"""{_R}, z AS (SELECT series, rn, CASE WHEN stddev_samp(ret) OVER w > 0.0008 THEN 'high' ELSE 'low' END AS regime, ret, volume FROM v WINDOW w AS (PARTITION BY series ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT series, regime, count(*) AS n, round(corr(ret, volume), 6) AS corr, round(least(1, count(*) / 20.0) * abs(corr(ret, volume)), 6) AS confidence FROM z WHERE rn > 20 GROUP BY series, regime HAVING count(*) >= 4""")
def m_regime_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of return and volume within volatility regimes, and its confidence."""
    df, f = framed_bars(spark, d, before=21)
    df = df.withColumn("ret", rolling.pct_return(f, "close"))
    df = own(df.withColumn("regime", F.when(F.stddev_samp("ret").over(f.last(20)) > 0.0008, "high").otherwise("low"))).where("ret is not null and rn > 20")
    g = df.groupBy("series", "regime").agg(F.count("*").alias("n"), stats.correlation("ret", "volume").alias("c")).where("n >= 4")
    return g.select("series", "regime", "n", F.round("c", 6).alias("corr"), F.round(F.least(F.lit(1.0), F.col("n") / 20) * F.abs("c"), 6).alias("confidence"))


@query(f"""{_R}, p AS (SELECT series, 1 / (1 + exp(-800 * ret)) AS p, (lead(ret) OVER (PARTITION BY series ORDER BY rn) > 0)::INT AS y FROM v), q AS (SELECT * FROM p WHERE y IS NOT NULL)
 SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(y), 8) AS actual, round(avg(power(p - y, 2)), 8) AS brier FROM q GROUP BY 1""")
def m_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Reliability bins and Brier score of a logistic score of the return."""
    x = _next(spark, d).withColumns({"p": 1 / (1 + F.exp(-800 * F.col("ret"))), "y": (F.col("nxt") > 0).cast("int")})
    x = x.withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    c = stats.calibration(x, [], "p", "y")
    b = x.groupBy("bin").agg(F.round(stats.brier("p", "y"), 8).alias("brier"))
    return c.join(b, "bin").select("bin", "n", F.round("predicted", 8).alias("predicted"), F.round("actual", 8).alias("actual"), "brier")
