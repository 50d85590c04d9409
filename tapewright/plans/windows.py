"""Queries of the rolling, analytic and label operators over all clean bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import blocks, rolling
from tapewright.plans.base import BARS, W, framed_bars, own

QUERIES, SQL = {}, {}
#: Added before rounding in both engines where exact ties are common, so that the last bit of a sum can't decide.
OFF = 0.0000023


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql(rest: str, pre: str = "") -> str:
    return f"WITH {BARS}{pre} SELECT bar_id, {rest}"


@query(_sql(f"""round(close - lag(close) OVER w, 6) AS absolute, round(close / lag(close) OVER w - 1, 8) AS percentage, round(ln(close / lag(close) OVER w), 8) AS log,
  round(close - lag(close, 12) OVER w, 6) AS momentum, round(close / lag(close, 12) OVER w - 1, 8) AS roc, round(100 * (close / lag(close, 12) OVER w - 1), 6) AS roc_percent FROM x WINDOW w AS ({W})"""))
def w_returns(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=12)
    c = {"absolute": rolling.change(f, "close", "absolute"), "percentage": rolling.change(f, "close"), "log": rolling.change(f, "close", "log"), "momentum": rolling.momentum(f, "close", 12), "roc": rolling.rate_of_change(f, "close", 12), "roc_percent": rolling.rate_of_change(f, "close", 12, percent=True)}
    return own(df.withColumns(c)).select("bar_id", *[F.round(x, 8 if x in ("percentage", "log", "roc") else 6).alias(x) for x in c])


def _full(n: int, e: str, d: int = 6) -> str:
    return f"CASE WHEN rn >= {n} THEN round({e}, {d}) END"


def _w(n: int, name: str) -> str:
    return f"{name} AS ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(_sql(f"""{_full(20, 'avg(close) OVER a', 7)} AS sma20, {_full(20, 'stddev_samp(close) OVER a', 5)} AS std_samp20, {_full(20, 'stddev_pop(close) OVER a', 5)} AS std_pop20,
  {_full(20, 'var_samp(close) OVER a', 2)} AS var20, {_full(20, 'max(close) OVER a')} AS max20, {_full(20, 'min(close) OVER a')} AS min20, {_full(20, '(close - avg(close) OVER a) / avg(close) OVER a', 8)} AS distance20,
  {_full(20, '(close - max(close) OVER a) / max(close) OVER a', 8)} AS drawdown20, {_full(20, 'quantile_cont(close, 0.3) OVER a')} AS p30,
  CASE WHEN rn >= 50 THEN sign(round(avg(close) OVER a - avg(close) OVER c, 7))::INTEGER END AS trend FROM x WINDOW {_w(20, 'a')}, {_w(50, 'c')}"""))
def w_moving(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=50)
    c = {"sma20": rolling.sma(f, "close", 20), "std_samp20": rolling.spread_of(f, "close", 20), "std_pop20": rolling.spread_of(f, "close", 20, "stddev_pop"), "var20": rolling.spread_of(f, "close", 20, "var_samp"), "max20": f.full(20, F.max("close").over(f.last(20))), "min20": f.full(20, F.min("close").over(f.last(20))), "distance20": rolling.ma_distance(f, "close", 20), "drawdown20": rolling.drawdown(f, "close", 20), "p30": rolling.percentile_of(f, "close", 20, 0.3)}
    t = rolling.sign_of_difference(F.round(rolling.sma(f, "close", 20) - rolling.sma(f, "close", 50), 7), F.lit(0.0))
    digits = {"sma20": 7, "std_samp20": 5, "std_pop20": 5, "var20": 2, "distance20": 8, "drawdown20": 8}
    return own(df.withColumns(c | {"trend": t})).select("bar_id", *[F.round(x, digits.get(x, 6)).alias(x) for x in c], "trend")


_RET = f", r AS (SELECT *, close - lag(close) OVER w AS diff, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS lr FROM x WINDOW w AS ({W}))"


def _with_returns(spark: SparkSession, d: str, before: int, after: int = 0):  # noqa: ANN202
    df, f = framed_bars(spark, d, before=before + 1, after=after)
    return df.withColumns({"diff": rolling.momentum(f, "close", 1), "ret": rolling.pct_return(f, "close"), "lr": rolling.log_return(f, "close")}), f


@query(_sql(f"""CASE WHEN rn > 20 THEN round(stddev_pop(ret) OVER a, 8) END AS vol20, CASE WHEN rn > 20 THEN round(stddev_pop(lr) OVER a, 8) END AS hist_vol20, CASE WHEN rn > 20 THEN round(stddev_samp(ret) OVER a * sqrt(252), 7) END AS realized,
  CASE WHEN rn > 14 THEN CASE WHEN avg(CASE WHEN diff < 0 THEN -diff ELSE 0 END) OVER g = 0 THEN 100 ELSE round(100 - 100 / (1 + avg(CASE WHEN diff > 0 THEN diff ELSE 0 END) OVER g / avg(CASE WHEN diff < 0 THEN -diff ELSE 0 END) OVER g), 5) END END AS rsi14,
  CASE WHEN rn > 20 THEN round(corr(ret, close) OVER a, 5) END AS corr20, CASE WHEN rn > 20 THEN round(covar_samp(ret, close) OVER a, 6) END AS cov20
  FROM r WINDOW {_w(20, 'a')}, {_w(14, 'g')}""", _RET))
def w_return_risk(spark: SparkSession, d: str) -> DataFrame:
    df, f = _with_returns(spark, d, 20)
    late = lambda n, x: F.when(f.rn > n, x)
    c = {"vol20": late(20, rolling.spread_of(f, "ret", 20, "stddev_pop")), "hist_vol20": late(20, rolling.spread_of(f, "lr", 20, "stddev_pop")), "realized": late(20, rolling.spread_of(f, "ret", 20) * F.sqrt(F.lit(252.0))), "rsi14": rolling.rsi_simple(f, "diff", 14), "corr20": late(20, rolling.correlation(f, "ret", "close", 20)), "cov20": late(20, rolling.covariance(f, "ret", "close", 20))}
    digits = {"rsi14": 5, "realized": 7, "corr20": 5, "cov20": 6}
    return own(df.withColumns(c)).select("bar_id", *[F.round(x, digits.get(x, 8)).alias(x) for x in c])


_TR = f""", t AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
  CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS clv FROM x WINDOW w AS ({W})), t2 AS (SELECT *,
  CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0 END AS mup, CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0 END AS mdn FROM t WINDOW w AS ({W}))"""


def _with_ranges(spark: SparkSession, d: str, before: int, after: int = 0):  # noqa: ANN202
    df, f = framed_bars(spark, d, before=before + 2, after=after)
    df = df.withColumns({"tp": rolling.typical(), "tr": rolling.true_range(f), "clv": rolling.close_location()})
    flow = F.col("tp") * F.col("volume")
    return df.withColumns({"mup": F.when(F.col("tp") > f.lag("tp"), flow).otherwise(0.0), "mdn": F.when(F.col("tp") < f.lag("tp"), flow).otherwise(0.0)}), f


@query(_sql(f"""CASE WHEN rn > 14 THEN round(avg(tr) OVER a, 6) END AS atr14, CASE WHEN rn >= 20 THEN round(avg(close) OVER b + 2 * stddev_pop(close) OVER b, 4) END AS bb_up, CASE WHEN rn >= 20 THEN round(avg(close) OVER b - 2 * stddev_pop(close) OVER b, 4) END AS bb_low,
  CASE WHEN rn >= 20 AND stddev_pop(close) OVER b > 0 THEN round((close - (avg(close) OVER b - 2 * stddev_pop(close) OVER b)) / (4 * stddev_pop(close) OVER b), 5) END AS bb_pct,
  CASE WHEN rn >= 14 THEN CASE WHEN max(high) OVER a = min(low) OVER a THEN 50.0 ELSE round(100 * (close - min(low) OVER a) / (max(high) OVER a - min(low) OVER a), 6) END END AS stoch_k,
  CASE WHEN rn >= 20 THEN CASE WHEN list_sum(list_transform(list(tp) OVER b, lambda v: abs(v - avg(tp) OVER b))) / 20 <= 1e-12 * abs(avg(tp) OVER b) THEN 0.0 ELSE round((tp - avg(tp) OVER b) / (0.015 * list_sum(list_transform(list(tp) OVER b, lambda v: abs(v - avg(tp) OVER b))) / 20), 4) END END AS cci20,
  CASE WHEN rn > 14 THEN CASE WHEN sum(mdn) OVER a = 0 THEN 100.0 ELSE round(100 - 100 / (1 + sum(mup) OVER a / sum(mdn) OVER a), 5) END END AS mfi14,
  CASE WHEN rn >= 20 THEN round(max(high) OVER b, 6) END AS dc_up, CASE WHEN rn >= 20 THEN round(min(low) OVER b, 6) END AS dc_low, CASE WHEN rn >= 20 THEN CASE WHEN sum(volume) OVER b = 0 THEN 0.0 ELSE round(sum(clv) OVER b / sum(volume) OVER b, 6) END END AS cmf20,
  CASE WHEN rn >= 20 THEN CASE WHEN sum(volume) OVER b = 0 THEN 0.0 ELSE round(sum(close * volume) OVER b / sum(volume) OVER b + 0.0000023, 5) END END AS vwma20 FROM t2 WINDOW {_w(14, 'a')}, {_w(20, 'b')}""", _TR))
def w_bar_indicators(spark: SparkSession, d: str) -> DataFrame:
    df, f = _with_ranges(spark, d, 20)
    bb, dc = rolling.bollinger(f, "close", 20), rolling.donchian(f, 20)
    c = {"atr14": rolling.atr_simple(f, "tr", 14), "bb_up": bb["bb_up"], "bb_low": bb["bb_low"], "bb_pct": bb["bb_pct"], "stoch_k": rolling.stochastic_k(f, 14, 50.0), "cci20": rolling.cci(f, "tp", 20), "mfi14": rolling.money_flow(f, "mup", "mdn", 14), "dc_up": dc["dc_up"], "dc_low": dc["dc_low"], "cmf20": rolling.cmf(f, "clv", 20), "vwma20": rolling.vwma(f, "close", "volume", 20)}
    c["vwma20"] = F.when(F.sum("volume").over(f.last(20)) == 0, c["vwma20"]).otherwise(c["vwma20"] + OFF)
    digits = {"bb_up": 4, "bb_low": 4, "bb_pct": 5, "cci20": 4, "mfi14": 5, "vwma20": 5}
    return own(df.withColumns(c)).select("bar_id", *[F.round(x, digits.get(x, 6)).alias(x) for x in c])


_WMA = "list_sum(list_transform(generate_series(1, {n}), lambda k: k * (list({c}) OVER {w})[k])) / {s}"


@query(_sql(f"""CASE WHEN rn >= 16 THEN round({_WMA.format(n=16, c='close', w='a', s=136)} + 0.00000023, 6) END AS wma16, CASE WHEN rn >= 9 THEN round((max(high) OVER c9 + min(low) OVER c9) / 2, 6) END AS ich_conv, CASE WHEN rn >= 26 THEN round((max(high) OVER c26 + min(low) OVER c26) / 2, 6) END AS ich_base,
  lead(close, 26) OVER w AS ich_chikou, CASE WHEN rn > 20 AND len(list(lr) OVER c20) = 20 THEN round(len(list_filter(list(lr) OVER c20, lambda v: v <= lr)) / 20.0, 6) END AS lr_rank
  FROM r WINDOW w AS ({W}), {_w(16, 'a')}, {_w(9, 'c9')}, {_w(26, 'c26')}, {_w(20, 'c20')}""", _RET))
def w_weighted(spark: SparkSession, d: str) -> DataFrame:
    df, f = _with_returns(spark, d, 52, after=26)
    ich = rolling.ichimoku(f)
    c = {"wma16": rolling.wma(f, "close", 16) + OFF / 10, "ich_conv": ich["ich_conv"], "ich_base": ich["ich_base"], "ich_chikou": ich["ich_chikou"], "lr_rank": F.when(f.rn > 20, rolling.share_at_most(f, "lr", 20))}
    return own(df.withColumns(c)).select("bar_id", *[F.round(x, 6).alias(x) if x != "ich_chikou" else F.col(x) for x in c])


@query(f"""WITH {BARS}, h1 AS (SELECT *, CASE WHEN rn >= 16 THEN 2 * {_WMA.format(n=8, c='close', w='a', s=36)} - {_WMA.format(n=16, c='close', w='b', s=136)} END AS raw FROM x WINDOW {_w(8, 'a')}, {_w(16, 'b')})
SELECT bar_id, CASE WHEN rn >= 19 THEN round({_WMA.format(n=4, c='raw', w='c', s=10)} + 0.0000023, 5) END AS hma16 FROM h1 WINDOW {_w(4, 'c')}""")
def w_hull(spark: SparkSession, d: str) -> DataFrame:
    """Hull average: WMA over sqrt(n) of 2 * WMA(n / 2) - WMA(n)."""
    df, f = framed_bars(spark, d, before=20)
    df = df.withColumn("raw", 2 * rolling.wma(f, "close", 8) - rolling.wma(f, "close", 16))
    return own(df.withColumn("hma16", F.when(f.rn >= 19, rolling.wma(f, "raw", 4)))).select("bar_id", F.round(F.col("hma16") + OFF, 5).alias("hma16"))


@query(_sql(f"""round(CASE WHEN sum(volume) OVER u = 0 THEN close ELSE sum(tp * volume) OVER u / sum(volume) OVER u END, 5) AS vwap,
  round(volume_1 + coalesce(sum(signed) OVER u, 0), 2) AS obv, round(sum(clv) OVER u, 2) AS ad, round(avg(close) OVER u + 0.0000023, 4) AS expanding_mean
  FROM (SELECT *, first_value(volume) OVER w AS volume_1, CASE WHEN close > lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume ELSE 0 END AS signed FROM t2 WINDOW w AS ({W})) WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)""", _TR))
def w_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative VWAP, on-balance volume (from the first volume), accumulation/distribution, expanding mean; by block totals."""
    df, f = _with_ranges(spark, d, 1)
    signed = F.when(f.rn == 1, F.col("volume")).when(F.col("close") > f.lag("close"), F.col("volume")).when(F.col("close") < f.lag("close"), -F.col("volume")).otherwise(0.0)
    df = own(df.withColumns({"pv": F.col("tp") * F.col("volume"), "signed": signed})).drop("block", "halo")
    t = blocks.running_totals(df, ["series"], ["pv", "volume", "signed", "clv", "close"])
    vwap = F.when(F.col("volume_total") == 0, F.col("close")).otherwise(F.col("pv_total") / F.when(F.col("volume_total") != 0, F.col("volume_total")))
    return t.select("bar_id", F.round(vwap, 5).alias("vwap"), F.round("signed_total", 2).alias("obv"), F.round("clv_total", 2).alias("ad"), F.round(F.col("close_total") / F.col("rn") + OFF, 4).alias("expanding_mean"))


@query(_sql(f"""round(lead(close, 5) OVER w / close - 1, 8) AS fwd5, CASE WHEN lead(close, 5) OVER w IS NOT NULL THEN CASE WHEN lead(close, 5) OVER w > close THEN 1 ELSE 0 END END AS up5,
  CASE WHEN (lead(close, 5) OVER w - close) / close > 0.001 THEN 1 WHEN (lead(close, 5) OVER w - close) / close < -0.001 THEN -1 WHEN lead(close, 5) OVER w IS NOT NULL THEN 0 END AS way5,
  CASE WHEN len(list(close) OVER n) = 10 THEN coalesce((list_filter(list_transform(list(close) OVER n, lambda v: CASE WHEN v >= close * 1.002 THEN 1 WHEN v <= close * 0.998 THEN -1 END), lambda v: v IS NOT NULL))[1], 0) END AS touch10
  FROM x WINDOW w AS ({W}), n AS ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"""))
def w_labels(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, after=10)
    r = rolling.future_return(f, "close", 5)
    c = {"fwd5": r, "up5": rolling.binary_label(r), "way5": rolling.three_way_label(r, 0.001), "touch10": rolling.first_touch(f, 0.002, 0.002, 10)}
    return own(df.withColumns(c)).select("bar_id", F.round("fwd5", 8).alias("fwd5"), "up5", "way5", "touch10")


@query()
def w_barriers(spark: SparkSession, d: str) -> DataFrame:
    """ATR barriers from the next open, long and short, with reasons."""
    df, f = _with_ranges(spark, d, 14, after=16)
    df = df.withColumn("atr", rolling.atr_simple(f, "tr", 14)).withColumn("dir", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    o = own(df.withColumn("o", rolling.barrier_outcome(f, "atr", "dir", 1.5, 1.0, 16)))
    return o.select("bar_id", "dir", "o.label", "o.reason", "o.bars", F.round("o.exit", 6).alias("exit"))


@query()
def w_barrier_variants(spark: SparkSession, d: str) -> DataFrame:
    """The same barriers from this close, a double touch counting as a stop."""
    df, f = _with_ranges(spark, d, 14, after=16)
    df = df.withColumn("atr", rolling.atr_simple(f, "tr", 14, with_first=True)).withColumn("dir", F.lit(1))
    o = own(df.withColumn("o", rolling.barrier_outcome(f, "atr", "dir", 1.0, 1.0, 16, entry_at="close", both="stop")))
    return o.select("bar_id", "o.label", "o.reason", "o.bars", F.round("o.exit", 6).alias("exit"))


@query(f"""WITH {BARS}, m AS (SELECT *, avg(close) OVER a AS fast, avg(close) OVER c AS slow FROM x WINDOW {_w(20, 'a')}, {_w(100, 'c')}),
  k AS (SELECT series, bar_id, ts, rn, round(fast - slow, 9) AS gap, lag(round(fast - slow, 9)) OVER (PARTITION BY series ORDER BY rn) AS was FROM m)
SELECT series, bar_id, CASE WHEN gap > 0 THEN 'bullish' ELSE 'bearish' END AS direction FROM k WHERE rn > 100 AND ((was <= 0 AND gap > 0) OR (was >= 0 AND gap < 0))""")
def w_crossovers(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of the 20 and 100 row averages."""
    df, f = framed_bars(spark, d, before=102)
    df = df.withColumn("gap", F.round(rolling.sma(f, "close", 20) - rolling.sma(f, "close", 100), 9))
    df = own(df.withColumn("was", f.lag("gap")))
    up, down = (F.col("was") <= 0) & (F.col("gap") > 0), (F.col("was") >= 0) & (F.col("gap") < 0)
    return df.where((F.col("rn") > 100) & (up | down)).select("series", "bar_id", F.when(up, "bullish").otherwise("bearish").alias("direction"))


@query(f"""WITH {BARS}{_RET}, s AS (SELECT series, rn, CASE WHEN ret > 0 THEN 1 WHEN ret < 0 THEN -1 ELSE 0 END AS sgn FROM r WHERE ret IS NOT NULL),
  i AS (SELECT *, rn - row_number() OVER (PARTITION BY series, sgn ORDER BY rn) AS isl FROM s), g AS (SELECT series, sgn, isl, count(*) AS n, max(rn) AS e FROM i GROUP BY ALL),
  z AS (SELECT series, max(rn) AS last FROM s GROUP BY series)
SELECT g.series, coalesce(max(n) FILTER (sgn = 1), 0) AS longest_up, coalesce(max(n) FILTER (sgn = -1), 0) AS longest_down, count(*) FILTER (e < last) AS closed_runs FROM g JOIN z USING (series) GROUP BY g.series""")
def w_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Longest runs of rising and falling rows, and the number of finished runs, per series."""
    from tapewright.operators.islands import runs

    df, f = _with_returns(spark, d, 1)
    s = own(df).where("ret is not null").select("series", "rn", F.signum("ret").cast("int").alias("sgn"))
    r = runs(s, ["series"], "rn", "sgn")
    last = s.groupBy("series").agg(F.max("rn").alias("last"))
    return r.join(last, "series").groupBy("series").agg(F.coalesce(F.max(F.when(F.col("sgn") == 1, F.col("n"))), F.lit(0)).alias("longest_up"), F.coalesce(F.max(F.when(F.col("sgn") == -1, F.col("n"))), F.lit(0)).alias("longest_down"), F.count(F.when(F.col("end") < F.col("last"), 1)).alias("closed_runs"))


@query(f"""WITH {BARS}{_RET}, p AS (SELECT series, rn, string_agg(CASE WHEN ret > 0 THEN 'U' ELSE 'D' END, '') OVER (PARTITION BY series ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pattern FROM r WHERE ret IS NOT NULL)
SELECT series, pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series), 8) AS share FROM p WHERE length(pattern) = 5 GROUP BY series, pattern""")
def w_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Relative frequencies of the up/down patterns of five rows."""
    df, f = _with_returns(spark, d, 6)
    ud = F.when(F.col("ret") > 0, "U").when(F.col("ret").isNotNull(), "D")
    df = own(df.withColumn("ud", ud).withColumn("pattern", F.concat_ws("", F.collect_list("ud").over(f.last(5))))).where((F.length("pattern") == 5) & (F.col("rn") > 5))
    n = df.groupBy("series", "pattern").agg(F.count("*").alias("n"))
    total = n.groupBy("series").agg(F.sum("n").alias("total"))
    return n.join(total, "series").select("series", "pattern", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query(_sql(f"""CASE WHEN rn > 60 THEN CASE WHEN ret >= quantile_cont(ret, 0.7) OVER q THEN 'BUY' WHEN ret <= quantile_cont(ret, 0.3) OVER q THEN 'SELL' ELSE 'HOLD' END END AS signal,
  CASE WHEN rn > 60 THEN round((close - avg(close) OVER q) / stddev_samp(close) OVER q, 5) END AS z60, CASE WHEN rn >= 20 THEN CASE WHEN avg(volume) OVER v > 0 THEN round(volume / avg(volume) OVER v, 6) END END AS volume_ratio
  FROM r WINDOW {_w(60, 'q')}, {_w(20, 'v')}""", _RET))
def w_signals(spark: SparkSession, d: str) -> DataFrame:
    """Rolling-quantile thresholds on returns, z over 60 rows, volume against its mean."""
    df, f = _with_returns(spark, d, 61)
    hi, lo = rolling.percentile_of(f, "ret", 60, 0.7), rolling.percentile_of(f, "ret", 60, 0.3)
    s = F.when(f.rn > 60, F.when(F.col("ret") >= hi, "BUY").when(F.col("ret") <= lo, "SELL").otherwise("HOLD"))
    c = {"signal": s, "z60": F.when(f.rn > 60, rolling.zscore(f, "close", 60)), "volume_ratio": rolling._safe(F.col("volume"), rolling.sma(f, "volume", 20))}
    return own(df.withColumns(c)).select("bar_id", "signal", F.round("z60", 5).alias("z60"), F.round("volume_ratio", 6).alias("volume_ratio"))
