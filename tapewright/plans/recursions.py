"""Queries of the ordered recursions over all clean bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.scalars import timeframe_seconds
from tapewright.operators import folds, rolling
from tapewright.plans.base import BARS, W, framed_bars, own

QUERIES, SQL = {}, {}
D, I, S = T.DoubleType(), T.IntegerType(), T.StringType()


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _forgetting(spark: SparkSession, d: str, period: int) -> DataFrame:
    """Bars in blocks with a halo that a recursion of that period forgets."""
    return framed_bars(spark, d, before=folds.WARM * period + 2, block_rows=50_000)[0]


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return framed_bars(spark, d)[0]


def _fold(df: DataFrame, make, inputs, outputs, keys=("series", "block"), digits: int = 6, off: float = 0.0) -> DataFrame:  # noqa: ANN001
    o = folds.ordered_fold(df, keys, ["rn"], inputs, ["bar_id", "halo"], make, outputs)
    return own(o).select("bar_id", *[F.round(F.col(n) + off, digits).alias(n) if isinstance(t, T.DoubleType) else F.col(n) for n, t in outputs])


_ALL = f"({W} ROWS UNBOUNDED PRECEDING)"
_EMA = "list_reduce(list({c}) OVER u, lambda a, v: a + {k} * (v - a))"
_WIL = "list_reduce(list_prepend(list_avg((list({c}) OVER u)[{s}:{e}]), (list({c}) OVER u)[{e1}:]), lambda a, v: (a * {m} + v) / {n})"


def _wil(c: str, n: int, start: int) -> str:
    """Wilder average of column c whose first value is at row `start`."""
    e = start + n - 1
    return f"CASE WHEN rn >= {e} THEN {_WIL.format(c=c, s=start, e=e, e1=e + 1, m=n - 1, n=n)} END"


_STEP = f""", d AS (SELECT *, close - lag(close) OVER w AS diff, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
  high - lag(high) OVER w AS um, lag(low) OVER w - low AS dm, (high + low + close) / 3 AS tp FROM x WINDOW w AS ({W})),
 g AS (SELECT *, greatest(diff, 0) AS gain, greatest(-diff, 0) AS loss, CASE WHEN um > dm AND um > 0 THEN um ELSE 0.0 END AS pdm, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0.0 END AS mdm,
  CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0.0 END AS fup, CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0.0 END AS fdn FROM d WINDOW w AS ({W}))"""


@query(f"""WITH {BARS}, m AS (SELECT *, {_EMA.format(c='close', k='(2.0::DOUBLE/13)')} - {_EMA.format(c='close', k='(2.0::DOUBLE/27)')} AS line, {_EMA.format(c='close', k='(2.0::DOUBLE/21)')} AS e20 FROM x WINDOW u AS {_ALL})
SELECT bar_id, round(e20, 6) AS ema20, round(line, 6) AS line, round({_EMA.format(c='line', k='(2.0::DOUBLE/10)')}, 6) AS signal, round(line - {_EMA.format(c='line', k='(2.0::DOUBLE/10)')}, 6) AS histogram FROM m WINDOW u AS {_ALL}""")
def f_ema_macd(spark: SparkSession, d: str) -> DataFrame:
    def make():  # noqa: ANN202
        e, m = folds.ema(20), folds.macd()
        return lambda c: (e(c), *m(c))

    return _fold(_forgetting(spark, d, 26), make, ["close"], [("ema20", D), ("line", D), ("signal", D), ("histogram", D)])


@query()
def f_macd_mean_seed(spark: SparkSession, d: str) -> DataFrame:
    """MACD whose averages start at means: another definition of the same name."""
    return _fold(_forgetting(spark, d, 26), lambda: folds.macd(seed="mean"), ["close"], [("line", D), ("signal", D), ("histogram", D)])


@query(f"""WITH {BARS}{_STEP}, z AS (SELECT bar_id, rn, {_wil('gain', 14, 2)} AS g, {_wil('loss', 14, 2)} AS l, {_wil('tr', 14, 1)} AS a, {_wil('tr', 10, 1)} AS a10, {_EMA.format(c='close', k='(2.0::DOUBLE/21)')} AS e20, {_wil('fup', 14, 2)} AS fu, {_wil('fdn', 14, 2)} AS fd FROM g WINDOW u AS {_ALL})
SELECT bar_id, CASE WHEN g IS NOT NULL THEN CASE WHEN l = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g / l), 5) END END AS rsi14, round(a, 6) AS atr14, round(e20 + 2 * a10, 5) AS kc_up, round(e20 - 2 * a10, 5) AS kc_low,
  CASE WHEN fu IS NOT NULL THEN CASE WHEN fd = 0 THEN 100.0 ELSE round(100 - 100 / (1 + fu / fd), 5) END END AS mfi14 FROM z""")
def f_wilder(spark: SparkSession, d: str) -> DataFrame:
    """Relative strength, average true range, Keltner bands and money flow with Wilder averages."""
    def make():  # noqa: ANN202
        r, a, k, m = folds.rsi(14), folds.atr(14), folds.keltner(), folds.mfi(14)
        return lambda h, lo, c, v: (r(c)[0], a(h, lo, c)[0], *k(h, lo, c)[1:], m(h, lo, c, v)[0])

    o = folds.ordered_fold(_forgetting(spark, d, 14), ["series", "block"], ["rn"], ["high", "low", "close", "volume"], ["bar_id", "halo"], make, [("rsi14", D), ("atr14", D), ("kc_up", D), ("kc_low", D), ("mfi14", D)])
    return own(o).select("bar_id", F.round("rsi14", 5).alias("rsi14"), F.round("atr14", 6).alias("atr14"), *[F.round(c, 5).alias(c) for c in ("kc_up", "kc_low", "mfi14")])


@query(f"""WITH {BARS}{_STEP}, z AS (SELECT series, bar_id, rn, {_wil('tr', 14, 2)} AS t, {_wil('pdm', 14, 2)} AS p, {_wil('mdm', 14, 2)} AS m FROM g WINDOW u AS {_ALL}),
 y AS (SELECT *, 100 * p / t AS pdi, 100 * m / t AS mdi, CASE WHEN p + m = 0 THEN 0.0 ELSE 100 * abs(100 * p / t - 100 * m / t) / (100 * p / t + 100 * m / t) END AS dx FROM z),
 v AS (SELECT *, {_wil('dx', 14, 15).replace('list(dx) OVER u', 'list(coalesce(dx, 0)) OVER u')} AS adx FROM y WINDOW u AS {_ALL})
SELECT bar_id, round(pdi, 5) AS plus_di, round(mdi, 5) AS minus_di, round(adx, 5) AS adx, round((adx + lag(adx, 14) OVER ({W})) / 2, 5) AS adxr FROM v""")
def f_directional(spark: SparkSession, d: str) -> DataFrame:
    return _fold(_forgetting(spark, d, 30), lambda: folds.directional(14), ["high", "low", "close"], [("plus_di", D), ("minus_di", D), ("adx", D), ("adxr", D)], digits=5)


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT series, bar_id, rn, high AS h, low AS l, close AS c, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
  lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2, lag(close) OVER w AS c1 FROM x WINDOW w AS ({W})),
 s AS (SELECT series, bar_id, rn, c, tr AS tr_sum, NULL::DOUBLE AS a, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, 1 AS tt, NULL::DOUBLE AS sar, NULL::DOUBLE AS ep, NULL::DOUBLE AS af, NULL::BOOLEAN AS rise FROM d WHERE rn = 1
  UNION ALL SELECT series, bar_id, rn, c, tr_sum, a, up, dn, CASE WHEN pup IS NULL THEN tt WHEN tt = 1 AND c < dn THEN -1 WHEN tt = -1 AND c > up THEN 1 ELSE tt END,
   CASE WHEN rn = 2 THEN nsar WHEN flip THEN ep ELSE nsar END, CASE WHEN rn = 2 THEN ep WHEN flip THEN CASE WHEN rise THEN l ELSE h END WHEN rise THEN greatest(ep, h) ELSE least(ep, l) END,
   CASE WHEN rn = 2 OR flip THEN 0.02::DOUBLE WHEN (rise AND h > ep) OR (NOT rise AND l < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END, CASE WHEN flip THEN NOT rise ELSE rise END
  FROM (SELECT *, CASE WHEN rn = 2 THEN false WHEN rise THEN l < nsar ELSE h > nsar END AS flip,
    CASE WHEN pup IS NULL THEN u ELSE CASE WHEN u < pup OR pc > pup THEN u ELSE pup END END AS up, CASE WHEN pdn IS NULL THEN q ELSE CASE WHEN q > pdn OR pc < pdn THEN q ELSE pdn END END AS dn
   FROM (SELECT d.series, d.bar_id, d.rn, d.h, d.l, d.c, s.c AS pc, s.up AS pup, s.dn AS pdn, s.tt, CASE WHEN d.rn <= 10 THEN s.tr_sum + d.tr ELSE 0 END AS tr_sum,
     CASE WHEN d.rn < 10 THEN NULL WHEN d.rn = 10 THEN (s.tr_sum + d.tr) / 10 ELSE (s.a * 9 + d.tr) / 10 END AS a,
     (d.h + d.l) / 2 + 3.0::DOUBLE * CASE WHEN d.rn < 10 THEN NULL WHEN d.rn = 10 THEN (s.tr_sum + d.tr) / 10 ELSE (s.a * 9 + d.tr) / 10 END AS u,
     (d.h + d.l) / 2 - 3.0::DOUBLE * CASE WHEN d.rn < 10 THEN NULL WHEN d.rn = 10 THEN (s.tr_sum + d.tr) / 10 ELSE (s.a * 9 + d.tr) / 10 END AS q,
     CASE WHEN d.rn = 2 THEN d.c >= d.c1 ELSE s.rise END AS rise, CASE WHEN d.rn = 2 THEN CASE WHEN d.c >= d.c1 THEN d.h ELSE d.l END ELSE s.ep END AS ep, s.af,
     CASE WHEN d.rn = 2 THEN CASE WHEN d.c >= d.c1 THEN d.l1 ELSE d.h1 END WHEN s.rise THEN least(s.sar + s.af * (s.ep - s.sar), d.l1, d.l2) ELSE greatest(s.sar + s.af * (s.ep - s.sar), d.h1, d.h2) END AS nsar
    FROM s JOIN d ON d.series = s.series AND d.rn = s.rn + 1)))
SELECT bar_id, CASE WHEN a IS NOT NULL THEN round(CASE WHEN tt = 1 THEN dn ELSE up END, 6) END AS st_line, CAST(CASE WHEN a IS NOT NULL THEN tt END AS INTEGER) AS st_trend, round(sar, 6) AS sar, CAST(CASE WHEN sar IS NOT NULL THEN CASE WHEN rise THEN 1 ELSE -1 END END AS INTEGER) AS sar_trend FROM s""")
def f_trend_stops(spark: SparkSession, d: str) -> DataFrame:
    """SuperTrend and parabolic stop: state machines, one pass per series."""
    def make():  # noqa: ANN202
        s, p = folds.supertrend(), folds.parabolic()
        return lambda h, lo, c: (*s(h, lo, c), *p(h, lo, c))

    return _fold(_whole(spark, d), make, ["high", "low", "close"], [("st_line", D), ("st_trend", I), ("sar", D), ("sar_trend", I)], keys=("series",))


@query(f"""WITH {BARS}{_STEP} SELECT bar_id, round(list_reduce(list_prepend(0.0002::DOUBLE, list(coalesce(r2, 0.0)) OVER u), lambda v, r: CASE WHEN r < 0 THEN v ELSE 0.00001 + 0.1 * r + 0.85 * v END), 9) AS garch
  FROM (SELECT *, CASE WHEN rn <= 2 THEN -1.0 ELSE lag(ret2) OVER ({W}) END AS r2 FROM (SELECT *, power(close / lag(close) OVER ({W}) - 1, 2) AS ret2 FROM x)) WINDOW u AS {_ALL}""")
def f_garch(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=folds.WARM * 20, block_rows=50_000)
    df = df.withColumn("ret", rolling.pct_return(f, "close"))
    return _fold(df, lambda: folds.garch(1e-5), ["ret"], [("garch", D)], digits=9)


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT series, bar_id, rn, close AS p, close / lag(close) OVER ({W}) - 1 AS r FROM x),
 s AS (SELECT series, bar_id, rn, p AS level, 1.0::DOUBLE AS v, NULL::DOUBLE AS e, NULL::DOUBLE AS t, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS alarm, r FROM d WHERE rn = 1
  UNION ALL SELECT d.series, d.bar_id, d.rn, s.level + (s.v + 1e-5) / (s.v + 1e-5 + 0.01) * (d.p - s.level), (s.v + 1e-5) * (1 - (s.v + 1e-5) / (s.v + 1e-5 + 0.01)), NULL, NULL,
   greatest(0.0, CASE WHEN s.alarm <> 0 THEN 0 ELSE s.up END + 1000 * d.r - 0.5), greatest(0.0, CASE WHEN s.alarm <> 0 THEN 0 ELSE s.dn END - 1000 * d.r - 0.5),
   CASE WHEN greatest(0.0, CASE WHEN s.alarm <> 0 THEN 0 ELSE s.up END + 1000 * d.r - 0.5) > 5 THEN 1 WHEN greatest(0.0, CASE WHEN s.alarm <> 0 THEN 0 ELSE s.dn END - 1000 * d.r - 0.5) > 5 THEN -1 ELSE 0 END, d.r
  FROM s JOIN d ON d.series = s.series AND d.rn = s.rn + 1)
SELECT bar_id, round(level, 9) AS level, round(v, 9) AS level_var, round(up, 9) AS cusum_up, round(dn, 9) AS cusum_down, CAST(alarm AS INTEGER) AS alarm FROM s""")
def f_filters(spark: SparkSession, d: str) -> DataFrame:
    """Kalman level and CUSUM alarms on returns in permille."""
    df, f = framed_bars(spark, d, before=2)
    df = own(df.withColumn("ret", rolling.pct_return(f, "close")))

    def make():  # noqa: ANN202
        k, c = folds.kalman(), folds.cusum(0.5, 5.0)
        return lambda p, r: (*k(p), *c(None if r is None else 1000 * r))

    return _fold(df, make, ["close", "ret"], [("level", D), ("level_var", D), ("cusum_up", D), ("cusum_down", D), ("alarm", I)], keys=("series",), digits=9)


@query()
def f_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Exponential and threshold GARCH variances of returns."""
    df, f = framed_bars(spark, d, before=2)
    df = own(df.withColumn("ret", rolling.pct_return(f, "close")))

    def make():  # noqa: ANN202
        e, t = folds.egarch(-1.5), folds.garch(1e-5, gamma=0.04)
        return lambda r: (*e(r), *t(r))

    return _fold(df, make, ["ret"], [("egarch", D), ("tgarch", D)], keys=("series",), digits=9)


_SEC = "CASE timeframe WHEN 'M5' THEN 300 WHEN 'M15' THEN 900 WHEN 'H1' THEN 3600 END"


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT series, bar_id, rn, high, low, close, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) <> {_SEC} * 1000000::BIGINT, false) AS gap,
   greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM x WINDOW w AS ({W})),
 e AS (SELECT *, CASE WHEN rn >= 14 THEN avg(tr) OVER (PARTITION BY series ORDER BY rn ROWS 13 PRECEDING) END AS atr, rn - max(CASE WHEN gap OR rn = 1 THEN rn END) OVER ({W}) + 1 AS run FROM d),
 q AS (SELECT unnest([2, 3, 4, 5, 6, 8, 10]) AS w),
 g AS (SELECT e.series, e.rn, q.w, m.high AS mh, m.low AS ml, max(o.high) AS oh, min(o.low) AS ol FROM e JOIN q ON e.run >= 2 * q.w + 1 JOIN e m ON m.series = e.series AND m.rn = e.rn - q.w JOIN e o ON o.series = e.series AND o.rn BETWEEN e.rn - 2 * q.w AND e.rn AND o.rn <> m.rn GROUP BY ALL),
 k AS (SELECT e.*, lag(high) OVER (PARTITION BY series ORDER BY rn) AS high1, lag(low) OVER (PARTITION BY series ORDER BY rn) AS low1, lag(close) OVER (PARTITION BY series ORDER BY rn) AS close1, lag(atr) OVER (PARTITION BY series ORDER BY rn) AS atr1 FROM e),
 v AS (SELECT w, basis, c, b, 'sw' || lpad(w::VARCHAR, 2, '0') || '_' || basis || '_c' || c || CASE WHEN b = 0 THEN '_atr0000' ELSE '_atr0500' END AS variant FROM q, (SELECT unnest(['wick', 'close']) AS basis), (SELECT unnest([1, 2]) AS c), (SELECT unnest([0.0, 0.05]::DOUBLE[]) AS b)),
 r AS (SELECT k.series, k.rn, k.bar_id, v.variant, v.w, v.c, v.b, k.run, CASE basis WHEN 'wick' THEN high ELSE close END AS u0, CASE basis WHEN 'wick' THEN low ELSE close END AS d0, CASE basis WHEN 'wick' THEN high1 ELSE close1 END AS u1, CASE basis WHEN 'wick' THEN low1 ELSE close1 END AS d1,
   CASE WHEN v.b = 0 THEN 0.0 ELSE v.b * atr END AS b0, CASE WHEN v.b = 0 THEN 0.0 ELSE v.b * atr1 END AS b1, CASE WHEN g.mh > g.oh THEN g.mh END AS top, CASE WHEN g.ml < g.ol THEN g.ml END AS bottom FROM k CROSS JOIN v LEFT JOIN g ON g.series = k.series AND g.rn = k.rn AND g.w = v.w),
 s AS (SELECT series, rn, variant, bar_id, top AS hi, bottom AS lo, 0 AS trend, NULL::VARCHAR AS event, NULL::DOUBLE AS level FROM r WHERE rn = 1
  UNION ALL SELECT series, rn, variant, bar_id, coalesce(top, CASE WHEN up AND NOT dn THEN NULL ELSE hi END), coalesce(bottom, CASE WHEN dn AND NOT up THEN NULL ELSE lo END), CASE WHEN up AND NOT dn THEN 1 WHEN dn AND NOT up THEN -1 ELSE trend END,
   CASE WHEN up AND dn THEN 'AMBIGUOUS' WHEN up THEN CASE WHEN trend = -1 THEN 'CHOCH' ELSE 'BOS' END WHEN dn THEN CASE WHEN trend = 1 THEN 'CHOCH' ELSE 'BOS' END END, CASE WHEN up AND NOT dn THEN hi WHEN dn AND NOT up THEN lo END
  FROM (SELECT r.*, s.hi, s.lo, s.trend, coalesce(r.u0 > s.hi + r.b0 AND (r.c = 1 OR (r.run >= 2 AND r.u1 > s.hi + r.b1)), false) AS up, coalesce(r.d0 < s.lo - r.b0 AND (r.c = 1 OR (r.run >= 2 AND r.d1 < s.lo - r.b1)), false) AS dn
   FROM s JOIN r ON r.series = s.series AND r.variant = s.variant AND r.rn = s.rn + 1))
SELECT bar_id, variant, event, level FROM s WHERE event IS NOT NULL""")
def f_structure(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of swing levels along (BOS) and against (CHOCH) the trend under the 56 definitions of the grid, in one pass of each series."""
    df, f = framed_bars(spark, d, before=1)
    step_us = F.unix_micros("ts") - F.unix_micros(f.lag("ts"))
    df = own(df.withColumn("gap", F.coalesce(step_us != timeframe_seconds("timeframe").cast("bigint") * 1_000_000, F.lit(False))))
    return folds.ordered_events(df, ["series"], ["rn"], ["high", "low", "close", "gap"], ["bar_id"], lambda: folds.market_structures(folds.structure_grid()), [("variant", S), ("event", S), ("level", D)])


def _crossings(spark: SparkSession, d: str) -> DataFrame:
    """Bars with signal: crossings of the 20 and 100 row averages."""
    df, f = framed_bars(spark, d, before=101)
    df = df.withColumn("gap", F.round(rolling.sma(f, "close", 20) - rolling.sma(f, "close", 100), 9))
    return own(df.withColumn("signal", F.when((f.lag("gap") <= 0) & (F.col("gap") > 0), 1).when((f.lag("gap") >= 0) & (F.col("gap") < 0), -1)))


_SIGNALS = f"""{BARS}, a_ AS (SELECT *, CASE WHEN rn >= 100 THEN round(avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 19 PRECEDING) - avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 99 PRECEDING), 9) END AS gap FROM x),
 d AS (SELECT series, bar_id, rn, open AS o, high AS h, low AS l, close AS c, CASE WHEN lag(gap) OVER ({W}) <= 0 AND gap > 0 THEN 1 WHEN lag(gap) OVER ({W}) >= 0 AND gap < 0 THEN -1 ELSE 0 END AS sig FROM a_)"""


def _account(keys: str, stop: str, take: str, hold: str) -> str:
    """The account recursion: after the open (1), then stop, target or holding time inside the bar (2)."""
    return f""" s AS (SELECT {keys}, d.series, d.bar_id, d.rn, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS entry, 0 AS age, d.sig AS wait, '' AS action, 100000.0::DOUBLE AS equity, 0 AS buys FROM d CROSS JOIN p WHERE rn = 1
  UNION ALL SELECT {keys}, series, bar_id, rn, CASE WHEN out <> '' THEN cash1 + qty1 * px * (1 - 0.0005::DOUBLE) * (1 - 0.001::DOUBLE) ELSE cash1 END, CASE WHEN out <> '' THEN 0 ELSE qty1 END, entry1, CASE WHEN out <> '' THEN 0 ELSE age1 END, sig, act1 || out,
   CASE WHEN out <> '' THEN cash1 + qty1 * px * (1 - 0.0005::DOUBLE) * (1 - 0.001::DOUBLE) ELSE cash1 + qty1 * c END, buys + (act1 = 'BUY')::INT
  FROM (SELECT *, CASE out WHEN 'STOP' THEN least(o, entry1 * (1 - {stop})) WHEN 'TARGET' THEN greatest(o, entry1 * (1 + {take})) WHEN 'HOLD' THEN c END AS px
   FROM (SELECT *, CASE WHEN qty1 = 0 THEN '' WHEN l <= entry1 * (1 - {stop}) THEN 'STOP' WHEN h >= entry1 * (1 + {take}) THEN 'TARGET' WHEN age1 >= {hold} THEN 'HOLD' ELSE '' END AS out
    FROM (SELECT *, CASE WHEN qty1 > 0 THEN age0 + 1 ELSE age0 END AS age1
     FROM (SELECT {', '.join('s.' + k for k in keys.replace('p.', '').split(', '))}, d.*, s.buys, CASE WHEN s.wait = 1 AND s.qty = 0 THEN 0.0 WHEN s.wait = -1 AND s.qty > 0 THEN s.cash + s.qty * d.o * (1 - 0.0005::DOUBLE) * (1 - 0.001::DOUBLE) ELSE s.cash END AS cash1,
       CASE WHEN s.wait = 1 AND s.qty = 0 THEN s.cash / (d.o * (1 + 0.0005::DOUBLE) * (1 + 0.001::DOUBLE)) WHEN s.wait = -1 THEN 0.0 ELSE s.qty END AS qty1, CASE WHEN s.wait = 1 AND s.qty = 0 THEN d.o * (1 + 0.0005::DOUBLE) ELSE s.entry END AS entry1,
       CASE WHEN s.wait = 1 AND s.qty = 0 THEN 0 WHEN s.wait = -1 THEN 0 ELSE s.age END AS age0, CASE WHEN s.wait = 1 AND s.qty = 0 THEN 'BUY' WHEN s.wait = -1 AND s.qty > 0 THEN 'SELL' ELSE '' END AS act1
      FROM s JOIN d ON d.series = s.series AND d.rn = s.rn + 1)))))"""


@query(f"""WITH RECURSIVE {_SIGNALS}, p AS (SELECT 0 AS one),{_account('one', '0.02::DOUBLE', '0.03::DOUBLE', '200')}
SELECT bar_id, round(equity, 6) AS equity, round(qty, 6) AS position, action FROM s""")
def f_replay(spark: SparkSession, d: str) -> DataFrame:
    """Account value per bar: crossings of the 20 and 100 row averages, filled at the next open, with costs, stop and target."""
    return _fold(_crossings(spark, d), lambda: folds.replay(stop=0.02, take=0.03, hold=200), ["open", "high", "low", "close", "signal"], [("equity", D), ("position", D), ("action", S)], keys=("series",))


@query(f"""WITH RECURSIVE {_SIGNALS}, p AS (SELECT st AS stop, tk AS take FROM (SELECT unnest([0.005, 0.01, 0.02]::DOUBLE[]) AS st), (SELECT unnest([0.01, 0.02, 0.04]::DOUBLE[]) AS tk)),{_account('stop, take', 'stop', 'take', '1000000000')},
 f AS (SELECT series, stop, take, arg_max(equity, rn) AS equity, max(buys) AS trades FROM s GROUP BY ALL)
SELECT stop, take, round(sum(equity / 100000 - 1), 6) AS total, CAST(sum(trades) AS BIGINT) AS trades FROM f GROUP BY ALL""")
def f_grid(spark: SparkSession, d: str) -> DataFrame:
    """Parameter grid: each stop and target over all series at once, best first by total return; one pass of a series holds all accounts."""
    grid = [(s, t) for s in (0.005, 0.01, 0.02) for t in (0.01, 0.02, 0.04)]

    def make():  # noqa: ANN202
        accounts = [folds.replay(stop=s, take=t) for s, t in grid]
        last, buys = [100_000.0] * len(grid), [0] * len(grid)

        def step(*bar) -> None:  # noqa: ANN002
            for i, a in enumerate(accounts):
                last[i], _, action = a(*bar)
                buys[i] += "BUY" in action

        return step, lambda: [(s, t, e, b) for (s, t), e, b in zip(grid, last, buys)]

    last = folds.series_totals(_crossings(spark, d), ["series"], ["rn"], ["open", "high", "low", "close", "signal"], make, [("stop", D), ("take", D), ("equity", D), ("trades", T.LongType())])
    r = last.groupBy("stop", "take").agg(F.round(F.sum(F.col("equity") / 100_000 - 1), 6).alias("total"), F.sum("trades").alias("trades"))
    return r.orderBy(F.desc("total"), "stop", "take")
