"""Queries of strategies, rolling geometry, states as of a time, audits and weighted measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.text_keys import hash_key
from tapewright.operators import asof, behaviour, folds, macro, rolling, stats, strategy
from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.plans.base import BARS, W, clean_bars, framed_bars, own
from tapewright.plans.extra import _macro
from tapewright.plans.measures import returns
from tapewright.plans.recursions import _EMA, _SIGNALS, _STEP, _crossings, _forgetting, _wil
from tapewright.runtime import cut, table

QUERIES, SQL = {}, {}
D = T.DoubleType()
_R = f"{BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {_SIGNALS},
 s AS (SELECT series, bar_id, rn, 0.0::DOUBLE AS qty, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS fee0, 0.0::DOUBLE AS realised, c, NULL::DOUBLE AS trade FROM d WHERE rn = 1
  UNION ALL SELECT series, bar_id, rn, CASE WHEN NOT act THEN qty WHEN qty <> 0 THEN 0 ELSE sig * n END, CASE WHEN act THEN cash - sig * px * n - fee ELSE cash END, CASE WHEN act AND qty = 0 THEN px ELSE entry END, CASE WHEN act AND qty = 0 THEN fee ELSE fee0 END,
   CASE WHEN act AND qty <> 0 THEN realised + (entry - px) * n * sig - fee0 - fee ELSE realised END, c, CASE WHEN act AND qty <> 0 THEN (entry - px) * n * sig - fee0 - fee END
  FROM (SELECT *, abs(px * n) * 0.001::DOUBLE AS fee FROM (SELECT d.series, d.bar_id, d.rn, d.sig, d.c, s.qty, s.cash, s.entry, s.fee0, s.realised, d.sig <> 0 AND d.sig * s.qty <= 0 AS act, CASE WHEN s.qty <> 0 THEN abs(s.qty) ELSE 10.0 END AS n, d.c + d.sig * (d.c * 0.0002::DOUBLE) AS px FROM s JOIN d ON d.series = s.series AND d.rn = s.rn + 1)))
SELECT bar_id, qty AS quantity, round(cash, 6) AS cash, round(realised, 6) AS realised, round(cash + qty * c, 6) AS equity, round(trade, 6) AS trade FROM s""")
def s_execution(spark: SparkSession, d: str) -> DataFrame:
    """An account of either side on crossings of averages: ten units, costs in percent, marked at each close."""
    o = folds.ordered_fold(_crossings(spark, d), ["series"], ["rn"], ["signal", "close"], ["bar_id"], lambda: strategy.execution(commission="pct:0.001", slippage="pct:0.0002", size=10.0), [(n, D) for n in ("quantity", "cash", "realised", "equity", "trade")])
    return o.select("bar_id", "quantity", *[F.round(c, 6).alias(c) for c in ("cash", "realised", "equity", "trade")])


def _mean(c: str, n: int, at: int = 1) -> str:
    e = at + n - 1
    return f"CASE WHEN rn >= {e} THEN list_reduce(list_prepend(list_avg((list({c}) OVER u)[{at}:{e}]), (list({c}) OVER u)[{e + 1}:]), lambda a, v: a + (2.0::DOUBLE/{n + 1}) * (v - a)) END"


_UP = f"({W} ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {BARS}{_STEP}, z AS (SELECT *, {_wil('gain', 14, 2)} AS ag, {_wil('loss', 14, 2)} AS al, {_mean('close', 12)} - {_mean('close', 26)} AS line, avg(close) OVER q AS m, stddev_pop(close) OVER q AS sd FROM g WINDOW u AS {_UP}, q AS ({W} ROWS 19 PRECEDING)),
 y AS (SELECT *, round(line - {_mean('coalesce(line, 0)', 9, 26)}, 9) AS h FROM z WINDOW u AS {_UP}), k AS (SELECT *, lag(h) OVER ({W}) AS p, round(CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 9) AS rsi FROM y),
 n AS (SELECT bar_id, rn, (rsi < 30)::INT + coalesce(h > 0 AND p <= 0, false)::INT + (round(close - m + 2 * sd, 9) < 0)::INT AS buy, (rsi > 70)::INT + coalesce(h < 0 AND p >= 0, false)::INT + (round(close - m - 2 * sd, 9) > 0)::INT AS sell FROM k WHERE rn > 35)
SELECT bar_id, CASE WHEN buy >= 2 THEN 'BUY' ELSE 'SELL' END AS action FROM n WHERE buy >= 2 OR sell >= 2""")
def s_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Signals where two of relative strength, MACD turn and bands agree."""
    def make():  # noqa: ANN202
        r, m = folds.rsi(14), folds.macd(seed="mean")
        return lambda c: (r(c)[0], m(c)[2])

    df = _forgetting(spark, d, 26)
    f = Frames()
    df = df.withColumns({"mean": F.avg("close").over(f.last(20)), "sd": F.stddev_pop("close").over(f.last(20))})
    o = folds.ordered_fold(df, ["series", "block"], ["rn"], ["close"], ["series", "block", "rn", "bar_id", "close", "mean", "sd", "halo"], make, [("rsi", D), ("h", D)]).withColumns({"rsi": F.round("rsi", 9), "h": F.round("h", 9)})
    band = lambda side: F.round(F.col("close") - F.col("mean") + side * 2 * F.col("sd"), 9)
    o = o.withColumn("action", strategy.votes(F.col("rsi"), F.col("h"), f.lag("h"), F.lit(0.0), -band(1), -band(-1)))
    return own(o).where("rn > 35 and action is not null").select("bar_id", "action")


_PAIRS = ((5, 20), (10, 50), (20, 100))


@query(f"""WITH {_R}, a AS (SELECT series, rn, ret, avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 4 PRECEDING) AS m5, avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 9 PRECEDING) AS m10, avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 19 PRECEDING) AS m20, avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 49 PRECEDING) AS m50, avg(close) OVER (PARTITION BY series ORDER BY rn ROWS 99 PRECEDING) AS m100 FROM r),
 p AS (SELECT series, rn, ret, 5 AS fast, 20 AS slow, CASE WHEN rn >= 20 THEN sign(round(m5 - m20, 9)) ELSE 0 END AS pos FROM a UNION ALL SELECT series, rn, ret, 10, 50, CASE WHEN rn >= 50 THEN sign(round(m10 - m50, 9)) ELSE 0 END FROM a UNION ALL SELECT series, rn, ret, 20, 100, CASE WHEN rn >= 100 THEN sign(round(m20 - m100, 9)) ELSE 0 END FROM a),
 q AS (SELECT series, rn, fast, slow, lag(pos) OVER w * ret - 0.0001::DOUBLE * abs(lag(pos) OVER w - coalesce(lag(pos, 2) OVER w, 0)) AS x FROM p WINDOW w AS (PARTITION BY series, fast, slow ORDER BY rn)),
 n AS (SELECT series, max(rn) AS n FROM r GROUP BY series), f AS (SELECT series, unnest(range(0, (n - 300) // 60)) AS fold FROM n WHERE n >= 360),
 t AS (SELECT f.series, fold, fast, slow, sum(x) FILTER (rn <= fold * 60 + 240) AS train, sum(x) FILTER (rn > fold * 60 + 240) AS test, count(*) FILTER (rn > fold * 60 + 240) AS rows FROM f JOIN q ON q.series = f.series AND rn > fold * 60 AND rn <= fold * 60 + 300 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY series, fold ORDER BY coalesce(round(train, 12), 0) DESC, fast, slow) AS k FROM t)
SELECT series, fold, CAST(fast AS INTEGER) AS fast, CAST(slow AS INTEGER) AS slow, round(train, 9) AS train_total, round(test, 9) AS test_total, rows FROM k WHERE k = 1""".replace("(n - 300) // 60)) AS fold FROM n WHERE n >= 360", "(n - 300) // 60 + 1)) AS fold FROM n WHERE n >= 300"))
def s_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of averages chosen on 240 rows and held to the next 60, fold by fold, with costs."""
    df, f = framed_bars(spark, d, before=103)
    df = df.withColumn("ret", rolling.pct_return(f, "close"))
    for a, b in _PAIRS:
        gap = F.round(rolling.sma(f, "close", a) - rolling.sma(f, "close", b), 9)
        df = df.withColumn(f"pos{a}", F.when(f.rn >= b, F.signum(gap)).otherwise(0.0))
    df = own(df.withColumns({f"x{a}": strategy.position_returns(f, "ret", f"pos{a}", 0.0001) for a, _ in _PAIRS}))
    runs = df.select("series", "rn", F.explode(F.array(*[F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.col(f"x{a}").alias("x")) for a, b in _PAIRS])).alias("p")).select("series", "rn", "p.*")
    w = strategy.walk_forward(runs, ["series"], ["fast", "slow"], "x", 240, 60)
    return w.select("series", "fold", "fast", "slow", F.round("train_total", 9).alias("train_total"), F.round("test_total", 9).alias("test_total"), "rows")


@query(f"""WITH {BARS}, t AS (SELECT *, CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr FROM x),
 h AS (SELECT a.bar_id, count(*) AS n, count(*) FILTER (b.tr <= a.tr) AS k, quantile_disc(b.tr, 0.6) AS threshold FROM t a JOIN t b ON b.series = a.series AND b.rn BETWEEN a.rn - 200 AND a.rn - 1 GROUP BY a.bar_id)
SELECT t.bar_id, CASE WHEN coalesce(n, 0) < 50 THEN 'WARMUP' WHEN k / n >= 0.6 THEN 'HIGH_VOLATILITY' ELSE 'LOW_OR_MID_VOLATILITY' END AS status, CASE WHEN n >= 50 THEN round(k / n, 8) END AS percentile FROM t LEFT JOIN h USING (bar_id)""")
def w_volatility_gate(spark: SparkSession, d: str) -> DataFrame:
    """Where a bar's range ranks among the 200 before it; high from the 60th percentile on, at least 50 rows."""
    df, f = framed_bars(spark, d, before=202)
    df = df.withColumn("tr", rolling.true_range(f))
    return own(df.withColumns(behaviour.volatility_gate(f, "tr"))).select("bar_id", "status", F.round("percentile", 8).alias("percentile"))


@query(f"""WITH {BARS}, f AS (SELECT *, CASE WHEN close <= lag(close) OVER ({W}) AND close <= lead(close) OVER ({W}) THEN close END AS lo, CASE WHEN close >= lag(close) OVER ({W}) AND close >= lead(close) OVER ({W}) THEN close END AS hi, lag(close) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2, lag(close, 19) OVER ({W}) AS c19 FROM x),
 g AS (SELECT bar_id, rn, close, c1, c2, c19, regr_slope(close, rn) OVER w AS slope, regr_r2(close, rn) OVER w AS r2, avg(lo) OVER i AS support, avg(hi) OVER i AS resistance FROM f WINDOW w AS ({W} ROWS 19 PRECEDING), i AS ({W} ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING)),
 m AS (SELECT *, sqrt(1 + power(c1 - c2, 2)) * sqrt(1 + power(close - c1, 2)) * sqrt(4 + power(close - c2, 2)) AS den FROM g WHERE rn >= 20)
SELECT bar_id, round(slope, 6) AS slope, round(degrees(atan2(close - c19, 19)), 6) AS angle, round(sqrt(361 + power(close - c19, 2)), 6) AS magnitude, round(2 * ((close - c2) - 2 * (c1 - c2)) / den, 6) AS curvature, round(support, 9) AS support, round(resistance, 9) AS resistance FROM m""")
def w_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Slope, angle, length, curvature and mean pivots of the last twenty closes."""
    df, f = framed_bars(spark, d, before=22, after=1)
    g = behaviour.window_geometry(f, "close", 20)
    df = df.withColumns({"lo": behaviour.pivot(f, "close", -1), "hi": behaviour.pivot(f, "close", 1)}).withColumns(g)
    return own(df).where("rn >= 20").select("bar_id", *[F.round(c, 9 if c in ("support", "resistance") else 6).alias(c) for c in g])


@query(f"""WITH {BARS} SELECT series, (rn - 1) // 25 AS start_window, min(rn) AS first_rn, count(*) AS n, round(sum(close), 6) AS total FROM (SELECT a.series, a.rn AS s, b.rn, b.close FROM x a JOIN x b ON b.series = a.series AND b.rn BETWEEN a.rn AND a.rn + 49 WHERE (a.rn - 1) % 25 = 0) GROUP BY series, s, start_window""".replace("(rn - 1) // 25 AS start_window", "(s - 1) // 25 AS start_window").replace("GROUP BY series, s, start_window", "GROUP BY series, s"))
def w_count_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 rows that start every 25 rows of a series; the last ones are shorter."""
    n = numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"])
    return behaviour.count_windows(n, ["series"], 50, 25).groupBy("series", "start_window").agg(F.min("rn").alias("first_rn"), F.count("*").alias("n"), F.round(F.sum("close"), 6).alias("total"))


@query(f"""WITH {_R}, m AS (SELECT series, sum(ret * volume) / nullif(sum(volume), 0) AS mean, count(*) AS n, min(ret) AS least, max(ret) AS most, sum(volume) AS weight FROM v GROUP BY series)
SELECT v.series, any_value(n) AS n, round(any_value(mean), 10) AS mean, round(sum(volume * power(ret - mean, 2)) / nullif(any_value(weight), 0), 12) AS variance, any_value(least) AS least, any_value(most) AS most FROM v JOIN m USING (series) GROUP BY v.series""")
def m_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Returns weighted by volume."""
    w = stats.weighted(cut(returns(spark, d).select("series", "ret", "volume")), ["series"], "ret", "volume")
    return w.select("series", "n", F.round("mean", 10).alias("mean"), F.round("variance", 12).alias("variance"), "least", "most")


@query(f"""WITH {_R}, g AS (SELECT unnest([-0.002, -0.0005, 0.0, 0.0005, 0.002]::DOUBLE[]) AS x0) SELECT series, x0 AS x, round(count(*) FILTER (ret <= x0) / count(*), 8) AS p FROM v CROSS JOIN g GROUP BY series, x0""")
def m_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Empirical distribution of returns at five points."""
    return stats.empirical_cdf(returns(spark, d), ["series"], "ret", (-0.002, -0.0005, 0.0, 0.0005, 0.002)).withColumn("p", F.round("p", 8))


@query(f"""WITH {_R}, n AS (SELECT series, ret, lead(ret) OVER (PARTITION BY series ORDER BY rn) AS nxt FROM v), e AS (SELECT series, min(ret) AS a, max(ret) AS z FROM n WHERE nxt IS NOT NULL GROUP BY series),
 b AS (SELECT n.series, CASE WHEN z > a THEN least(9, greatest(0, floor((ret - a) / ((z - a) / 10))))::INT ELSE 0 END AS bin, sign(nxt)::INT AS label FROM n JOIN e USING (series) WHERE nxt IS NOT NULL)
SELECT series, bin, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series, bin), 8) AS p FROM b GROUP BY series, bin, label""".replace("), b AS (SELECT n.series", "), bins AS (SELECT n.series").replace(" b AS (SELECT n.series", " bins AS (SELECT n.series").replace("FROM b GROUP BY", "FROM bins GROUP BY"))
def m_conditional_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Direction of the next row by ten equal-width bins of the present return."""
    f = Frames()
    x = own(with_halo(returns(spark, d), after=1).withColumn("nxt", f.lead("ret"))).where("nxt is not null").withColumn("label", F.signum("nxt").cast("int"))
    return stats.conditional_frequencies(cut(x.select("series", "ret", "label")), ["series"], "ret", "label").withColumn("p", F.round("p", 8))


@query(f"""WITH {_R}, g AS (SELECT m, s FROM (SELECT unnest([-0.0002, 0.0, 0.0002]::DOUBLE[]) AS m), (SELECT unnest([0.0005, 0.001, 0.002, 0.004]::DOUBLE[]) AS s)), l AS (SELECT series, m, s, sum(-0.5 * ln(2 * pi() * s * s) - power(ret - m, 2) / (2 * s * s)) AS ll FROM v CROSS JOIN g GROUP BY ALL)
SELECT series, m AS mu, s AS sigma, round(ll, 4) AS log_likelihood FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(ll, 9) DESC, m, s) AS k FROM l) WHERE k = 1""")
def m_grid_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """The normal distribution of a grid that makes the returns likeliest."""
    import math

    x = F.col("ret")
    grid = [{"mu": m, "sigma": s} for m in (-0.0002, 0.0, 0.0002) for s in (0.0005, 0.001, 0.002, 0.004)]
    ll = lambda p: -0.5 * math.log(2 * math.pi * p["sigma"] ** 2) - F.pow(x - p["mu"], F.lit(2.0)) / (2 * p["sigma"] ** 2)
    return stats.grid_likelihood(returns(spark, d), ["series"], grid, ll).withColumn("log_likelihood", F.round("log_likelihood", 4))


@query(f"""WITH {_R}, s AS (SELECT series, rn, sign(ret) AS s, count(*) OVER (PARTITION BY series) AS n, avg(sign(ret)) OVER (PARTITION BY series) AS m FROM v), k AS (SELECT unnest(range(1, 11)) AS lag), c AS (SELECT series, sum(power(s - m, 2)) AS d FROM s GROUP BY series)
SELECT a.series, CAST(lag AS INTEGER) AS lag, round(sum((a.s - a.m) * (b.s - b.m)) / any_value(d), 8) AS autocorrelation, count(*) AS pairs FROM s a CROSS JOIN k JOIN s b ON b.series = a.series AND b.rn = a.rn + lag JOIN c ON c.series = a.series GROUP BY a.series, lag""")
def r_outcome_dependence(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of the signs of outcomes at lags 1 to 10."""
    from tapewright.operators import linear

    s = returns(spark, d).withColumn("s", F.signum("ret"))
    n = s.groupBy("series").agg(F.count("*").alias("_n"))
    a = linear.autocorrelations(s.select("series", "rn", "s"), ["series"], "s", 10).join(n, "series")
    return a.select("series", "lag", F.round("acf", 8).alias("autocorrelation"), (F.col("_n") - F.col("lag")).alias("pairs")).where("pairs > 0")


@query(f"""WITH {_R}, s AS (SELECT series, rn, sign(ret)::INT AS s, lead(ret) OVER (PARTITION BY series ORDER BY rn) AS nxt FROM v), g AS (SELECT *, rn - row_number() OVER (PARTITION BY series, s ORDER BY rn) AS g FROM s), l AS (SELECT *, row_number() OVER (PARTITION BY series, s, g ORDER BY rn) AS len FROM g), k AS (SELECT unnest(range(2, 11)) AS length)
SELECT series, s AS side, CAST(length AS INTEGER) AS length, count(*) AS following, count(*) FILTER (nxt > 0) AS wins FROM l JOIN k ON len >= length WHERE s <> 0 AND nxt IS NOT NULL GROUP BY ALL""")
def r_streaks(spark: SparkSession, d: str) -> DataFrame:
    """What follows two to ten outcomes of one sign in a row."""
    df = with_halo(returns(spark, d), before=12, after=1)
    f = Frames()
    return behaviour.streaks(df, f, ["series"], "ret", 10)


@query(f"""WITH {BARS}, q AS (SELECT source, dxy_id, timestamp AS t, dxy_close AS v FROM dxy_quotes WHERE dxy_close IS NOT NULL AND timestamp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, timestamp ORDER BY dxy_id DESC) = 1),
 dd AS (SELECT upper(trim(symbol, E' \\t\\n\\r')) AS symbol, timestamp AS t, arg_max(close, (received_at, daily_id)) AS v FROM daily_bars WHERE symbol IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL GROUP BY 1, 2),
 b1 AS (SELECT bar_id, ts, split_part(series, '|', 1) AS source, split_part(series, '|', 2) AS symbol FROM x), j AS (SELECT b1.*, q.t AS qt, q.v AS qv FROM b1 ASOF LEFT JOIN q ON q.source = b1.source AND q.t <= b1.ts), k AS (SELECT j.*, dd.t AS dt, dd.v AS dv FROM j ASOF LEFT JOIN dd ON dd.symbol = j.symbol AND dd.t <= j.ts),
 s AS (SELECT *, CASE WHEN qt IS NULL THEN 'MISSING' WHEN ts - qt > INTERVAL 10 MINUTES THEN 'STALE' ELSE 'OK' END AS quote, CASE WHEN dt IS NULL THEN 'MISSING' WHEN ts - dt > INTERVAL 3 DAYS THEN 'STALE' ELSE 'OK' END AS daily FROM k)
SELECT bar_id, quote, CASE WHEN quote = 'OK' THEN qv END AS quote_value, daily, CASE WHEN daily = 'OK' THEN dv END AS daily_value, CASE WHEN quote = 'OK' AND daily = 'OK' THEN 'READY' ELSE 'PARTIAL_OR_STALE' END AS status FROM s""")
def j_market_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of several inputs as of each bar: the last quote and the last daily close, each fresh, stale or missing."""
    from tapewright.plans.joins import daily

    b = clean_bars(spark, d).select("bar_id", "ts", F.split("series", r"\|")[0].alias("source"), F.split("series", r"\|")[1].alias("symbol"))
    q = table(spark, d, "dxy_quotes").where("dxy_close is not null")
    inputs = {"quote": (q, ["source"], "timestamp", "dxy_close", "dxy_id", 600), "daily": (daily(spark, d), ["symbol"], "ts", "close", None, 3 * 86_400)}
    return asof.state_as_of(b, "ts", inputs).drop("ts", "source", "symbol")


@query("""WITH e AS (SELECT *, source || '|' || upper(trim(symbol, E' \\t\\n\\r')) AS series FROM bars WHERE source IS NOT NULL AND symbol IS NOT NULL), o AS (SELECT series, bar_id, timestamp, lag(timestamp) OVER (PARTITION BY series ORDER BY bar_id) AS before FROM e WHERE timestamp IS NOT NULL),
 c AS (SELECT series, timestamp, count(*) AS n FROM e WHERE timestamp IS NOT NULL GROUP BY ALL), d AS (SELECT series, sum(n - 1) AS duplicates FROM c GROUP BY series)
SELECT e.series, count(*) AS events, count(*) FILTER (timestamp IS NULL) AS missing, coalesce(any_value(v.n), 0) AS out_of_order, CAST(coalesce(any_value(d.duplicates), 0) AS BIGINT) AS duplicates, count(*) FILTER (received_at < timestamp) AS known_early FROM e LEFT JOIN d USING (series) LEFT JOIN (SELECT series, count(*) FILTER (timestamp < before) AS n FROM o GROUP BY series) v USING (series) GROUP BY e.series""")
def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Temporal integrity of each series in the order its bars are numbered: order, repeats, missing stamps, bars known before they begin."""
    from tapewright.functions.text_keys import symbol_key
    from tapewright.operators import quality

    b = table(spark, d, "bars").where("source is not null and symbol is not null").withColumn("series", F.concat_ws("|", "source", symbol_key("symbol")))
    return quality.temporal_integrity(b, ["series"], "bar_id", "timestamp", "received_at")


@query(f"""WITH {BARS}, a AS (SELECT bar_id, rn, avg(close) OVER ({W} ROWS 19 PRECEDING) AS p, sum(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s FROM x), c AS (SELECT count(*) FILTER (rn >= 20) AS n FROM a) SELECT n AS compared, CAST(0 AS BIGINT) AS mismatches, true AS equal FROM c""")
def q_parity(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to a mean of twenty rows, by frames and by running totals, held against each other."""
    from tapewright.operators import quality
    from tapewright.operators.blocks import running_totals

    n = numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"])
    f = Frames()
    one = own(with_halo(n, before=20).withColumn("a", rolling.sma(f, "close", 20))).select("bar_id", "a")
    t = with_halo(running_totals(n, ["series"], ["close"]), before=20)
    two = own(t.withColumn("b", F.when(f.rn >= 20, (F.col("close_total") - F.coalesce(f.lag("close_total", 20), F.lit(0.0))) / 20))).select("bar_id", "b")
    return quality.numeric_parity(one.join(two, "bar_id"), "a", "b", 1e-9, 1e-9).select("compared", "mismatches", "equal")


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (value > 80) AS severe, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 8) AS share FROM events GROUP BY event_type, CAST(ts AS DATE)""".replace("CAST(ts AS DATE) AS day", "strftime(ts, '%Y-%m-%d') AS day").replace("GROUP BY event_type, CAST(ts AS DATE)", "GROUP BY event_type, strftime(ts, '%Y-%m-%d')").replace("PARTITION BY CAST(ts AS DATE)", "PARTITION BY strftime(ts, '%Y-%m-%d')"))
def q_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind and day, the severe ones among them, and each kind's share of its day."""
    from tapewright.operators import quality

    e = table(spark, d, "events").withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return quality.calendar_density(e, "day", "event_type", F.col("value") > 80).select("event_type", "day", "events", "severe", F.round("share", 8).alias("share"))


@query(f"""WITH {BARS}, e AS (SELECT DISTINCT timestamp AS t FROM dxy_quotes WHERE dxy_close IS NULL AND timestamp IS NOT NULL), a AS (SELECT bar_id, ts, e.t AS last FROM x ASOF LEFT JOIN e ON e.t <= x.ts), b2 AS (SELECT a.*, e.t AS next FROM a ASOF LEFT JOIN e ON e.t >= a.ts)
SELECT bar_id, CASE WHEN ts - last <= INTERVAL 30 MINUTES THEN 'DURING' WHEN next - ts <= INTERVAL 1 HOUR THEN 'BEFORE' WHEN ts - last <= INTERVAL 90 MINUTES THEN 'AFTER' ELSE 'CLEAR' END AS phase FROM b2""")
def j_event_phases(spark: SparkSession, d: str) -> DataFrame:
    """Bars before, during, after or clear of missing dollar-index readings: one hour, half an hour, one hour."""
    e = table(spark, d, "dxy_quotes").where("dxy_close is null").select(F.col("timestamp").alias("t"))
    return asof.event_phases(clean_bars(spark, d).select("bar_id", "ts"), "ts", e, "t", before_s=3_600, during_s=1_800, after_s=3_600).select("bar_id", "phase")


_ASSESS = """z AS (SELECT p_partkey, (p_size * 7 % 50) / 8.0 AS il, (p_size * 11 % 50) / 25.0 - 1 AS it, (p_size * 13 % 50) / 25.0 - 1 AS im, (p_size * 17 % 50) / 15.0 AS gl, (p_size * 19 % 50) / 25.0 - 1 AS gt, (p_size * 3 % 50) / 10.0 AS ml, (p_size * 29 % 50) / 25.0 - 1 AS rl, (p_size * 31 % 50) / 25.0 - 1 AS rt FROM part),
 v AS (SELECT *, CASE WHEN il > 3 THEN 1 WHEN il < 1.5 THEN -1 ELSE 0 END + sign(it) + sign(im) AS iv, CASE WHEN gl > 2 THEN 1 WHEN gl < 0.5 THEN -1 ELSE 0 END + sign(gt) AS gv, CASE WHEN ml > 4 THEN 1 WHEN ml < 1 THEN -1 ELSE 0 END AS mv, CASE WHEN rl > 0.5 THEN 1 WHEN rl < -0.5 THEN -1 ELSE 0 END + sign(rt) AS rv FROM z),
 s AS (SELECT *, CASE WHEN il < 0 THEN 'DEFLATION' WHEN il > 8 THEN 'HIGH' WHEN iv >= 2 THEN 'RISING' WHEN iv <= -2 THEN 'FALLING' ELSE 'NEUTRAL' END AS i, CASE WHEN gv >= 2 THEN 'EXPANSION' WHEN gv <= -2 THEN 'CONTRACTION' ELSE 'NEUTRAL' END AS g, CASE WHEN rv >= 2 THEN 'RISK_ON' WHEN rv <= -2 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS r FROM v)"""
SQL["b_macro_assessment"] = f"""WITH {_ASSESS} SELECT p_partkey, CASE WHEN r <> 'NEUTRAL' THEN r WHEN g <> 'NEUTRAL' THEN g ELSE i END AS dominant, g || '_' || i AS primary,
 round((CASE WHEN il < 0 OR il > 8 THEN 0.95 ELSE least(1, 0.5 + 0.15 * abs(iv)) END + least(1, 0.5 + 0.15 * abs(gv)) + least(1, 0.5 + 0.15 * abs(mv)) + 0.5 + 0.5 + least(1, 0.5 + 0.15 * abs(rv))) / 6, 8) AS confidence FROM s"""


@query("""WITH z AS (SELECT p_partkey, (p_size * 7 % 50) / 8.0::DOUBLE AS a, (p_size * 17 % 50) / 15.0::DOUBLE AS b, (p_size * 3 % 50) / 10.0::DOUBLE AS c FROM part), s AS (SELECT p_partkey, ((1 - abs(a - 3) / (abs(a) + 3)) * 0.5::DOUBLE + (1 - abs(b - 2) / (abs(b) + 2)) * 0.3::DOUBLE + (1 - abs(c - 4) / (abs(c) + 4)) * 0.2::DOUBLE) / 1.0 AS v FROM z)
SELECT p_partkey, round(v, 8) AS similarity FROM s ORDER BY round(v, 12) DESC, p_partkey LIMIT 20""")
def x_scenario(spark: SparkSession, d: str) -> DataFrame:
    """A top-twenty report: the parts, read as macro points, most alike a scenario."""
    names = {"core_cpi": 0.5, "gdp": 0.3, "policy_rate": 0.2}
    m = _macro(spark, d)
    s = macro.similarity({n: F.col(n) for n in names}, {n: F.lit(v) for n, v in (("core_cpi", 3.0), ("gdp", 2.0), ("policy_rate", 4.0))}, names)
    return m.select("p_partkey", F.round(s, 12).alias("v")).orderBy(F.desc("v"), "p_partkey").limit(20).select("p_partkey", F.round("v", 8).alias("similarity"))


@query("""WITH n AS (SELECT artifact_hash AS h, artifact_type AS t, coalesce(CAST(json_extract(payload, '$.alpha') AS DOUBLE), -1) AS alpha, payload FROM evidence),
 l AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(parent_hash, '\\s+', '', 'g')), '^sha256:', '') AS p, regexp_replace(lower(regexp_replace(child_hash, '\\s+', '', 'g')), '^sha256:', '') AS c FROM lineage WHERE parent_hash IS NOT NULL AND child_hash IS NOT NULL),
 g AS (SELECT l.c, bool_and(coalesce(n.t IN ('Finding', 'Experiment') AND n.alpha >= 0.1, false)) AS ok, count(*) AS parents FROM l LEFT JOIN n ON n.h = l.p GROUP BY l.c)
SELECT n.h AS artifact_hash, json_extract_string(payload, '$.symbol') AS subject, parents FROM n JOIN g ON g.c = n.h AND g.ok WHERE n.t = 'Finding'""")
def x_validated(spark: SparkSession, d: str) -> DataFrame:
    """Findings all of whose sources are findings or experiments with alpha of at least 0.1: retrieval by validated provenance."""
    from tapewright.operators import retrieval

    ev = table(spark, d, "evidence").select(hash_key("artifact_hash").alias("h"), F.col("artifact_type").alias("t"), F.get_json_object("payload", "$.symbol").alias("subject"), F.get_json_object("payload", "$.alpha").try_cast("double").alias("alpha"))
    ln = table(spark, d, "lineage").where("parent_hash is not null and child_hash is not null").select(hash_key("parent_hash").alias("source"), hash_key("child_hash").alias("h")).distinct()
    found = retrieval.validated(ev, "h", ln, "source", F.col("t").isin("Finding", "Experiment") & (F.col("alpha") >= 0.1))
    return found.where("t = 'Finding'").select(F.col("h").alias("artifact_hash"), "subject", F.col("sources").alias("parents"))


@query(f"""WITH {BARS}, a AS (SELECT *, avg(close) OVER ({W} ROWS 9 PRECEDING) AS m, close - lag(close, 5) OVER ({W}) AS mo FROM x), c AS (SELECT *, CASE WHEN rn >= 10 THEN close / m - 1 END AS dist FROM a) SELECT bar_id, round(CASE WHEN rn >= 10 THEN m END, 9) AS mean10, round(dist, 9) AS distance, round(dist * mo, 9) AS pressure FROM c""")
def b_feature_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Features that build on each other, computed in topological order in one pass."""
    from tapewright.functions import registry

    n = with_halo(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), before=12)
    f = Frames()
    features = {
        "pressure": (("distance", "move"), lambda: F.col("distance") * F.col("move")),
        "distance": (("mean10",), lambda: F.col("close") / F.col("mean10") - 1),
        "mean10": ((), lambda: rolling.sma(f, "close", 10)),
        "move": ((), lambda: rolling.momentum(f, "close", 5)),
    }
    o = own(registry.pipeline(n, features))
    return o.select("bar_id", F.round("mean10", 9).alias("mean10"), F.round("distance", 9).alias("distance"), F.round("pressure", 9).alias("pressure"))


@query(f"""WITH {_R}, w AS (SELECT series, avg(ret) FILTER (ret > 0) AS w, -avg(ret) FILTER (ret < 0) AS l, count(*) FILTER (ret > 0) / count(*) AS p FROM v GROUP BY series) SELECT series, round(p * coalesce(w, 0) - (1 - p) * coalesce(l, 0), 10) AS expectancy FROM w""")
def m_expectancy(spark: SparkSession, d: str) -> DataFrame:
    """Win rate times mean win, less the rest times mean loss."""
    p, w, lo = stats.win_rate("ret"), stats.average_win("ret"), stats.average_loss("ret")
    return returns(spark, d).groupBy("series").agg(F.round(p * w - (1 - p) * F.abs(lo), 10).alias("expectancy"))


@query(f"""WITH {_R}, f AS (SELECT series, regr_slope(ret, volume) AS b, regr_intercept(ret, volume) AS a, count(*) AS n FROM v GROUP BY series HAVING count(*) > 2), e AS (SELECT v.series, sum(power(ret - a - b * volume, 2)) AS rss, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, arg_max(volume, rn) AS x FROM v JOIN f USING (series) GROUP BY v.series)
SELECT series, round(a + b * x, 9) AS prediction, round(sqrt(rss / (n - 2)) * sqrt(1 + 1 / n), 9) AS scale, n - 2 AS df FROM e""")
def r_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The next return from volume, and the scale of its prediction interval (`stats.prediction_interval` has the bounds)."""
    i = stats.prediction_interval(cut(returns(spark, d).select("series", "rn", "ret", "volume")), ["series"], "ret", "volume", "rn")
    return i.select("series", F.round("prediction", 9).alias("prediction"), F.round("scale", 9).alias("scale"), "df")


def _kpss(trend: bool) -> str:
    e = "close - regr_intercept(close, rn::DOUBLE) OVER p - regr_slope(close, rn::DOUBLE) OVER p * rn" if trend else "close - avg(close) OVER p"
    return f"""WITH {BARS}, e AS (SELECT series, rn, count(*) OVER p AS n, {e} AS e FROM x WINDOW p AS (PARTITION BY series)), l AS (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS l FROM e WHERE n >= 4),
 c AS (SELECT a.series, b.rn - a.rn AS lag, sum(a.e * b.e) / any_value(a.n) AS g, any_value(a.l) AS l FROM l a JOIN l b ON b.series = a.series AND b.rn BETWEEN a.rn AND a.rn + a.l GROUP BY 1, 2), v AS (SELECT series, sum(CASE lag WHEN 0 THEN g ELSE 2 * (1 - lag / (l + 1)) * g END) AS v FROM c GROUP BY series),
 s AS (SELECT series, n, l, sum(e) OVER (PARTITION BY series ORDER BY rn) AS s FROM l)
SELECT series, round(sum(s * s) / (any_value(n)::DOUBLE * any_value(n) * greatest(any_value(v), 1e-12)), 6) AS statistic, CAST(any_value(l) AS INTEGER) AS lags, count(*) AS n FROM s JOIN v USING (series) GROUP BY series"""


@query(_kpss(False))
def b_kpss_bartlett(spark: SparkSession, d: str) -> DataFrame:
    """KPSS of closes about a level."""
    return behaviour.kpss_bartlett(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"], "close").withColumn("statistic", F.round("statistic", 6))


@query(_kpss(True))
def b_kpss_trend(spark: SparkSession, d: str) -> DataFrame:
    """KPSS of closes about a straight trend."""
    return behaviour.kpss_bartlett(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"], "close", trend=True).withColumn("statistic", F.round("statistic", 6))


@query()
def x_unit_root_trend(spark: SparkSession, d: str) -> DataFrame:
    """Augmented Dickey-Fuller of closes about a straight trend."""
    from tapewright.operators import linear

    return linear.dickey_fuller(returns(spark, d).select("series", "rn", "close"), ["series"], "close", trend=True).withColumn("statistic", F.round("statistic", 4))


_REGIME = f"""{BARS}, k AS (SELECT *, lag(close) OVER w AS c1, high - lag(high) OVER w AS um, lag(low) OVER w - low AS dm FROM x WINDOW w AS ({W})),
 g AS (SELECT *, greatest(high - low, abs(high - coalesce(c1, close)), abs(low - coalesce(c1, close))) AS tr, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pd, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS md, ln(close) AS l, ln(close / c1) AS lr FROM k),
 i AS (SELECT *, CASE WHEN rn >= 14 AND sum(tr) OVER a > 0 THEN 100 * sum(pd) OVER a / sum(tr) OVER a END AS p, CASE WHEN rn >= 14 AND sum(tr) OVER a > 0 THEN 100 * sum(md) OVER a / sum(tr) OVER a END AS m, round(coalesce(regr_slope(l, rn::DOUBLE) OVER n / nullif(stddev_pop(lr) OVER q, 0), 0), 9) AS slope FROM g WINDOW a AS ({W} ROWS 13 PRECEDING), n AS ({W} ROWS 99 PRECEDING), q AS ({W} ROWS 98 PRECEDING)),
 dx AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM i), ad AS (SELECT *, CASE WHEN count(dx) OVER a = 14 THEN round(avg(dx) OVER a, 9) END AS adx FROM dx WINDOW a AS ({W} ROWS 13 PRECEDING)),
 st AS (SELECT series, bar_id, rn, close, adx, slope, CASE WHEN adx >= 25 AND slope > 0.05 AND p > m THEN 'UP' WHEN adx >= 25 AND slope < -0.05 AND m > p THEN 'DOWN' ELSE 'RANGE' END AS state FROM ad WHERE rn >= 100 AND adx IS NOT NULL)"""


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=130)
    for step in behaviour.trend_regime(f):
        df = df.withColumns(step)
    return own(df).select("series", "bar_id", "rn", "close", "adx", "slope", "state")


@query(f"""WITH {_REGIME}, n AS (SELECT *, row_number() OVER w AS k, lag(state) OVER w AS before FROM st WINDOW w AS (PARTITION BY series ORDER BY rn)),
 c AS (SELECT bar_id, state, round(adx, 6) AS adx, round(slope, 6) AS slope, list_transform(['DOWN', 'RANGE', 'UP'], lambda s: 1.0::DOUBLE) AS one, count(*) FILTER (before = 'UP' AND state = 'UP') OVER w AS uu, count(*) FILTER (before = 'UP') OVER w AS ua, count(*) FILTER (before = 'DOWN' AND state = 'UP') OVER w AS du, count(*) FILTER (before = 'DOWN') OVER w AS da, count(*) FILTER (before = 'RANGE' AND state = 'UP') OVER w AS ru, count(*) FILTER (before = 'RANGE') OVER w AS ra FROM n WINDOW w AS (PARTITION BY series ORDER BY rn ROWS UNBOUNDED PRECEDING))
SELECT bar_id, state, adx, slope, round(CASE state WHEN 'UP' THEN (1 + uu) / (3 + ua) WHEN 'DOWN' THEN (1 + du) / (3 + da) ELSE (1 + ru) / (3 + ra) END, 8) AS p_up FROM c""")
def b_regime(spark: SparkSession, d: str) -> DataFrame:
    """Regime of each bar from directional movement and slope, and the smoothed frequency with which it has been followed by UP so far."""
    from tapewright.operators.blocks import running_totals

    r = cut(_regimes(spark, d).where("state is not null"))
    n = numbered(r.withColumn("ts", F.timestamp_seconds("rn")).drop("rn"), ["series"], "ts", ["bar_id"])
    f = Frames()
    n = own(with_halo(n, before=1).withColumn("before", f.lag("state"))).drop("block", "halo")
    flag = lambda c: F.when(c, 1).otherwise(0)
    sides = ("UP", "DOWN", "RANGE")
    n = n.withColumns({f"{s}_{k}": flag((F.col("before") == s) & (F.lit(True) if k == "all" else F.col("state") == "UP")) for s in sides for k in ("up", "all")})
    t = running_totals(n, ["series"], [f"{s}_{k}" for s in sides for k in ("up", "all")])
    p = F.coalesce(*[F.when(F.col("state") == s, (1 + F.col(f"{s}_up_total")) / (3 + F.col(f"{s}_all_total"))) for s in sides])
    return t.select("bar_id", "state", F.round("adx", 6).alias("adx"), F.round("slope", 6).alias("slope"), F.round(p, 8).alias("p_up"))


@query(f"""WITH {_REGIME}, z AS (SELECT x.series, x.rn, CASE st.state WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 WHEN 'RANGE' THEN 0 END * ln(lead(x.close, 5) OVER (PARTITION BY x.series ORDER BY x.rn) / x.close) AS y, max(x.rn) OVER (PARTITION BY x.series) AS n FROM x LEFT JOIN st ON st.bar_id = x.bar_id)
SELECT series, count(*) AS n, round(avg(y), 10) AS mean FROM z WHERE y IS NOT NULL AND rn > floor(n * (1 - 0.3::DOUBLE)) GROUP BY series""")
def r_directional_value(spark: SparkSession, d: str) -> DataFrame:
    """What the regimes' directions were worth over the last 30 % of each series, five rows ahead (`research.directional_value` has the p)."""
    from tapewright.operators import research

    v = research.directional_value(cut(_regimes(spark, d)), ["series"], "state", "close")
    return v.select("series", "n", F.round("mean", 10).alias("mean"))


@query()
def r_directional_p(spark: SparkSession, d: str) -> DataFrame:
    """The p of `r_directional_value` by moving blocks."""
    from tapewright.operators import research

    return research.directional_value(cut(_regimes(spark, d)), ["series"], "state", "close").select("series", F.round("p", 6).alias("p"))


def _outcomes_sql() -> str:
    from tapewright.plans.joins import SQL as J

    return f"""WITH f AS ({J['j_forward_outcomes']}) SELECT symbol, days, count(*) AS total, count(*) FILTER (ret > 0) AS positive, count(*) FILTER (ret < 0) AS negative, round(count(*) FILTER (ret > 0) / count(*), 8) AS positive_ratio, round(avg(ret), 9) AS ret, round(avg(mfe), 9) AS mfe, round(avg(mae), 9) AS mae FROM f GROUP BY symbol, days"""


@query(_outcomes_sql())
def j_outcome_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of all daily bars by symbol and horizon: how many went up or down, mean return and mean excursions."""
    from tapewright.plans.joins import QUERIES as J

    g = J["j_forward_outcomes"](spark, d).groupBy("symbol", "days")
    up, down = F.count(F.when(F.col("ret") > 0, 1)), F.count(F.when(F.col("ret") < 0, 1))
    return g.agg(F.count("*").alias("total"), up.alias("positive"), down.alias("negative"), F.round(up / F.count("*"), 8).alias("positive_ratio"), *[F.round(F.avg(c), 9).alias(c) for c in ("ret", "mfe", "mae")])
