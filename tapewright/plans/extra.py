"""Queries of behaviour, probability, macro and registry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import registry
from tapewright.operators import behaviour, chance, macro, rolling
from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.plans.base import BARS, W, clean_bars, framed_bars, own
from tapewright.plans.measures import _next, returns
from tapewright.plans.models import _r
from tapewright.runtime import cut, table

QUERIES, SQL = {}, {}
_R = f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""{_R}, e AS (SELECT series, rn, abs(ret) - avg(abs(ret)) OVER (PARTITION BY series) AS a, ret * ret - avg(ret * ret) OVER (PARTITION BY series) AS q FROM v), l AS (SELECT *, lag(a) OVER (PARTITION BY series ORDER BY rn) AS a1, lag(q) OVER (PARTITION BY series ORDER BY rn) AS q1 FROM e)
SELECT series, round(sum(a * a1) / sum(a * a), 6) AS acf_abs, round(sum(q * q1) / sum(q * q), 6) AS acf_sq FROM l GROUP BY series""")
def b_clustering(spark: SparkSession, d: str) -> DataFrame:
    return _r(behaviour.volatility_clustering(returns(spark, d), ["series"], "ret"), 6)


@query(f"""{_R}, s AS (SELECT series, rn, CASE WHEN count(*) OVER a = 10 AND rn >= 11 THEN sum(ret) OVER a END AS a, CASE WHEN count(*) OVER b = 10 THEN sum(ret) OVER b END AS b, lead(ret) OVER (PARTITION BY series ORDER BY rn) AS n FROM v
  WINDOW a AS (PARTITION BY series ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT series, round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (sign(round(a, 12)) = sign(round(b, 12)))::INT END), 6) AS trend, round(avg(CASE WHEN abs(a) > 0.001 AND n IS NOT NULL THEN (sign(a) = -sign(n))::INT END), 6) AS reversion FROM s GROUP BY series""")
def b_persistence(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).drop("rn")
    return _r(behaviour.persistence(numbered(r, ["series"], "ts", ["bar_id"]), ["series"], "ret"), 6)


@query(f"""WITH {BARS}, s AS (SELECT series, rn, max(high) OVER w AS h, min(low) OVER w AS l, lead(close) OVER ({W}) AS n FROM x WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series, round(avg((n > h)::INT), 8) AS up, round(avg((n < l)::INT), 8) AS down FROM s WHERE rn >= 20 AND n IS NOT NULL GROUP BY series""")
def b_breakouts(spark: SparkSession, d: str) -> DataFrame:
    return _r(behaviour.breakouts(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"]))


@query(f"""WITH {BARS}, s AS (SELECT series, rn, sum(close) OVER (PARTITION BY series ORDER BY rn) AS t, count(*) OVER (PARTITION BY series) AS n, sum(close) OVER (PARTITION BY series) AS a, stddev_samp(close) OVER (PARTITION BY series) AS sd FROM x),
 z AS (SELECT series, rn, abs(t / rn - (a - t) / (n - rn)) / (sd * sqrt(1 / rn + 1 / (n - rn))) AS z FROM s WHERE rn >= n // 4 AND rn < 3 * n // 4 AND rn > 0 AND sd > 0) SELECT series, arg_max(rn, round(z, 9)) AS at, round(max(z), 6) AS statistic, max(z) > 2 AS broken FROM z GROUP BY series""")
def b_mean_shift(spark: SparkSession, d: str) -> DataFrame:
    return _r(behaviour.mean_shift(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"], "close"), 6)


@query(f"""WITH {BARS}, e AS (SELECT series, rn, close - avg(close) OVER (PARTITION BY series) AS e FROM x), s AS (SELECT series, e, sum(e) OVER (PARTITION BY series ORDER BY rn) AS s FROM e)
SELECT series, round((sum(s * s) / (count(*) * count(*))) / (sum(e * e) / count(*)), 5) AS statistic FROM s GROUP BY series""")
def b_kpss(spark: SparkSession, d: str) -> DataFrame:
    return _r(behaviour.kpss(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"], "close"), 5)


@query()
def b_volume_profile(spark: SparkSession, d: str) -> DataFrame:
    b = clean_bars(spark, d).withColumn("scaled", F.col("close") / F.pow(F.lit(10.0), F.floor(F.log10("close"))))
    return _r(behaviour.volume_profile(b, ["series"], "scaled", "volume", 0.005), 4)


@query(f"""WITH {BARS}, m AS (SELECT *, abs(close - lag(close) OVER ({W})) AS mv FROM x), s AS (SELECT bar_id, rn, close, lag(close, 10) OVER ({W}) AS p, sum(mv) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS path FROM m)
SELECT bar_id, CASE WHEN rn <= 10 THEN 'WARMUP' WHEN path > 0 AND round(abs(close - p) / path, 9) >= 0.4 AND round(abs(close - p) / p * 1e4, 9) >= 2 THEN CASE WHEN close > p THEN 'UP' ELSE 'DOWN' END ELSE 'RANGE' END AS state FROM s""")
def b_efficiency(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=11)
    df = df.withColumn("mv", F.abs(F.col("close") - f.lag("close")))
    return own(df.withColumn("state", behaviour.efficiency_state(f, "close", "mv"))).select("bar_id", "state")


@query(f"""WITH {BARS}, s AS (SELECT bar_id, rn, high, low, max(high) OVER p AS hi, min(low) OVER p AS lo, min(close) OVER n AS a, max(close) OVER n AS z FROM x WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), n AS ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT bar_id, CASE WHEN high > hi AND a < hi THEN 'ABOVE' ELSE 'BELOW' END AS side FROM s WHERE rn > 20 AND ((high > hi AND a < hi) OR (low < lo AND z > lo))""")
def b_sweeps(spark: SparkSession, d: str) -> DataFrame:
    df, f = framed_bars(spark, d, before=21, after=4)
    return own(df.withColumn("side", behaviour.sweeps(f))).where("side is not null").select("bar_id", "side")


@query(f"""WITH {BARS}, t AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1000000::BIGINT * CASE timeframe WHEN 'M5' THEN 300 WHEN 'M15' THEN 900 ELSE 3600 END)::INT, 0) AS gap FROM x WINDOW w AS ({W})),
 s AS (SELECT bar_id, rn, close - lag(close, 8) OVER ({W}) AS mv, avg(tr) OVER ({W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m, sum(gap) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS g FROM t)
SELECT bar_id, round(mv / m, 6) AS score FROM s WHERE rn > 8 AND g = 0 AND m > 0""")
def b_causal_score(spark: SparkSession, d: str) -> DataFrame:
    from tapewright.functions.scalars import timeframe_seconds

    df, f = framed_bars(spark, d, before=10)
    df = df.withColumns({"tr": rolling.true_range(f), "gap": F.coalesce((F.unix_micros("ts") - F.unix_micros(f.lag("ts")) > timeframe_seconds("timeframe") * F.lit(1_000_000).cast("bigint")).cast("int"), F.lit(0))})
    return own(df.withColumn("score", behaviour.causal_score(f, "tr", "gap"))).where("score is not null").select("bar_id", F.round("score", 6).alias("score"))


@query()
def b_footprint(spark: SparkSession, d: str) -> DataFrame:
    """Aggression and progress per window of twelve bars, and tests of absorption."""
    df, f = framed_bars(spark, d, before=13)
    df = own(df.withColumns({"up": F.sum(F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(-F.col("volume"))).over(f.last(12)), "all": F.sum("volume").over(f.last(12)), "prog": (F.col("close") - f.lag("close", 12)) / F.when(F.stddev_samp("close").over(f.last(12)) > 0, F.stddev_samp("close").over(f.last(12)))})).where("rn % 12 = 0 and all > 0 and prog is not null")
    share = F.col("up") / F.col("all")
    w = df.select("series", "bar_id", "rn", (F.col("rn") + 12).alias("stop"), behaviour.footprint_state(share, F.col("prog")).alias("state"), F.signum("up").cast("int").alias("sign"))
    return behaviour.absorption_tests(w, ["series"], "rn", "stop", "state", "sign", ["series", "bar_id", "state"])


@query()
def b_flow_imbalance(spark: SparkSession, d: str) -> DataFrame:
    """Best-level imbalance of bars read as quotes: low and high with volumes."""
    df, f = framed_bars(spark, d, before=1)
    return own(df.withColumn("ofi", behaviour.order_flow_imbalance(f, "low", "volume", "high", "volume"))).select("bar_id", F.round("ofi", 4).alias("ofi"))


@query(f"""{_R}, p AS (SELECT series, count(*) FILTER (ret > 0) AS k, count(*) FILTER (ret <= 0) AS f, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS s FROM v GROUP BY series)
SELECT series, round((k + 1) / (n + 2), 8) AS mean, round((k + 1) * (f + 1) / (power(n + 2, 2) * (n + 3)), 10) AS variance, round(mu, 10) AS mu, round(s, 10) AS sigma, round(-n / 2 * (ln(2 * pi() * s * s) + 1), 5) AS log_likelihood FROM p""")
def b_posteriors(spark: SparkSession, d: str) -> DataFrame:
    g = returns(spark, d).groupBy("series").agg(F.count(F.when(F.col("ret") > 0, 1)).alias("k"), F.count(F.when(F.col("ret") <= 0, 1)).alias("f"), *[c.alias(n) for n, c in chance.normal_fit("ret").items()])
    b = chance.beta_posterior(F.col("k"), F.col("f"))
    return g.select("series", F.round(b["mean"], 8).alias("mean"), F.round(b["variance"], 10).alias("variance"), F.round("mu", 10).alias("mu"), F.round("sigma", 10).alias("sigma"), F.round("log_likelihood", 5).alias("log_likelihood"))


@query()
def b_student(spark: SparkSession, d: str) -> DataFrame:
    return chance.student_fit(returns(spark, d), ["series"], "ret").select("series", "df", F.round("scale", 6).alias("scale"), F.round("log_likelihood", 5).alias("log_likelihood"))


@query()
def b_density(spark: SparkSession, d: str) -> DataFrame:
    return _r(chance.kernel_density(returns(spark, d), ["series"], "ret", [-0.002, -0.001, 0.0, 0.001, 0.002]), 5)


@query()
def b_hidden_states(spark: SparkSession, d: str) -> DataFrame:
    """Filtered calm and stormy states from the size of returns."""
    o = returns(spark, d).withColumn("o", F.when(F.abs("ret") > 0.001, 1).otherwise(0))
    return _r(chance.hidden_states(o, ["series"], ["rn"], "o", ["bar_id"], [0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], [[0.9, 0.1], [0.4, 0.6]]), 8)


@query()
def b_recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores of a score as it is, after isotonic steps, after a temperature, and after a logistic fit."""
    x = cut(_next(spark, d).select((1 / (1 + F.exp(-800 * F.col("ret")))).alias("p"), (F.col("nxt") > 0).cast("double").alias("y"), "ret"))
    steps, t, (a, b_) = chance.isotonic_steps(x, "p", "y"), chance.temperature(x, "p", "y"), chance.platt(x, "p", "y")
    x = x.withColumns({"iso": chance.apply_steps(F.col("p"), steps), "tem": 1 / (1 + F.exp(-800 * F.col("ret") / t)), "platt": 1 / (1 + F.exp(-(a + b_ * 800 * F.col("ret"))))})
    b = lambda c: F.round(F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2.0))), 8).alias(c)
    return x.agg(b("p"), b("iso"), b("tem"), b("platt"))


def _macro(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    z = lambda k, m: (F.col("p_size") * k % 50) / m
    return p.select("p_partkey", z(7, 8.0).alias("core_cpi"), (z(11, 25.0) - 1).alias("core_cpi_trend"), (z(13, 25.0) - 1).alias("core_cpi_momentum"), z(17, 15.0).alias("gdp"), (z(19, 25.0) - 1).alias("gdp_trend"), z(3, 10.0).alias("policy_rate"), (z(29, 25.0) - 1).alias("risk_index"), (z(31, 25.0) - 1).alias("risk_index_trend"))


@query("""WITH z AS (SELECT p_partkey, (p_size * 7 % 50) / 8.0 AS l, (p_size * 11 % 50) / 25.0 - 1 AS t, (p_size * 13 % 50) / 25.0 - 1 AS m FROM part), v AS (SELECT *, CASE WHEN l > 3 THEN 1 WHEN l < 1.5 THEN -1 ELSE 0 END + sign(t) + sign(m) AS s FROM z)
SELECT p_partkey, CASE WHEN l < 0 THEN 'DEFLATION' WHEN l > 8 THEN 'HIGH' WHEN s >= 2 THEN 'RISING' WHEN s <= -2 THEN 'FALLING' ELSE 'NEUTRAL' END AS inflation, round(least(1, 0.5 + 0.15 * abs(s)), 8) AS inflation_confidence FROM v""")
def b_inflation(spark: SparkSession, d: str) -> DataFrame:
    m = macro.detect(_macro(spark, d), ["inflation"])
    return m.select("p_partkey", "inflation", F.round("inflation_confidence", 8).alias("inflation_confidence"))


@query()
def b_macro_assessment(spark: SparkSession, d: str) -> DataFrame:
    return _r(macro.assess(_macro(spark, d)).select("p_partkey", "dominant", "primary", "confidence"))


@query("""WITH o AS (SELECT c_mktsegment AS ticker, o_custkey AS person, o_orderdate AS e, o_orderdate + INTERVAL 2 DAYS AS u FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT ticker, count(DISTINCT person) AS people, count(*) AS rows, count(DISTINCT person) >= 3 AS clustered FROM o WHERE u <= TIMESTAMP '1998-06-01' AND e <= TIMESTAMP '1998-06-01' AND e > TIMESTAMP '1998-06-01' - INTERVAL 60 DAYS GROUP BY ticker""")
def b_clustered_people(spark: SparkSession, d: str) -> DataFrame:
    """Distinct people per ticker in the 60 days before a date, known by then."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    r = o.select(F.col("c_mktsegment").alias("ticker"), F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("timestamp").alias("e")).withColumn("u", F.expr("e + interval 2 days"))
    return macro.clusters_in_window(r, "ticker", "person", "e", "u", F.lit("1998-06-01 00:00:00").cast("timestamp"))


@query(f"""WITH {BARS} SELECT bar_id, CASE WHEN rn >= 10 THEN round(avg(close) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 0.0000023, 5) END AS sma_period10, CASE WHEN rn > 5 THEN round(close - lag(close, 5) OVER ({W}), 6) END AS momentum_period5 FROM x""")
def b_registry(spark: SparkSession, d: str) -> DataFrame:
    """A batch of named specifications in one projection."""
    b = registry.compute(clean_bars(spark, d), [("sma", {"period": 10}), ("momentum", {"period": 5}), ("bollinger", {}), ("donchian", {"period": 30})])
    return b.select("bar_id", F.round(F.col("sma_period10") + 0.0000023, 5).alias("sma_period10"), F.round("momentum_period5", 6).alias("momentum_period5"))


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS events FROM (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s""")
def b_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows that close after six hours without events."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


@query(f"""WITH {BARS}, k AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM x), l AS (SELECT *, s - lag(s) OVER ({W}) AS dt FROM k) SELECT bar_id, round(CASE WHEN dt = lag(dt) OVER ({W}) THEN ln(close / lag(close) OVER ({W})) / dt END * 1e6, 6) AS velocity FROM l""")
def b_kinetics(spark: SparkSession, d: str) -> DataFrame:
    """Log velocity where the spacing of rows is steady, in millionths a second."""
    df = with_halo(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), before=3)
    f = Frames()
    df = df.withColumn("dt", F.unix_seconds("ts") - F.unix_seconds(f.lag("ts")))
    return own(df.withColumns(behaviour.kinetics(f, "close", "dt"))).select("bar_id", F.round(F.col("velocity") * 1e6, 6).alias("velocity"))
