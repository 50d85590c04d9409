"""Queries of the event-research operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.operators import linear, research
from tapewright.operators.blocks import numbered
from tapewright.plans.base import BARS, W, clean_bars
from tapewright.plans.measures import _next, returns
from tapewright.plans.models import _r
from tapewright.runtime import table

QUERIES, SQL = {}, {}
_R = f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""{_R}, c AS (SELECT bar_id, ret, series, hour(ts AT TIME ZONE 'UTC') AS h FROM v) SELECT bar_id FROM c WHERE ret > 0.0005 AND ret <= 0.01 AND h IN (8, 9, 10, 13, 14) AND series LIKE '%|XAUUSD'""".replace("ret > 0.0005", "ret >= 0.0005"))
def r_condition(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumns({"h": F.hour("ts"), "symbol": F.split("series", r"\|")[1]})
    return x.where(research.matches({"ret": (0.0005, 0.01), "h": [8, 9, 10, 13, 14], "symbol": "XAUUSD"}, x.columns)).select("bar_id")


@query()
def r_conditional(spark: SparkSession, d: str) -> DataFrame:
    """The next return after each sign of the present one, with bootstrap intervals."""
    return _r(research.conditional_statistics(_next(spark, d), ["series", "state"], "nxt", "state", "bar_id"), 10)


@query("""WITH o AS (SELECT o_orderdate AS day, round(o_totalprice, -4) AS amount, o_custkey FROM orders) SELECT epoch_us(day) AS day_us, amount AS low, amount AS high, CAST(count(DISTINCT o_custkey) AS INTEGER) AS people, count(*) AS rows FROM o GROUP BY day, amount HAVING count(DISTINCT o_custkey) >= 3""")
def r_batches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day_us"), F.round("o_totalprice", -4).alias("amount"), "o_custkey")
    return research.amount_batches(o, ["day_us"], "amount", "o_custkey")


@query()
def r_batches_tolerant(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day_us"), F.col("o_totalprice").alias("amount"), "o_custkey")
    return research.amount_batches(o, ["day_us"], "amount", "o_custkey", 3, 5_000.0)


@query(f"""WITH {BARS}, p AS (SELECT *, max(close) OVER (PARTITION BY series ORDER BY rn) AS peak FROM x), u AS (SELECT *, close < peak AS u, rn - row_number() OVER (PARTITION BY series, close < peak ORDER BY rn) AS g, max(rn) OVER (PARTITION BY series) AS last FROM p)
SELECT series, min(rn) AS start, max(rn) AS end, count(*) AS rows, round(min(close / peak - 1), 8) AS depth, max(rn) < any_value(last) AS recovered FROM u WHERE u GROUP BY series, g""")
def r_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    """Episodes below the running peak of closes."""
    n = numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]).withColumn("_b", F.floor(F.col("rn") / F.lit(100_000)))
    tops = n.groupBy("series", "_b").agg(F.max("close").alias("_m"))
    tops = tops.select("series", "_b", F.max("_m").over(Window.partitionBy("series").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    w = Window.partitionBy("series", "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    e = n.join(tops, ["series", "_b"]).withColumn("peak", F.greatest(F.max("close").over(w), F.col("_p"))).select("series", "rn", "close", "peak")
    return _r(research.drawdown_episodes(e, ["series"], "close"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).drop("rn")
    return research.regime_segments(numbered(r, ["series"], "ts", ["bar_id"]), ["series"], "ret")


@query()
def r_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query()
def r_segment_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _r(research.segment_transitions(_segments(spark, d), ["series"]))


@query(f"""WITH {BARS}, o AS (SELECT bar_id, ts, row_number() OVER (ORDER BY ts, bar_id) AS k FROM x), e AS (SELECT timestamp AS t FROM dxy_quotes WHERE dxy_close IS NULL AND timestamp IS NOT NULL), h AS (SELECT DISTINCT (SELECT max(k) FROM o WHERE o.ts <= e.t) AS k FROM e)
SELECT o.bar_id, bool_or(h.k IS NOT NULL) AS blocked FROM o LEFT JOIN h ON abs(o.k - h.k) <= 3 GROUP BY o.bar_id""".replace("(SELECT max(k) FROM o WHERE o.ts <= e.t)", "m.k").replace("FROM e)\n", "FROM e ASOF JOIN (SELECT ts, max(k) AS k FROM o GROUP BY ts) m ON m.ts <= e.t)\n"))
def r_near_events(spark: SparkSession, d: str) -> DataFrame:
    """Bars within three rows of a missing dollar-index reading."""
    b = clean_bars(spark, d).select("bar_id", "ts")
    e = table(spark, d, "dxy_quotes").where("dxy_close is null").select(F.col("timestamp").alias("t"))
    return research.near_events(b, e, "ts", "t", 3, ["bar_id"]).select("bar_id", "blocked")


@query(f"""WITH {BARS}, q AS (SELECT series, median(volume) AS m, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS i FROM x GROUP BY series) SELECT bar_id, CASE WHEN i > 0 THEN round((volume - m) / i, 6) ELSE 0 END AS scaled FROM x JOIN q USING (series)""")
def r_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return research.robust_scale(clean_bars(spark, d), ["series"], "volume", "scaled").select("bar_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH a AS (SELECT timestamp AS t, count(*) AS l FROM bars WHERE timestamp IS NOT NULL GROUP BY 1), b AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp AT TIME ZONE 'UTC', TIMESTAMP '1970-01-01') AT TIME ZONE 'UTC' AS t, count(*) AS r FROM dxy_quotes GROUP BY 1)
SELECT epoch_us(coalesce(a.t, b.t)) AS t_us, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM a FULL JOIN b ON a.t = b.t WHERE coalesce(l, 0) <> 1 OR coalesce(r, 0) <> 1""")
def r_misaligned(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "bars").where("timestamp is not null").select(F.unix_micros("timestamp").alias("t_us"))
    b = table(spark, d, "dxy_quotes").where("timestamp is not null").select((F.floor(F.unix_micros("timestamp") / F.lit(3_600_000_000)) * 3_600_000_000).alias("t_us"))
    return research.misaligned(a, b, ["t_us"])


@query(f"""{_R}, c AS (SELECT series, count(*) AS n, count(*) FILTER (ret > 0) AS u, count(*) FILTER (ret < 0) AS d, count(*) FILTER (ret = 0) AS z FROM v GROUP BY series) SELECT series, round(power(u - n * 0.49, 2) / (n * 0.49) + power(d - n * 0.49, 2) / (n * 0.49) + power(z - n * 0.02, 2) / (n * 0.02), 5) AS statistic, n * 0.02 >= 5 AS testable FROM c""")
def r_chi_square(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumn("s", F.signum("ret").cast("int"))
    return research.chi_square(x, ["series"], "s", {1: 0.49, -1: 0.49, 0: 0.02}).select("series", F.round("statistic", 5).alias("statistic"), "testable")


@query(f"""{_R}, f AS (SELECT series, regr_slope(ret, volume) AS b, regr_intercept(ret, volume) AS a FROM v GROUP BY series), e AS (SELECT series, power(ret - a - b * volume, 2) * 1e8 AS e2, volume FROM v JOIN f USING (series)) SELECT series, round(count(*) * regr_r2(e2, volume), 4) AS lm FROM e GROUP BY series""")
def r_heteroscedasticity(spark: SparkSession, d: str) -> DataFrame:
    return research.heteroscedasticity(returns(spark, d), ["series"], "ret", "volume").select("series", F.round("lm", 4).alias("lm"))


@query()
def r_cointegration(spark: SparkSession, d: str) -> DataFrame:
    """Closes on highs of the same series."""
    c = research.cointegration(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), ["series"], "close", "high")
    return c.select("series", F.round("slope", 5).alias("slope"), F.round("statistic", 4).alias("statistic"), "cointegrated")


@query()
def r_arma(spark: SparkSession, d: str) -> DataFrame:
    """ARMA of returns and ARIMA of closes."""
    r = returns(spark, d)
    a = research.arma(r, ["series"], "ret").withColumn("model", F.lit("arma(1,1)"))
    return _r(a.union(research.arma(r, ["series"], "close", d=1).withColumn("model", F.lit("arima(1,1,1)"))).drop("p"), 4)


@query()
def r_polynomial(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumns({f"v{i}": F.pow(F.log1p("volume") / 10, F.lit(float(i))) for i in (1, 2)})
    return _r(linear.regression(x, ["series"], "ret", ["v1", "v2"]).drop("p"), 5)


@query()
def r_reaction(spark: SparkSession, d: str) -> DataFrame:
    """How long volume reacts to large returns."""
    return _r(research.reaction_delay(returns(spark, d), ["series"], "ret", "volume"), 6)


@query()
def r_correlation_breaks(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).drop("rn")
    return _r(research.correlation_breaks(numbered(r, ["series"], "ts", ["bar_id"]), ["series"], "ret", "volume"), 6)


@query("""WITH a AS (SELECT artifact_hash AS h, artifact_type AS t FROM evidence), l AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(parent_hash, '\\s+', '', 'g')), '^sha256:', '') AS p, regexp_replace(lower(regexp_replace(child_hash, '\\s+', '', 'g')), '^sha256:', '') AS c FROM lineage WHERE parent_hash IS NOT NULL AND child_hash IS NOT NULL)
SELECT d.h AS dataset, e.h AS experiment, r.h AS run FROM a d JOIN l x ON x.p = d.h JOIN a e ON e.h = x.c AND e.t = 'Experiment' JOIN l y ON y.p = e.h JOIN a r ON r.h = y.c AND r.t = 'Run' WHERE d.t = 'Dataset'""")
def r_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains Dataset, Experiment, Run along the edges."""
    from tapewright.functions.text_keys import hash_key

    a = table(spark, d, "evidence").select(F.col("artifact_hash").alias("h"), F.col("artifact_type").alias("t"))
    ln = table(spark, d, "lineage").where("parent_hash is not null and child_hash is not null").select(hash_key("parent_hash").alias("p"), hash_key("child_hash").alias("c")).distinct()
    of = lambda t, n: a.where(F.col("t") == t).select(F.col("h").alias(n))
    x = of("Dataset", "dataset").join(ln.toDF("dataset", "experiment"), "dataset").join(of("Experiment", "experiment"), "experiment", "left_semi")
    return x.join(ln.toDF("experiment", "run"), "experiment").join(of("Run", "run"), "run", "left_semi").select("dataset", "experiment", "run")
