"""Queries of data quality, splits and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import scalars
from tapewright.functions.text_keys import symbol_key
from tapewright.operators import quality, splits
from tapewright.plans.base import BARS, clean_bars
from tapewright.plans.joins import daily
from tapewright.runtime import table

QUERIES, SQL = {}, {}
_RAW = """z AS (SELECT bar_id, source, upper(trim(symbol, E' \\t\\n\\r')) AS symbol, timestamp AS ts, CASE timeframe WHEN 'M5' THEN 300 WHEN 'M15' THEN 900 WHEN 'H1' THEN 3600 END AS p, open, high, low, close, volume FROM bars)"""


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bars").select("bar_id", "source", symbol_key("symbol").alias("symbol"), F.col("timestamp").alias("ts"), "timeframe", "open", "high", "low", "close", "volume")




def _period():  # noqa: ANN202
    return scalars.timeframe_seconds("timeframe")


_K = ["source", "symbol"]


@query(f"""WITH {_RAW}, l AS (SELECT *, lag(ts) OVER (PARTITION BY source, symbol ORDER BY ts, bar_id) AS prev FROM z WHERE ts IS NOT NULL)
SELECT source, symbol, epoch_us(prev) AS from_us, epoch_us(ts) AS to_us, CAST(round_even((epoch_us(ts) - epoch_us(prev)) / 1e6 / p, 0) - 1 AS BIGINT) AS missing FROM l WHERE (epoch_us(ts) - epoch_us(prev)) / 1e6 > p""")
def q_gaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.gaps(_bars(spark, d), _K, "ts", _period(), ["bar_id"]).select(*_K, F.unix_micros("from").alias("from_us"), F.unix_micros("to").alias("to_us"), "missing")


@query(f"""WITH {_RAW}, l AS (SELECT *, lag(ts) OVER (PARTITION BY source, symbol ORDER BY ts, bar_id) AS prev FROM z WHERE ts IS NOT NULL)
SELECT source, symbol, unnest(range(epoch_us(prev) + p::BIGINT * 1000000, epoch_us(ts) - 60000000, p::BIGINT * 1000000)) AS expected_us FROM l WHERE prev IS NOT NULL""")
def q_missing(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_periods(_bars(spark, d), _K, "ts", _period(), ["bar_id"]).select(*_K, F.unix_micros("expected").alias("expected_us"))


@query(f"""WITH {_RAW}, f AS (SELECT source, symbol, ts, min(bar_id) AS first FROM z WHERE ts IS NOT NULL GROUP BY ALL) SELECT f.first, z.bar_id AS duplicate FROM z JOIN f USING (source, symbol, ts) WHERE z.bar_id > f.first""")
def q_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(_bars(spark, d).where("ts is not null"), [*_K, "ts"], "bar_id").select("first", "duplicate")


@query(f"""WITH {BARS}, g AS (SELECT series, avg(close) AS m, stddev_pop(close) AS s FROM x GROUP BY 1 HAVING count(*) >= 4) SELECT bar_id, round((close - m) / s, 5) AS z FROM x JOIN g USING (series) WHERE s > 0 AND abs((close - m) / s) > 2""")
def q_price_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.price_outliers(clean_bars(spark, d), ["series"], "close", "bar_id", 2.0).select("bar_id", F.round("z", 5).alias("z"))


@query(f"""WITH {BARS}, o AS (SELECT series, volume, row_number() OVER (PARTITION BY series ORDER BY volume) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM x), q AS (SELECT series, max(volume) FILTER (i = n // 4) AS q1, max(volume) FILTER (i = 3 * n // 4) AS q3 FROM o GROUP BY series)
SELECT bar_id, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high FROM x JOIN q USING (series) WHERE volume < q1 - 1.5 * (q3 - q1) OR volume > q3 + 1.5 * (q3 - q1)""")
def q_volume_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.volume_outliers(clean_bars(spark, d), ["series"], "volume", "bar_id").select("bar_id", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"""WITH {_RAW}, v AS (SELECT *, coalesce(open > 0 AND NOT isnan(open) AND high > 0 AND NOT isnan(high) AND low > 0 AND NOT isnan(low) AND close > 0 AND NOT isnan(close) AND high >= greatest(open, close, low) AND low <= least(open, close) AND coalesce(volume >= 0 AND NOT isnan(volume), true), false) AS ok FROM z),
 b AS (SELECT source, symbol, count(*) AS rows, count(*) FILTER (ok) AS valid, count(DISTINCT CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS days FROM v GROUP BY ALL), du AS (SELECT source, symbol, sum(k) AS duplicates FROM (SELECT source, symbol, ts, count(*) - 1 AS k FROM z WHERE ts IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY source, symbol ORDER BY ts, bar_id) AS prev FROM z WHERE ts IS NOT NULL), g AS (SELECT source, symbol, count(*) AS gaps, sum(round_even((epoch_us(ts) - epoch_us(prev)) / 1e6 / p, 0) - 1) AS missing FROM l WHERE (epoch_us(ts) - epoch_us(prev)) / 1e6 > p GROUP BY ALL)
SELECT source, symbol, rows, valid, days, CAST(coalesce(duplicates, 0) AS BIGINT) AS duplicates, coalesce(gaps, 0) AS gaps, CAST(coalesce(missing, 0) AS BIGINT) AS missing,
 round(greatest(0, least(1, valid / rows - least(coalesce(missing, 0) / (rows + coalesce(missing, 0)), 0.3) - least(coalesce(duplicates, 0) / rows, 0.2) - least(coalesce(gaps, 0) / rows, 0.1))), 8) AS score FROM b LEFT JOIN du USING (source, symbol) LEFT JOIN g USING (source, symbol)""")
def q_report(spark: SparkSession, d: str) -> DataFrame:
    r = quality.quality_report(_bars(spark, d), _K, "ts", _period(), "bar_id")
    return r.select(*_K, "rows", "valid", "days", "duplicates", "gaps", "missing", F.round("score", 8).alias("score"))


@query(f"""WITH {BARS} SELECT bar_id, round((high + low + close) / 3, 5) AS typical, round(high - greatest(open, close), 6) AS upper, round(least(open, close) - low, 6) AS lower, round(abs(close - open), 6) AS body,
  CASE WHEN hour(ts AT TIME ZONE 'UTC') < 7 THEN 'ASIA' WHEN hour(ts AT TIME ZONE 'UTC') < 13 THEN 'LONDON' WHEN hour(ts AT TIME ZONE 'UTC') < 22 THEN 'NEW_YORK_OVERLAP' ELSE 'ROLLOVER' END AS session, epoch_us(ts) // 14400000000 * 14400000000 AS floor_us,
  round(2 * (((open - low) * 0) + (close - open)) , 6) AS twice_body, round(1e4 * (high - low) / ((high + low) / 2), 6) AS range_bps FROM x""")
def q_bar_scalars(spark: SparkSession, d: str) -> DataFrame:
    b = clean_bars(spark, d)
    return b.select("bar_id", F.round(scalars.typical_price(), 5).alias("typical"), F.round(scalars.upper_wick(), 6).alias("upper"), F.round(scalars.lower_wick(), 6).alias("lower"), F.round(scalars.body(), 6).alias("body"), scalars.session("ts").alias("session"), F.unix_micros(scalars.floor_time("ts", 14_400)).alias("floor_us"), F.round(2 * (F.col("close") - F.col("open")), 6).alias("twice_body"), F.round(scalars.spread_bps("low", "high"), 6).alias("range_bps"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s%$.-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS w FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('beat', 'surge', 'gain', 'growth', 'improve', 'strong', 'rise', 'up', 'positive', 'exceeds', 'record', 'boost', 'rally'))) AS p,
  len(list_filter(w, lambda x: x IN ('miss', 'fall', 'drop', 'decline', 'weak', 'slow', 'downgrade', 'loss', 'cut', 'negative', 'below', 'fear', 'plunge', 'slump'))) AS n FROM t) SELECT doc_id, round((p - n) / greatest(p + n, 1), 8) AS sentiment FROM s""")
def q_sentiment(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.round(scalars.keyword_sentiment("text"), 8).alias("sentiment"))


@query("""SELECT p_partkey, round((p_retailprice - 1000) / 1000, 8) AS surprise, CASE WHEN (p_retailprice - 1000) / 1000 > 0.01 THEN 'positive' WHEN (p_retailprice - 1000) / 1000 < -0.01 THEN 'negative' ELSE 'neutral' END AS class,
  round((1 + p_size / 100.0) / (1 + 0.02) - 1, 8) AS real_exact, round(p_size / 100.0 - 0.02, 8) AS real, list_sum(list_transform(range(1, p_size + 1), lambda k: k * (0.03 + CASE WHEN k = p_size THEN 1 ELSE 0 END) / power(1.04, k))) / list_sum(list_transform(range(1, p_size + 1), lambda k: (0.03 + CASE WHEN k = p_size THEN 1 ELSE 0 END) / power(1.04, k))) AS d0,
  round(least(greatest((2.0 * p_size / 60 - (1 - p_size / 60.0)) / 2.0, 0) * 0.5, 0.2), 8) AS size FROM part""".replace("list_sum(list_transform(range(1, p_size + 1), lambda k: k *", "round(list_sum(list_transform(range(1, p_size + 1), lambda k: k *").replace("power(1.04, k))) AS d0", "power(1.04, k))), 7) AS duration"))
def q_macro_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Surprise, real yields, duration and position size of parts read as macro points."""
    p = table(spark, d, "part").withColumns({"y": F.col("p_size") / 100.0, "i": F.lit(0.02), "w": F.col("p_size") / 60.0})
    s = scalars.surprise("p_retailprice", F.lit(1000.0))
    return p.select("p_partkey", F.round(s, 8).alias("surprise"), scalars.surprise_class(s).alias("class"), F.round(scalars.real_yield("y", "i", exact=True), 8).alias("real_exact"), F.round(scalars.real_yield("y", "i"), 8).alias("real"), F.round(scalars.macaulay_duration(F.lit(0.03), F.lit(0.04), F.col("p_size")), 7).alias("duration"), F.round(scalars.position_size("w", F.lit(2.0)), 8).alias("size"))


_V = """dd AS (SELECT upper(trim(symbol, E' \\t\\n\\r')) AS symbol, timestamp AS ts, arg_max(close, (received_at, daily_id)) AS close FROM daily_bars WHERE symbol IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS rn, count(*) OVER () AS n FROM dd)"""


@query(f"""WITH {_V} SELECT CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS role, count(*) AS rows, round(sum(close), 4) AS total FROM n GROUP BY 1""")
def q_chronological(spark: SparkSession, d: str) -> DataFrame:
    v = daily(spark, d)
    s = splits.apply_split(v, splits.chronological(spark, v.count()), "ts", ["symbol"])
    return s.groupBy("role").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("total"))


@query(f"""WITH {_V}, k AS (SELECT unnest(range(0, 10000)) AS k), f AS (SELECT k, 1000 + k * 500 AS e FROM k WHERE 1000 + k * 500 + 20 + 500 <= (SELECT max(n) FROM n))
SELECT CAST(f.k AS INTEGER) AS fold, CASE WHEN n.rn <= f.e THEN 'train' ELSE 'test' END AS role, count(*) AS rows, round(sum(close), 4) AS total FROM n JOIN f ON n.rn <= f.e OR n.rn BETWEEN f.e + 21 AND f.e + 520 GROUP BY ALL""")
def q_expanding(spark: SparkSession, d: str) -> DataFrame:
    """Expanding folds of 500 rows after 20 embargoed ones."""
    v = daily(spark, d)
    s = splits.apply_split(v, splits.expanding(spark, v.count(), 1000, 500, embargo=20), "ts", ["symbol"])
    return s.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("total"))


@query(f"""WITH {_V}, f AS (SELECT unnest(range(0, 5)) AS k), b AS (SELECT k, k * m // 5 AS a, (k + 1) * m // 5 AS z, m FROM f, (SELECT max(n) AS m FROM n))
SELECT CAST(k AS INTEGER) AS fold, CASE WHEN rn > a AND rn <= z THEN 'test' ELSE 'train' END AS role, count(*) AS rows FROM n JOIN b ON (rn > a AND rn <= z) OR rn <= a - 10 OR rn > z + 15 GROUP BY ALL""")
def q_k_fold(spark: SparkSession, d: str) -> DataFrame:
    v = daily(spark, d)
    s = splits.apply_split(v, splits.k_fold(spark, v.count(), 5, purge=10, embargo=15), "ts", ["symbol"])
    return s.groupBy("fold", "role").agg(F.count("*").alias("rows"))


@query(f"""WITH {BARS}, h AS (SELECT *, epoch_us(ts) AS u FROM x) SELECT bar_id FROM h WHERE series LIKE '%XAUUSD' AND u BETWEEN (SELECT CAST(quantile_disc(u, 0.25) AS BIGINT) FROM h) AND (SELECT CAST(quantile_disc(u, 0.75) AS BIGINT) FROM h)""")
def q_range(spark: SparkSession, d: str) -> DataFrame:
    """One symbol's bars between two stamps, both included."""
    from tapewright.operators.orderstats import at_index, ordered_counts

    b = clean_bars(spark, d).withColumn("u", F.unix_micros("ts"))
    q = ordered_counts(b.withColumn("one", F.lit(1)), ["one"], "u").groupBy("one").agg(at_index("u", F.ceil(F.col("total") * 0.25) - 1).alias("a"), at_index("u", F.ceil(F.col("total") * 0.75) - 1).alias("z")).first()
    return b.where(F.col("series").endswith("XAUUSD") & F.col("u").between(q.a, q.z)).select("bar_id")


@query(f"""WITH {BARS} SELECT bar_id FROM (SELECT bar_id, row_number() OVER (PARTITION BY series ORDER BY ts DESC, bar_id) AS k FROM x WHERE series LIKE '%EURUSD' OR series LIKE '%XAUUSD') WHERE k <= 50""")
def q_latest_per_series(spark: SparkSession, d: str) -> DataFrame:
    """The 50 latest bars of each series of two symbols: a top-k report, so the limit is the feature."""
    from pyspark.sql import Window

    b = clean_bars(spark, d).where(F.col("series").endswith("EURUSD") | F.col("series").endswith("XAUUSD"))
    return b.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("ts"), "bar_id"))).where("k <= 50").select("bar_id")


@query("""SELECT l.id, count(r.source) > 0 AS has_rows, count(r.source) AS rows FROM datasets l LEFT JOIN readings r ON r.dataset_id = l.id GROUP BY l.id""")
def q_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries with their rows; rows are counted before the join."""
    n = table(spark, d, "readings").groupBy("dataset_id").agg(F.count("source").alias("rows"))
    return table(spark, d, "datasets").join(n, F.col("id") == F.col("dataset_id"), "left").select("id", (F.coalesce("rows", F.lit(0)) > 0).alias("has_rows"), F.coalesce("rows", F.lit(0)).alias("rows"))
