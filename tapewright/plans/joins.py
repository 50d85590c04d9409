"""Queries of the join, interval and order-flow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.text_keys import symbol_key
from tapewright.operators import asof, blocks, intervals, orderflow
from tapewright.plans.base import BARS, clean_bars, own
from tapewright.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dxy_quotes").where("dxy_close is not null")


_BARS_T = "SELECT bar_id, source, timestamp AS ts FROM bars WHERE timestamp IS NOT NULL"


def _asof_sql(op: str, order: str, tol: str = "") -> str:
    return f"""SELECT l.bar_id, (SELECT q.dxy_id FROM dxy_quotes q WHERE q.source = l.source AND q.dxy_close IS NOT NULL AND q.timestamp {op} l.ts {tol} ORDER BY {order} LIMIT 1) AS dxy_id FROM ({_BARS_T}) l"""


def _asof(spark: SparkSession, d: str, **kw) -> DataFrame:  # noqa: ANN003
    bars = table(spark, d, "bars").where("timestamp is not null").select("bar_id", "source", "timestamp")
    out = asof.asof_join(bars, _quotes(spark, d), by=["source"], left_time="timestamp", right_time="timestamp", values=["dxy_id"], tie="dxy_id", **kw)
    return out.select("bar_id", F.col("r_dxy_id").alias("dxy_id"))


@query("""SELECT bar_id, dxy_id FROM (SELECT l.bar_id, q.dxy_id, row_number() OVER (PARTITION BY l.bar_id ORDER BY q.timestamp DESC, q.dxy_id DESC) AS k
  FROM (SELECT bar_id, source, timestamp AS ts FROM bars WHERE timestamp IS NOT NULL) l LEFT JOIN (SELECT * FROM dxy_quotes WHERE dxy_close IS NOT NULL) q ON q.source = l.source AND q.timestamp <= l.ts) WHERE k = 1""")
def j_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d)


@query("""SELECT bar_id, dxy_id FROM (SELECT l.bar_id, q.dxy_id, row_number() OVER (PARTITION BY l.bar_id ORDER BY q.timestamp, q.dxy_id DESC) AS k
  FROM (SELECT bar_id, source, timestamp AS ts FROM bars WHERE timestamp IS NOT NULL) l LEFT JOIN (SELECT * FROM dxy_quotes WHERE dxy_close IS NOT NULL) q ON q.source = l.source AND q.timestamp > l.ts AND q.timestamp <= l.ts + INTERVAL 600 SECONDS) WHERE k = 1""")
def j_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, direction="forward", strict=True, tolerance_us=600_000_000)


_DAILY = """dd AS (SELECT upper(trim(symbol, E' \\t\\n\\r')) AS symbol, timestamp AS ts, arg_max(struct_pack(high := high, low := low, close := close), (received_at, daily_id)) AS r FROM daily_bars
  WHERE symbol IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL GROUP BY 1, 2), v AS (SELECT symbol, ts, unnest(r) FROM dd)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, ts, high, low, close): daily bars with prices, the last received of equal stamps."""
    r = table(spark, d, "daily_bars").where("symbol is not null and timestamp is not null and close is not null and high is not null and low is not null")
    g = r.groupBy(symbol_key("symbol").alias("symbol"), F.col("timestamp").alias("ts")).agg(F.max_by(F.struct("high", "low", "close"), F.struct("received_at", "daily_id")).alias("r"))
    return g.select("symbol", "ts", "r.*")


_H = (1, 2, 3, 5, 10, 20)


@query(f"""WITH {_DAILY}, h AS (SELECT unnest([1, 2, 3, 5, 10, 20]) AS h), f AS (SELECT v.symbol, v.ts, h.h, v.close, min(n.ts) AS fts FROM v CROSS JOIN h LEFT JOIN v n ON n.symbol = v.symbol AND n.ts >= v.ts + to_days(h.h::INTEGER) GROUP BY ALL)
SELECT f.symbol, epoch_us(f.ts) AS at_us, CAST(f.h AS INTEGER) AS days, round(arg_max(m.close, m.ts) / any_value(f.close) - 1, 8) AS ret, round(max(m.high) / any_value(f.close) - 1, 8) AS mfe, round(min(m.low) / any_value(f.close) - 1, 8) AS mae
FROM f JOIN v m ON m.symbol = f.symbol AND m.ts > f.ts AND m.ts <= f.fts GROUP BY f.symbol, f.ts, f.h""")
def j_forward_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """For each daily bar and horizon: return, best and worst excursion up to the first bar at or after the horizon."""
    return asof.forward_outcomes(daily(spark, d), "symbol", _H)


def _trades(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as trades and views as quotes of one user, on two clocks."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "event_type", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("event_us"), "value")
    e = e.withColumn("receive_us", F.col("event_us") + (F.col("event_id") % 7) * 3_600_000_000)
    t = e.where("event_type = 'purchase'").select("k", F.col("event_id").alias("trade_id"), "event_us", "receive_us", F.col("value").alias("price"))
    q = e.where("event_type = 'view'").select("k", "event_us", "receive_us", (F.col("value") * 0.99).alias("bid"), (F.col("value") * 1.01).alias("ask"))
    return t, q


@query("""WITH e AS (SELECT event_id, user_id AS k, event_type, epoch_us(ts) AS t, epoch_us(ts) + (event_id % 7) * 3600000000 AS r, value FROM events),
 c AS (SELECT t.event_id, t.value AS price, q.value AS qv, q.t AS qt, rank() OVER (PARTITION BY t.event_id ORDER BY q.t DESC) AS k FROM e t JOIN e q ON q.k = t.k AND q.event_type = 'view' AND q.t < t.t AND q.t >= t.t - 86400000000 AND q.r <= t.r WHERE t.event_type = 'purchase'),
 b AS (SELECT event_id, count(*) AS n, any_value(price) AS price, any_value(qv) AS qv, any_value(qt) AS qt FROM c WHERE k = 1 GROUP BY event_id)
SELECT e.event_id AS trade_id, CASE WHEN b.n IS NULL THEN 'NO_QUOTE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN price >= qv * 1.01 THEN 'BUY' WHEN price <= qv * 0.99 THEN 'SELL' ELSE 'INSIDE' END AS side, qt AS quote_us FROM e LEFT JOIN b USING (event_id) WHERE e.event_type = 'purchase'""")
def j_trade_side(spark: SparkSession, d: str) -> DataFrame:
    t, q = _trades(spark, d)
    return orderflow.classify_trades(t, q, "k", 86_400_000_000).select("trade_id", "side", "quote_us")


@query("""WITH t AS (SELECT source, dataset_id, timeframe, min(timestamp) AS s, max(timestamp) AS e FROM readings WHERE timestamp IS NOT NULL GROUP BY ALL)
SELECT l.dataset_id, l.timeframe, bool_or(r.dataset_id IS NOT NULL) AS overlaps FROM t l LEFT JOIN t r ON r.source = l.source AND r.timeframe = 'M15' AND r.s <= l.e AND r.e >= l.s GROUP BY ALL""")
def j_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether a dataset's time span meets that of a quarter-hourly dataset of its source."""
    t = _spans(spark, d)
    return intervals.overlaps_any(t, t.where("timeframe = 'M15'"), ["source"], "s", "e").select("dataset_id", "timeframe", "overlaps")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "readings").where("timestamp is not null").groupBy("source", "dataset_id", "timeframe").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))


@query("""WITH t AS (SELECT source, dataset_id, min(timestamp) AS s, max(timestamp) AS e FROM readings WHERE timestamp IS NOT NULL GROUP BY ALL HAVING min(timestamp) < max(timestamp)),
 p AS (SELECT a.source, count(*) AS pairs FROM t a JOIN t b ON a.source = b.source AND (a.s, a.dataset_id) < (b.s, b.dataset_id) AND a.e > b.s GROUP BY 1),
 m AS (SELECT a.source, a.dataset_id, count(*) AS c FROM t a JOIN t b ON a.source = b.source AND b.s <= a.s AND b.e > a.s GROUP BY 1, 2)
SELECT t.source, count(DISTINCT t.dataset_id) AS n, any_value(mm.most) AS most, coalesce(any_value(p.pairs), 0) AS pairs FROM t JOIN (SELECT source, max(c) AS most FROM m GROUP BY 1) mm USING (source) LEFT JOIN p USING (source) GROUP BY t.source""")
def j_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return intervals.concurrency(_spans(spark, d), ["source"], "s", "e").select("source", "n", "most", "pairs")


@query(f"""WITH {_DAILY}, g AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS rn, count(*) OVER () AS n FROM v), r AS (SELECT symbol, ts AS s, ts + INTERVAL 5 DAYS AS e, CAST(floor((rn - 1) * 6 / n) AS INT) AS g FROM g),
 sp AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM (SELECT unnest(range(6)) AS a) JOIN (SELECT unnest(range(6)) AS b) ON b > a),
 x AS (SELECT sp.split, r.*, r.g IN (sp.a, sp.b) AS test FROM r CROSS JOIN sp),
 iv AS (SELECT split, g, min(s) AS s, max(e) AS e, max(s) AS ms FROM x WHERE test GROUP BY ALL),
 y AS (SELECT x.split, x.symbol, x.s, x.test, bool_or(t.s <= x.e AND t.e >= x.s) AS hit, bool_or(x.s > t.e AND x.s <= t.e + INTERVAL 3 DAYS) AS emb FROM x JOIN iv t ON t.split = x.split GROUP BY ALL)
SELECT CAST(split AS INTEGER) AS split, role, count(*) AS n FROM (SELECT split, CASE WHEN test THEN 'test' WHEN hit THEN 'purged' WHEN emb THEN 'embargoed' ELSE 'train' END AS role FROM y) GROUP BY ALL""")
def j_purged_splits(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the fifteen combinatorial splits of daily bars with five-day labels, purged and embargoed."""
    r = daily(spark, d).select("symbol", F.col("ts").alias("s"), F.expr("ts + interval 5 days").alias("e"))
    x = intervals.purged_folds(r, "s", "e", embargo=F.expr("interval 3 days"), ties=["symbol"])
    return x.groupBy("split", "role").agg(F.count("*").alias("n"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("k"), F.round("value", 2).alias("quantity"), F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "view", "SELL").otherwise("INSIDE").alias("side"))
    return e


_FLOW = """e AS (SELECT event_id, ts, user_id % 10 AS k, CAST(round(value, 2) AS DECIMAL(38,8)) AS q, CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'view' THEN 'SELL' ELSE 'INSIDE' END AS side FROM events),
 f AS (SELECT k, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, coalesce(sum(q) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(q) FILTER (side = 'SELL'), 0) AS sell, sum(q) AS total, count(*) AS trades FROM e GROUP BY ALL)"""


@query(f"""WITH {_FLOW} SELECT k, epoch_us(start) AS start_us, CAST(buy AS DOUBLE) AS buy, CAST(sell AS DOUBLE) AS sell, CAST(total AS DOUBLE) AS total, trades, round(CAST(buy + sell AS DOUBLE) / CAST(total AS DOUBLE), 8) AS signed_share,
  CAST(sum(buy - sell) OVER (PARTITION BY k, CAST(start AS DATE) ORDER BY start) AS DOUBLE) AS cvd FROM f""")
def j_flow_cvd(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour order flow in exact decimals, and the running delta of each UTC day."""
    w = orderflow.flow_windows(_flow(spark, d), ["k"], "ts", "6 hours").withColumn("session", F.to_date("start"))
    c = orderflow.cumulative_delta(w, ["k"], "start", "session")
    return c.select("k", F.unix_micros("start").alias("start_us"), *[F.col(x).cast("double").alias(x) for x in ("buy", "sell", "total", "cvd")], "trades", F.round("signed_share", 8).alias("signed_share"))


@query()
def j_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Anchored clusters of large prints: five or more within six hours."""
    e = _flow(spark, d).where("quantity >= 50").withColumn("t", F.unix_micros("ts"))
    return orderflow.anchored_clusters(e, "k", "t", "quantity", 6 * 3_600_000_000, 5, 500.0)


@query("""WITH e AS (SELECT event_type AS stream, ts, event_id // 5 AS seq, event_id FROM events), l AS (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY ts, event_id) AS p FROM e)
SELECT stream, seq, CASE WHEN seq = p THEN 'DUPLICATE' WHEN seq < p THEN 'REGRESSION' ELSE 'GAP' END AS fault FROM l WHERE seq <= p OR seq > p + 1""")
def j_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("stream"), "ts", F.floor(F.col("event_id") / 5).alias("seq"), "event_id")
    return orderflow.sequence_faults(e, "stream", ["ts", "event_id"], "seq")


@query()
def j_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Mutations of trades (a user's events) with gaps, repeats and cancels, replayed."""
    e = table(spark, d, "events").select(F.col("user_id").alias("trade_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("receive_us"), "event_id")
    n = blocks.numbered(e.withColumn("ts", F.timestamp_micros("receive_us")), ["trade_id"], "ts", ["event_id"])
    m = n.select("trade_id", F.when(F.col("rn") == 1, "NEW").when(F.col("rn") % 5 == 0, "CANCEL").otherwise("CORRECT").alias("action"), F.when(F.col("event_id") % 11 == 0, F.col("rn") + 1).otherwise(F.col("rn")).cast("int").alias("revision"), "receive_us", F.md5((F.col("event_id") - (F.col("event_id") % 13 == 0).cast("int")).cast("string")).alias("digest"))
    return orderflow.replay_ledger(m).groupBy("outcome", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, a AS (SELECT split_part(series, '|', 1) AS source, split_part(series, '|', 2) AS symbol, ts, close FROM x)
SELECT symbol, p.source AS source_a, q.source AS source_b, count(*) FILTER (p.close IS NOT NULL AND q.close IS NOT NULL) AS common, count(*) FILTER (q.close IS NULL) AS missing_b, round(avg(abs(p.close - q.close) / p.close) * 100, 6) AS mape, round(max(abs(p.close - q.close)), 6) AS max_diff
FROM (SELECT a.* FROM a JOIN sources s USING (source) WHERE s.kind = 'exchange') p LEFT JOIN (SELECT a.* FROM a JOIN sources s USING (source) WHERE s.kind = 'broker') q USING (symbol, ts) GROUP BY ALL""")
def j_compare_sources(spark: SparkSession, d: str) -> DataFrame:
    """Closes of exchanges against those of brokers at equal stamps: common and missing rows, deviation."""
    a = clean_bars(spark, d).select(F.split("series", r"\|")[0].alias("source"), F.split("series", r"\|")[1].alias("symbol"), "ts", "close")
    a = a.join(table(spark, d, "sources").select("source", "kind"), "source")
    p = a.where("kind = 'exchange'").select("symbol", "ts", F.col("source").alias("source_a"), F.col("close").alias("a"))
    q = a.where("kind = 'broker'").select("symbol", "ts", F.col("source").alias("source_b"), F.col("close").alias("b"))
    g = p.join(q, ["symbol", "ts"], "left").groupBy("symbol", "source_a", "source_b")
    return g.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("b").isNull(), 1)).alias("missing_b"), F.round(F.avg(F.abs(F.col("a") - F.col("b")) / F.col("a")) * 100, 6).alias("mape"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_diff"))
