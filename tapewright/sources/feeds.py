"""Other feeds: scalar series, quote envelopes, filings as JSON, event lists, signal files, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.asof import asof_join


def read_scalar_series(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """series, day, value of a date,value CSV; `.` and other non-numbers are null values. The series is the second header name."""
    raw = spark.read.option("header", True).csv(path)
    d, v = raw.columns[:2]
    return raw.select(F.lit(name or v).alias("series"), F.to_date(F.try_to_timestamp(F.trim(F.col(f"`{d}`")), F.lit("yyyy-MM-dd"))).alias("day"), F.col(f"`{v}`").try_cast("double").alias("value"))


def utc_days(value: Column) -> Column:
    """The UTC day of an epoch in milliseconds (from 1e11) or seconds (from 1e9), else null."""
    n = value.cast("bigint")
    return F.to_date(F.when(n >= 100_000_000_000, F.timestamp_millis(n)).when(n >= 1_000_000_000, F.timestamp_seconds(n)))


ENVELOPE = "payload struct<symbol:string,bid:double,ask:double,as_of_us:bigint>, sha256 string"


def read_quotes(spark: SparkSession, path: str, now_us: int, most_age_s: float = 15.0, future_s: float = 2.0) -> DataFrame:
    """symbol, bid, ask, as_of_us, reasons of JSON envelopes {payload, sha256}.

    reasons (empty: accepted): MALFORMED, HASH (the digest is not that of the payload as sorted JSON), STALE, FUTURE,
    CROSSED (bid above ask) or PRICE (not above zero).
    """
    raw = spark.read.schema(ENVELOPE).option("mode", "PERMISSIVE").json(path)
    p = "payload"
    body = F.to_json(F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("as_of_us", "ask", "bid", "symbol")]))
    age = F.lit(now_us) - F.col(f"{p}.as_of_us")
    missing = F.col(p).isNull() | F.col(f"{p}.bid").isNull() | F.col(f"{p}.ask").isNull() | F.col(f"{p}.as_of_us").isNull()
    r = F.array(F.when(missing, "MALFORMED"), F.when(~missing & ~F.coalesce(F.sha2(body, 256) == F.col("sha256"), F.lit(False)), "HASH"), F.when(age > most_age_s * 1e6, "STALE"), F.when(age < -future_s * 1e6, "FUTURE"), F.when(F.col(f"{p}.bid") > F.col(f"{p}.ask"), "CROSSED"), F.when((F.col(f"{p}.bid") <= 0) | (F.col(f"{p}.ask") <= 0), "PRICE"))
    return raw.select(*[F.col(f"{p}.{c}").alias(c) for c in ("symbol", "bid", "ask", "as_of_us")], F.filter(r, lambda x: x.isNotNull()).alias("reasons"))


def quote_digest(symbol: str, bid: float, ask: float, as_of_us: int) -> str:
    """The digest `read_quotes` expects."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"as_of_us": as_of_us, "ask": ask, "bid": bid, "symbol": symbol}, separators=(",", ":")).encode()).hexdigest()


def normalise_filings(raw: DataFrame, text: str = "value") -> DataFrame:
    """ticker, person, code, amount, event_at, usable_at, problem from JSON texts: rows with a problem are kept with their reason."""
    j = F.from_json(F.col(text), "Ticker string, Name string, TransactionCode string, Shares double, PricePerShare double, Date string, fileDate string")
    d = raw.select(F.col(text).alias("raw"), j.alias("j"))
    at = lambda c: F.coalesce(*[F.try_to_timestamp(F.col(f"j.{c}"), F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    out = d.select("raw", F.upper(F.trim("j.Ticker")).alias("ticker"), F.trim("j.Name").alias("person"), F.upper("j.TransactionCode").alias("code"), (F.col("j.Shares") * F.col("j.PricePerShare")).alias("amount"), at("Date").alias("event_at"), at("fileDate").alias("usable_at"))
    problem = F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", "ticker").when(F.coalesce(F.col("person"), F.lit("")) == "", "person").when(F.col("event_at").isNull(), "date").when(F.col("usable_at").isNull(), "file date").when(F.col("usable_at") < F.col("event_at"), "order").when(F.col("amount").isNull() | (F.col("amount") < 0), "amount")
    return out.withColumn("problem", problem)


def write_signals(predictions: DataFrame, prices: DataFrame, factors: dict[str, tuple[DataFrame, int]], path: str | None, threshold: float = 0.0) -> DataFrame:
    """Point-in-time signals: predictions (symbol, ts, score) with the price at their stamp and the last value of each factor that was available by then.

    factors: name to (rows with ts and value, lag in days). Rows without a price leave; the CSV is sorted by stamp.
    """
    out = predictions.where(F.abs("score") >= threshold).join(prices.select("symbol", "ts", "close"), ["symbol", "ts"])
    for name, (rows, lag) in factors.items():
        known = rows.select(F.lit(1).alias("_one"), F.try_add(F.col("ts"), F.make_dt_interval(F.lit(lag))).alias("_at"), F.col("value"))
        out = asof_join(out.withColumn("_one", F.lit(1)), known, by=["_one"], left_time="ts", right_time="_at", values=["value"], prefix="_f").withColumnRenamed("_fvalue", name).drop("_ftime", "_one")
    out = out.withColumn("signal", F.when(F.col("score") > 0, "BUY").otherwise("SELL"))
    if path:
        out.orderBy("ts", "symbol").write.mode("overwrite").option("header", True).csv(path)
    return out


def file_hashes(spark: SparkSession, path: str, most_bytes: int = 512_000_000) -> DataFrame:
    """path, length, sha256 of each file; a file beyond the limit has a null hash, and its content isn't read."""
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    big = spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("string").alias("sha256"))
    return small.union(big)


def joined_daily(left: DataFrame, *rights: DataFrame, day: str = "day") -> DataFrame:
    """Inner join of tables by day; a day twice in a table, a null value or an empty result raises when it is read."""
    def checked(d: DataFrame) -> DataFrame:
        n = d.groupBy(day).agg(F.count("*").alias("_n"))
        cols = [c for c in d.columns if c != day]
        bad = F.exists(F.array(*[F.col(c).isNull() for c in cols]), lambda x: x) if cols else F.lit(False)
        ok = d.join(n, day).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a day occurs twice"))).when(bad, F.raise_error(F.lit("a value is null"))).otherwise(F.lit(True)))
        return ok.where("_ok").drop("_n", "_ok")

    out = checked(left)
    for r in rights:
        out = out.join(checked(r), day)
    return out
