"""Readers of candle files: CSV in several layouts, Parquet with any time column, headerless and UTF-16 files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which a column appears in exports (fixed values).
SYNONYMS = {
    "ts": ("time", "timestamp", "datetime", "date", "open_time"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "last"),
    "volume": ("volume", "vol", "v", "tick_volume", "tickvol"),
    "symbol": ("symbol", "ticker", "instrument"),
}
_PATTERNS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")


def columns_of(header: list[str]) -> dict[str, str]:
    """Which header name holds which field; names are compared without case, blanks and angle brackets."""
    clean = {h.strip().strip("<>").lower(): h for h in header}
    return {f: clean[n] for f, names in SYNONYMS.items() for n in reversed(names) if n in clean}


def layout_of(header: list[str]) -> str:
    """`date_time` (separate date and time), `single` (one time column) or `generic`."""
    clean = {h.strip().strip("<>").lower() for h in header}
    prices = {"open", "high", "low", "close"} <= clean
    if prices and {"date", "time"} <= clean:
        return "date_time"
    return "single" if prices and clean & set(SYNONYMS["ts"]) else "generic"


def _instant(text: Column, zone: str) -> Column:
    """A text in one of the patterns, or epoch seconds or milliseconds, as UTC."""
    number = text.try_cast("bigint")
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).when(number >= 1_000_000_000, F.timestamp_seconds(number))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in _PATTERNS])
    return F.coalesce(epoch, F.to_utc_timestamp(parsed, zone))


def read_csv(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, zone: str = "UTC", fields: dict[str, str] | None = None, strict: bool = False, encoding: str = "UTF-8", sep: str = ",", keep_last: bool = True) -> DataFrame:
    """symbol, timeframe, ts, open, high, low, close, volume, file, problem of every row.

    The header tells the layout; `fields` overrides which column holds what. Rows that can't be read keep a
    `problem` (strict: the read fails); a missing volume counts as 0; of rows with equal symbol and stamp the last is kept
    when `keep_last`, in the order of file names and of lines in a file.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", encoding.upper().startswith("UTF-16")).csv(path)
    header = raw.columns
    at = {**columns_of(header), **(fields or {})}
    clean = {h.strip().strip("<>").lower(): h for h in header}
    text = F.concat_ws(" ", F.col(f"`{clean['date']}`"), F.col(f"`{clean['time']}`")) if layout_of(header) == "date_time" else F.col(f"`{at['ts']}`")
    num = lambda f: F.col(f"`{at[f]}`").try_cast("double") if f in at else F.lit(None).cast("double")
    sym = F.col(f"`{at['symbol']}`") if symbol is None and "symbol" in at else F.lit(symbol)
    out = raw.select(sym.alias("symbol"), F.lit(timeframe).alias("timeframe"), _instant(F.trim(text), zone).alias("ts"), *[num(f).alias(f) for f in ("open", "high", "low", "close")], F.coalesce(num("volume"), F.lit(0.0)).alias("volume"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    problem = F.when(F.col("ts").isNull(), "timestamp").when(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull(), "price").when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")), "geometry")
    out = out.withColumn("problem", problem)
    if strict:
        out = out.withColumn("ts", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("unreadable row: "), F.col("problem"))).cast("timestamp")).otherwise(F.col("ts")))
    if keep_last:
        # by file name, then by place in the file: a piece of a file is read in order by one task
        out = out.withColumn("_id", F.struct("file", "_start", F.monotonically_increasing_id()))
        good = out.where("problem is null").groupBy("symbol", "timeframe", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "file", "problem"), "_id").alias("r")).select("symbol", "timeframe", "ts", "r.*")
        out = good.unionByName(out.where("problem is not null").drop("_id", "_start"))
    return out.drop("_start")


def read_headerless(spark: SparkSession, path: str, symbol: str, zone: str = "UTC") -> DataFrame:
    """Rows of `time,open,high,low,close,tick_volume,real_volume` without a header."""
    raw = spark.read.schema("t string, open double, high double, low double, close double, volume double, real_volume double").csv(path)
    return raw.select(F.lit(symbol).alias("symbol"), _instant(F.trim("t"), zone).alias("ts"), "open", "high", "low", "close", "volume", "real_volume")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet candles with any of the time names; rows without a time or price are counted by the `problem` column."""
    raw = spark.read.parquet(path)
    at = columns_of(raw.columns)
    kind = dict(raw.dtypes)[at["ts"]]
    ts = F.col(at["ts"]).cast("timestamp") if kind.startswith(("timestamp", "date")) else _instant(F.col(at["ts"]).cast("string"), "UTC")
    cols = [F.col(at[f]).cast("double").alias(f) for f in ("open", "high", "low", "close") if f in at]
    out = raw.select(ts.alias("ts"), *cols, *([F.col(at["symbol"]).alias("symbol")] if "symbol" in at else []), F.coalesce(F.col(at["volume"]).cast("double"), F.lit(0.0)).alias("volume") if "volume" in at else F.lit(0.0).alias("volume"))
    return out.withColumn("problem", F.when(F.col("ts").isNull(), "timestamp").when(F.col("close").isNull(), "price"))


def timeframe_of(df: DataFrame, ts: str = "ts") -> int | None:
    """The upper-median positive step between stamps in seconds, if it is a known timeframe. Over all rows, one pass of windows."""
    from tapewright.functions.scalars import TIMEFRAMES
    from tapewright.operators.blocks import TABLE_SHARD_S, Frames, numbered, with_halo
    from tapewright.operators.orderstats import at_index, ordered_counts

    one = df.where(F.col(ts).isNotNull()).select(ts).distinct().withColumn("one", F.lit(1))
    f = Frames(keys=("one", "block"))
    d = with_halo(numbered(one, ["one"], ts, [], TABLE_SHARD_S), before=1)
    d = d.withColumn("step", (F.unix_micros(ts) - F.unix_micros(f.lag(ts))) / 1_000_000).where("not halo and step > 0")
    r = ordered_counts(d, ["one"], "step").groupBy("one").agg(at_index("step", F.floor(F.col("total") / 2)).alias("m")).first()
    return int(r.m) if r is not None and r.m in set(TIMEFRAMES.values()) else None
