"""Base relations of the market queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.text_keys import symbol_key
from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.runtime import table

_FINITE = ("open", "high", "low", "close")


def clean_bars(spark: SparkSession, d: str) -> DataFrame:
    """(series, ts, bar_id, open, high, low, close, volume, timeframe): bars with finite prices above zero, resent rows once.

    series is source|symbol; a volume that is null or NaN counts as 0.
    """
    b = table(spark, d, "bars").where("timestamp is not null and source is not null and symbol is not null")
    for c in _FINITE:
        b = b.where((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c))
    vol = F.when(F.col("volume").isNull() | F.isnan("volume"), 0.0).otherwise(F.col("volume"))
    b = b.select(F.concat_ws("|", "source", symbol_key("symbol")).alias("series"), F.col("timestamp").alias("ts"), "bar_id", *_FINITE, vol.alias("volume"), "timeframe")
    return b.groupBy("series", "ts").agg(F.min_by(F.struct("bar_id", *_FINITE, "volume", "timeframe"), "bar_id").alias("r")).select("series", "ts", "r.*")


def framed_bars(spark: SparkSession, d: str, before: int = 0, after: int = 0, block_rows: int = 100_000) -> tuple[DataFrame, Frames]:
    """Clean bars in blocks with halos for frames of that size, and the frames."""
    return with_halo(numbered(clean_bars(spark, d), ["series"], "ts", ["bar_id"]), before, after, block_rows), Frames()


def own(df: DataFrame) -> DataFrame:
    return df.where("not halo")


BARS = """b AS (SELECT source || '|' || upper(trim(symbol, E' \\t\\n\\r')) AS series, timestamp AS ts, arg_min(struct_pack(bar_id := bar_id, open := open, high := high, low := low, close := close,
    volume := CASE WHEN volume IS NULL OR isnan(volume) THEN 0.0 ELSE volume END, timeframe := timeframe), bar_id) AS r FROM bars
  WHERE timestamp IS NOT NULL AND source IS NOT NULL AND symbol IS NOT NULL AND open > 0 AND isfinite(open) AND high > 0 AND isfinite(high) AND low > 0 AND isfinite(low) AND close > 0 AND isfinite(close) GROUP BY 1, 2),
bars_ AS (SELECT series, ts, unnest(r) FROM b),
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, bar_id) AS rn FROM bars_)"""
W = "PARTITION BY series ORDER BY rn"
