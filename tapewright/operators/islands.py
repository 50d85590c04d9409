"""Gaps and islands: runs of equal values, balanced over blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str, block_rows: int = 100_000) -> DataFrame:
    """(keys, value, start, end, n): runs of equal neighbouring `value` by `order`, a BIGINT that is unique per key.

    Runs are made inside blocks of `order` first and then joined across blocks: the second step sees a block's
    first and last run only, so no task holds a whole series. Null equals null.
    """
    keys = list(keys)
    b = df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"), F.floor(F.col(order) / F.lit(block_rows)).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("_o")
    new = F.when(F.lag("_o").over(w).isNull() | ~F.col("_v").eqNullSafe(F.lag("_v").over(w)), 1).otherwise(0)
    inside = b.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = inside.groupBy(*keys, "_b", "_run").agg(F.first("_v").alias("_v"), F.min("_o").alias("_s"), F.max("_o").alias("_e"), F.count("*").alias("_n"))
    ends = pieces.groupBy(*keys, "_b").agg(F.max("_run").alias("_top"))
    pieces = pieces.join(ends, [*keys, "_b"])
    inner = pieces.where("_run > 1 and _run < _top").select(*keys, "_v", "_s", "_e", "_n")
    edge = pieces.where("_run = 1 or _run = _top")
    e = Window.partitionBy(*keys).orderBy("_s")
    fresh = F.coalesce((F.col("_b") == F.lag("_b").over(e)) | ~F.col("_v").eqNullSafe(F.lag("_v").over(e)), F.lit(True))
    edge = edge.withColumn("_isl", F.sum(fresh.cast("int")).over(e.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edge.groupBy(*keys, "_isl").agg(F.first("_v").alias("_v"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    both = inner.union(merged.select(*keys, "_v", "_s", "_e", "_n"))
    return both.select(*keys, F.col("_v").alias(value), F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_n").alias("n"))
