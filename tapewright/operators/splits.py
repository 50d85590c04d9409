"""Chronological, expanding, rolling and embargoed splits as small tables of row-number ranges, joined to rows by number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.blocks import TABLE_SHARD_S, numbered

_SCHEMA = "fold int, role string, lo bigint, hi bigint"


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _SCHEMA)


def chronological(spark: SparkSession, n: int, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Row numbers [lo, hi] of train, validation and test by floors of the row count."""
    a, b = int(n * train), int(n * train) + int(n * validation)
    return _table(spark, [(0, "train", 1, a), (0, "validation", a + 1, b), (0, "test", b + 1, n)])


def expanding(spark: SparkSession, n: int, first: int, size: int, step: int | None = None, embargo: int = 0) -> DataFrame:
    """Training from the first row on, the next `size` rows (after `embargo`) for testing, moving by `step`."""
    step, rows, k = step or size, [], 0
    while first + k * step + embargo + size <= n:
        end = first + k * step
        rows += [(k, "train", 1, end), (k, "test", end + embargo + 1, end + embargo + size)]
        k += 1
    return _table(spark, rows)


def rolling(spark: SparkSession, n: int, train: int, size: int, step: int, folds: int | None = None) -> DataFrame:
    """A training window of fixed length, the next `size` rows for validation; too few rows raise."""
    if n < train + size:
        raise ValueError(f"{n} rows are too few for {train} + {size}")
    count = (n - train - size) // step + 1
    rows = [x for k in range(min(count, folds or count)) for x in ((k, "train", k * step + 1, k * step + train), (k, "validation", k * step + train + 1, k * step + train + size))]
    return _table(spark, rows)


def k_fold(spark: SparkSession, n: int, k: int = 5, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Contiguous test folds; training on both sides, less `purge` rows before and `embargo` rows after the test."""
    rows = []
    for i in range(k):
        a, b = i * n // k, (i + 1) * n // k
        rows.append((i, "test", a + 1, b))
        if a - purge > 0:
            rows.append((i, "train", 1, a - purge))
        if b + embargo < n:
            rows.append((i, "train", b + embargo + 1, n))
    return _table(spark, rows)


def apply_split(df: DataFrame, split: DataFrame, ts: str, ties: Sequence[str]) -> DataFrame:
    """`df` with fold and role of each row. The split, at most a few thousand ranges, becomes a literal of the plan."""
    ranges = [tuple(r) for r in split.limit(10_001).collect()]
    if len(ranges) > 10_000:
        raise ValueError("a split has at most 10,000 ranges")
    if not ranges:
        return df.limit(0).withColumns({"rn": F.lit(0).cast("bigint"), "fold": F.lit(0), "role": F.lit("")})
    lit = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(r).alias("role"), F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi")) for f, r, a, b in ranges])
    x = numbered(df.withColumn("_one", F.lit(1)), ["_one"], ts, ties, TABLE_SHARD_S).drop("_one")
    hit = F.filter(lit, lambda s: (F.col("rn") >= s["lo"]) & (F.col("rn") <= s["hi"]))
    return x.withColumn("_s", F.explode(hit)).select("*", "_s.fold", "_s.role").drop("_s")
