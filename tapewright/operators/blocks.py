"""Ordered series cut into balanced blocks: exact row numbers and halos without a task that holds a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the time that one counting shard spans: of one series, and of a whole table taken as one series.
BLOCK_ROWS = 100_000
SHARD_S, TABLE_SHARD_S = 7 * 86_400, 3_600


def numbered(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], shard_s: int = SHARD_S) -> DataFrame:
    """`df` plus rn BIGINT: the row's number from 1 in its series, ordered by `ts` and `ties` (which must make rows unique).

    Rows are numbered inside time shards; each shard's offset is the running count of the shards before it. Rows
    with a null `ts` come first, in a shard of their own.
    """
    keys = list(keys)
    shard = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(shard_s * 1_000_000)), F.lit(-(1 << 40)))
    s = df.withColumn("_shard", shard)
    counts = s.groupBy(*keys, "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_shard").orderBy(ts, *ties)
    local = s.withColumn("_local", F.row_number().over(inside))
    return local.join(offsets, [*keys, "_shard"]).withColumn("rn", F.col("_local") + F.col("_offset")).drop("_shard", "_local", "_offset")


def with_halo(df: DataFrame, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of `numbered` with block and halo: each row in its block, and copied where a neighbour's frame needs it.

    A frame of `before` rows back and `after` rows ahead is then complete inside (series, block); the copies have
    halo true and are dropped once the frames are done.
    """
    size = max(block_rows, before, after, 1)
    i = F.col("rn") - 1
    own = F.floor(i / F.lit(size))
    copies = [own]
    if before:
        copies.append(F.when(F.pmod(i, F.lit(size)) >= size - before, own + 1))
    if after:
        copies.append(F.when((F.pmod(i, F.lit(size)) < after) & (own > 0), own - 1))
    blocks = F.filter(F.array(*copies), lambda x: x.isNotNull())
    return df.withColumn("block", F.explode(blocks)).withColumn("halo", F.col("block") != own)


class Frames:
    """Window frames over one order of rows; `rn` is the row's number in its series, wherever the block begins."""

    def __init__(self, keys: Sequence[str] = ("series", "block"), order: Sequence[str] = ("rn",), rn: str = "rn"):
        self.w = Window.partitionBy(*keys).orderBy(*order)
        self.rn = F.col(rn)

    def last(self, n: int):  # noqa: ANN201
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n: int):  # noqa: ANN201
        return self.w.rowsBetween(-n, -1)

    def ahead(self, n: int):  # noqa: ANN201
        return self.w.rowsBetween(1, n)

    def full(self, n: int, c: Column) -> Column:
        """`c` once the series has n rows, null before."""
        return F.when(self.rn >= n, c)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)


def running_totals(df: DataFrame, keys: Sequence[str], columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of `numbered` with c_total per column: the sum up to the row, by block totals and sums inside blocks."""
    keys = list(keys)
    b = df.withColumn("_b", F.floor((F.col("rn") - 1) / F.lit(block_rows)))
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    upto = Window.partitionBy(*keys, "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(offsets, [*keys, "_b"]).withColumns({f"{c}_total": F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_o_{c}") for c in columns})
    return out.drop("_b", *[f"_o_{c}" for c in columns])
