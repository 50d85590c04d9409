"""Exact order statistics per key, without a task that holds a key: quantiles, ranks, index picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.runtime import cut

#: Shards of a key; a power of two.
_SPLITS = 64


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, below, total): each distinct value, its rows (or summed `weight`), the rows with smaller values, all rows of the key.

    Equal values are pre-aggregated, so a frequent value is one row; approximate quantiles of the distinct values
    cut a key into shards, whose running totals give exact counts. Null and NaN values are left out.
    """
    keys = list(keys)
    # read by the cuts, the shards' sums and the shards: what made the values runs once
    vc = cut(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n")))
    cuts = [i / _SPLITS for i in range(1, _SPLITS)]
    splits = vc.groupBy(*keys).agg(F.percentile_approx(value, cuts, F.lit(500)).alias("_cuts"))
    # how many cuts lie below the value, by bisection: halving steps over the sorted cuts
    halves = F.array(*[F.lit(_SPLITS >> i) for i in range(1, _SPLITS.bit_length())])
    shard = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(value), at + step).otherwise(at))
    s = vc.join(splits, keys).withColumn("_shard", shard).drop("_cuts")
    sums = s.groupBy(*keys, "_shard").agg(F.sum("n").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_shard")
    offsets = sums.select(*keys, "_shard", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "_shard").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_l", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "_shard"]).select(*keys, value, "n", (F.col("_l") + F.col("_o")).alias("below"), "total")


def at_index(value: str, index: Column) -> Column:
    """Aggregate over `ordered_counts`: the value at a position from 0 in sorted order."""
    return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))


def interpolated(value: str, q: float) -> Column:
    """Aggregate over `ordered_counts`: the q-quantile, interpolated linearly between neighbours."""
    pos = (F.max("total") - 1) * F.lit(q)
    place = (F.col("total") - 1) * F.lit(q)
    lo, hi = at_index(value, F.floor(place)), at_index(value, F.ceil(place))
    return lo + (hi - lo) * (pos - F.floor(pos))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` plus the row's average-tie rank of `value` in its key."""
    oc = ordered_counts(df, keys, value).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(oc, [*keys, value], "left")
