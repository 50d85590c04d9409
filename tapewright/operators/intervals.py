"""Intervals: merging, overlap without pairs, concurrency, purging and embargo."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.asof import asof_join
from tapewright.operators.blocks import TABLE_SHARD_S, numbered, running_totals

#: Seconds of starts that are merged first.
MERGE_S = 86_400


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """(by, start, end): the union of closed intervals as disjoint ones; touching ones are joined.

    First inside stretches of MERGE_S of the starts, so that no task takes all intervals of a key, then over what these leave.
    """
    def merged(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")

    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*by, start).agg(F.max(end).alias(end))
    near = d.withColumn("_near", F.floor(F.unix_micros(F.col(start).cast("timestamp")) / F.lit(MERGE_S * 1_000_000)))
    return merged(merged(near, [*by, "_near"]).drop("_near"), list(by))


def overlaps_any(left: DataFrame, right: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """`left` plus overlaps BOOLEAN: whether a row's closed interval meets any of the right side's.

    The right intervals are merged; then the last merged one that starts by the row's end decides. No pairs.
    """
    merged = merge_intervals(right, by, start, end).withColumnRenamed(start, "_ms").withColumnRenamed(end, "_me")
    j = asof_join(left, merged, by=by, left_time=end, right_time="_ms", values=["_me"], prefix="_o")
    return j.withColumn("overlaps", F.coalesce(F.col("_o_me") >= F.col(start), F.lit(False))).drop("_otime", "_o_me")


def concurrency(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """(by, n, most, pairs): intervals, the most open at once, and overlapping pairs, for half-open [start, end).

    A sweep of +1 and -1 events, ends before starts at equal times; each start meets the intervals open just before.
    """
    d = df.where(F.col(start) < F.col(end))
    ev = d.select(*by, F.col(start).alias("_t"), F.lit(1).alias("_d"), F.monotonically_increasing_id().alias("_id")).union(d.select(*by, F.col(end).alias("_t"), F.lit(-1).alias("_d"), F.monotonically_increasing_id().alias("_id")))
    open_ = running_totals(numbered(ev, by, "_t", ["_d", "_id"]), by, ["_d"])
    return open_.groupBy(*by).agg(F.count(F.when(F.col("_d") == 1, 1)).alias("n"), F.max("_d_total").alias("most"), F.sum(F.when(F.col("_d") == 1, F.col("_d_total") - 1).otherwise(0)).alias("pairs"))


def purged_folds(rows: DataFrame, start: str, end: str, n_groups: int = 6, n_test: int = 2, embargo: Column | None = None, ties: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of every combinatorial split: split INT, role test, train, purged or embargoed.

    Rows in order of `start` fall into n_groups equal groups; each choice of n_test groups is a split. A training
    row whose closed label interval meets a test row's is purged; one that starts within the embargo after a test
    row's end is embargoed.
    """
    r = numbered(rows.withColumn("_one", F.lit(1)), ["_one"], start, ties, TABLE_SHARD_S)
    n = rows.count()
    group = F.floor((F.col("rn") - 1) * n_groups / F.lit(max(n, 1))).cast("int")
    splits = list(combinations(range(n_groups), n_test))
    every = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, s)).alias("groups")) for i, s in enumerate(splits)])
    x = r.withColumn("_g", group).drop("_one", "rn")
    x = x.withColumn("_s", F.explode(every)).select("*", F.col("_s.split").alias("split"), F.array_contains(F.col("_s.groups"), F.col("_g")).alias("_test")).drop("_s", "_g")
    test = x.where("_test")
    train = overlaps_any(x.where("not _test"), test, ["split"], start, end)
    role = F.when(F.col("overlaps"), "purged")
    if embargo is not None:
        late = merge_intervals(test.withColumn("_es", F.col(end)).withColumn("_ee", F.col(end) + embargo), ["split"], "_es", "_ee")
        train = asof_join(train, late, by=["split"], left_time=start, right_time="_es", values=["_ee"], strict=True, prefix="_e")
        role = role.when(F.col("_e_ee") >= F.col(start), "embargoed")
        train = train.withColumn("role", role.otherwise("train")).drop("_etime", "_e_ee")
    else:
        train = train.withColumn("role", role.otherwise("train"))
    return train.drop("overlaps", "_test").unionByName(test.drop("_test").withColumn("role", F.lit("test")))
