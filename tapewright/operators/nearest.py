"""Matching records by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in tolerances. A right row is copied only into the next bucket it can serve, so
#: copies are about 2 / BUCKET_TOLERANCES of the right side.
BUCKET_TOLERANCES = 90


def nearest_in_time(left: DataFrame, right: DataFrame, *, entity: str, left_time: str, right_time: str, left_id: str, right_id: str, tolerance_us: int) -> DataFrame:
    """(left_id, right_id, gap_us): for each left row the right row of its entity nearest in time within the tolerance.

    Both tables are united and sorted per entity and time bucket; the last right row is carried forward and the
    next one backward onto the left rows, and the nearer one within the tolerance (limit included) is taken. Of two
    equally near the earlier, at equal times the smaller id. Buckets cut a hot entity into many tasks; right rows
    near a bucket's edge are copied into the neighbour, which is exact as the tolerance is shorter than a bucket.
    One shuffle; no pairs are made. Rows with a null entity, time or id are left out; a right row may serve many.
    """
    width = max(tolerance_us, 1) * BUCKET_TOLERANCES
    us = lambda c: F.unix_micros(c)
    floor = lambda c: F.floor(c / F.lit(width))
    a = left.select(F.col(entity).alias("e"), us(left_time).alias("t"), F.col(left_id).alias("l"), F.lit(None).cast("bigint").alias("r"))
    a = a.where("e is not null and t is not null and l is not null").withColumn("b", floor(F.col("t")))
    b = right.select(F.col(entity).alias("e"), us(right_time).alias("t"), F.lit(None).cast("bigint").alias("l"), F.col(right_id).alias("r"))
    b = b.where("e is not null and t is not null and r is not null")
    spread = F.array_distinct(F.array(floor(F.col("t") - tolerance_us), floor(F.col("t")), floor(F.col("t") + tolerance_us)))
    b = b.withColumn("b", F.explode(spread))
    # at equal times right rows come first, larger ids before smaller, so that the last one seen is the smallest
    key = Window.partitionBy("e", "b")
    past = key.orderBy(F.col("t"), F.col("r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    future = key.orderBy(F.col("t").desc(), F.col("r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("r").isNotNull(), F.struct("t", "r"))
    both = a.unionByName(b).withColumn("last", F.last(seen, ignorenulls=True).over(past)).withColumn("next", F.last(seen, ignorenulls=True).over(future))
    back, ahead = F.col("t") - F.col("last.t"), F.col("next.t") - F.col("t")
    earlier = F.col("next").isNull() | (back <= ahead)
    out = both.where("l is not null").select("l", F.when(F.col("last").isNotNull() & earlier, F.struct(F.col("last.r").alias("r"), back.alias("gap"))).otherwise(F.struct(F.col("next.r").alias("r"), ahead.alias("gap"))).alias("m"))
    return out.where(F.col("m.gap") <= tolerance_us).select(F.col("l").alias(left_id), F.col("m.r").alias(right_id), F.col("m.gap").alias("gap_us"))
