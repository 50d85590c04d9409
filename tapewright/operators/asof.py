"""As-of joins in either direction, cut into time buckets so that no task holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.runtime import cut

BUCKET_S = 86_400


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], direction: str = "backward", strict: bool = False, tolerance_us: int | None = None, tie: str | None = None, prefix: str = "r_", bucket_s: int = BUCKET_S) -> DataFrame:
    """`left` plus r_time and the right side's `values` (prefixed): the last right row at or before, or the first at or after.

    strict leaves out equal times; of equal right times the largest `tie` counts. Beyond `tolerance_us`, or
    without a partner, the values are null. Left rows are kept as they are, repeated ones too; null keys or times
    find no partner. One shuffle of both sides; the last right row of the buckets before comes from a summary of
    one row per key and bucket.
    """
    sign = 1 if direction == "backward" else -1
    t = lambda c: F.unix_micros(c) * sign
    tie_col = F.col(tie) if tie else F.lit(0)
    width = F.lit(bucket_s * 1_000_000)
    keys = [f"_k{i}" for i in range(len(by))]
    payload = F.struct(t(right_time).alias("t"), tie_col.alias("tie"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    r = right.where(F.col(right_time).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], payload.alias("_r")).dropna(subset=keys)
    r = r.withColumn("_t", F.col("_r.t")).withColumn("_b", F.floor(F.col("_t") / width))
    lhs = left.select(F.struct(*left.columns).alias("_l"), *[F.col(b).alias(k) for b, k in zip(by, keys)], t(left_time).alias("_t"))
    lhs = lhs.withColumn("_b", F.floor(F.col("_t") / width))
    both = lhs.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(lhs.schema["_l"].dataType)))
    # at equal times right rows come first unless strict
    side = F.when(F.col("_r").isNotNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", side, F.col("_r.tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    # the summary: the last right row of each bucket, and the buckets that left rows lie in
    own = r.groupBy(*keys, "_b").agg(F.max("_r").alias("_r"))
    slots = own.unionByName(lhs.select(*keys, "_b").distinct().withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))).groupBy(*keys, "_b").agg(F.max("_r").alias("_r"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*[F.col(k).alias(f"c{k}") for k in keys], F.col("_b").alias("c_b"), F.last("_r", ignorenulls=True).over(earlier).alias("_c"))
    cond = (F.col("_b") == F.col("c_b"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"c{k}"))
    m = near.join(carried, cond, "left").withColumn("_m", F.coalesce("_m", "_c"))
    ok = F.col("_m").isNotNull()
    if tolerance_us is not None:
        ok = ok & (F.col("_t") - F.col("_m.t") <= tolerance_us)
    found = lambda c: F.when(ok, c)
    return m.select("_l.*", found(F.timestamp_micros(F.col("_m.t") * sign)).alias(f"{prefix}time"), *[found(F.col(f"_m.v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)])


_DAY_US = 86_400_000_000


def forward_outcomes(bars: DataFrame, key: str, days: Sequence[int]) -> DataFrame:
    """(key, at_us, days, ret, mfe, mae): for each bar and horizon the return, best and worst excursion up to the first bar at or after the horizon.

    `bars` has the key, ts (unique per key), high, low and close. The bar that ends a horizon comes from a forward as-of join, however
    many bars lie before it. Extremes on the way are those of the rest of the bar's day, of whole days (at most the horizon's
    number, from one row per day) and of the last day up to the bar, so no task and no array holds more than a day's bars.
    Bars without a bar at or after the horizon have no row for it; null keys or stamps are left out.
    """
    b = bars.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("key"), "ts", "high", "low", "close", F.floor(F.unix_micros("ts") / F.lit(_DAY_US)).alias("day"))
    w = Window.partitionBy("key", "day").orderBy("ts")
    rest, upto = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    b = cut(b.select("*", F.max("high").over(rest).alias("rest_high"), F.min("low").over(rest).alias("rest_low"), F.max("high").over(upto).alias("to_high"), F.min("low").over(upto).alias("to_low")))
    whole = b.groupBy("key", "day").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    ahead = Window.partitionBy("key").orderBy("day").rangeBetween(1, max(days))
    whole = whole.select(F.col("key").alias("w_key"), F.col("day").alias("w_day"), F.collect_list(F.struct("day", "high", "low")).over(ahead).alias("next"))
    left = b.select("key", "ts", "day", "close", "rest_high", "rest_low", F.explode(F.array(*map(F.lit, days))).alias("days"))
    left = left.withColumn("end", F.try_add(F.col("ts"), F.make_dt_interval(F.col("days"))))
    j = asof_join(left, b, by=["key"], left_time="end", right_time="ts", values=["day", "close", "to_high", "to_low"], direction="forward", bucket_s=max(days) * 86_400).where("r_time is not null")
    j = j.join(whole, (F.col("key") == F.col("w_key")) & (F.col("day") == F.col("w_day")))
    # days between: all of their bars lie before the horizon's end
    between = F.filter("next", lambda x: x["day"] < F.col("r_day"))
    pick = lambda f, c, ends: f(*[F.col(e) for e in ends], (F.array_max if f is F.greatest else F.array_min)(F.transform(between, lambda x: x[c])))
    pct = lambda x: F.round(x / F.col("close") - 1, 8)
    return j.select(F.col("key").alias(key), F.unix_micros("ts").alias("at_us"), "days", pct(F.col("r_close")).alias("ret"), pct(pick(F.greatest, "high", ("rest_high", "r_to_high"))).alias("mfe"), pct(pick(F.least, "low", ("rest_low", "r_to_low"))).alias("mae"))


def state_as_of(decisions: DataFrame, time: str, inputs: dict[str, tuple[DataFrame, Sequence[str], str, str, str | None, int]]) -> DataFrame:
    """`decisions` plus name, name_value per input and status: what each input was at the decision.

    An input is (rows, by, its time, its value, tie, oldest age in seconds). Its last row at or before the decision is OK, STALE
    beyond the age (no value then) or MISSING. status is READY if all are OK, else PARTIAL_OR_STALE.
    """
    out = decisions
    for name, (rows, by, at, value, tie, age) in inputs.items():
        out = asof_join(out, rows, by=by, left_time=time, right_time=at, values=[value], tie=tie, prefix=f"_{name}_")
        old = F.unix_micros(time) - F.unix_micros(f"_{name}_time")
        state = F.when(F.col(f"_{name}_time").isNull(), "MISSING").when(old > age * 1_000_000, "STALE").otherwise("OK")
        out = out.withColumn(name, state).withColumn(f"{name}_value", F.when(F.col(name) == "OK", F.col(f"_{name}_{value}"))).drop(f"_{name}_time", f"_{name}_{value}")
    ready = None
    for name in inputs:
        ready = F.col(name) == "OK" if ready is None else ready & (F.col(name) == "OK")
    return out.withColumn("status", F.when(ready, "READY").otherwise("PARTIAL_OR_STALE"))


def event_phases(rows: DataFrame, ts: str, events: DataFrame, at: str, before_s: int, during_s: int, after_s: int) -> DataFrame:
    """`rows` plus phase: DURING within `during_s` of the last event, BEFORE within `before_s` of the next, AFTER within `after_s` of the last one's end, else CLEAR (null stamps too)."""
    e = events.where(F.col(at).isNotNull()).select(F.lit(1).alias("_one"), F.col(at).alias("_at")).distinct()
    r = rows.withColumn("_one", F.lit(1))
    r = asof_join(r, e, by=["_one"], left_time=ts, right_time="_at", values=["_at"], prefix="_last")
    r = asof_join(r, e, by=["_one"], left_time=ts, right_time="_at", values=["_at"], direction="forward", prefix="_next")
    since, until = F.unix_micros(ts) - F.unix_micros("_last_at"), F.unix_micros("_next_at") - F.unix_micros(ts)
    us = 1_000_000
    phase = F.when(since <= during_s * us, "DURING").when(until <= before_s * us, "BEFORE").when(since <= (during_s + after_s) * us, "AFTER").otherwise("CLEAR")
    return r.withColumn("phase", phase).drop("_one", "_lasttime", "_last_at", "_nexttime", "_next_at")
