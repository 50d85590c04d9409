"""Data quality: gaps, missing periods, duplicates, outliers, validity, one report per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.operators.orderstats import at_index, ordered_counts


def _with_previous(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str]) -> DataFrame:
    f = Frames(keys=(*keys, "block"))
    b = with_halo(numbered(df.where(F.col(ts).isNotNull()), keys, ts, ties), before=1)
    return b.withColumn("prev", f.lag(ts)).where("not halo").drop("block", "halo")


def gaps(df: DataFrame, keys: Sequence[str], ts: str, period_s: Column, ties: Sequence[str], factor: float = 1.0) -> DataFrame:
    """(keys, from, to, missing): neighbours further apart than period * factor; missing is round-half-even(delta / period) - 1."""
    p = _with_previous(df.withColumn("_p", period_s.cast("bigint")), keys, ts, ties)
    delta = (F.unix_micros(ts) - F.unix_micros("prev")) / 1e6
    return p.where(delta > F.col("_p") * factor).select(*keys, F.col("prev").alias("from"), F.col(ts).alias("to"), (F.bround(delta / F.col("_p")) - 1).cast("bigint").alias("missing"))


def missing_periods(df: DataFrame, keys: Sequence[str], ts: str, period_s: Column, ties: Sequence[str], tolerance_s: int = 60) -> DataFrame:
    """(keys, expected): each stamp prev + k * period that lies more than the tolerance before the next row."""
    p = _with_previous(df.withColumn("_p", period_s.cast("bigint")), keys, ts, ties)
    us = F.unix_micros
    first, last = us("prev") + F.col("_p") * 1_000_000, us(ts) - tolerance_s * 1_000_000 - 1
    n = F.floor((last - first) / (F.col("_p") * 1_000_000)) + 1
    return p.where((F.col("prev").isNotNull()) & (n > 0)).select(*keys, F.explode(F.sequence(first, last, F.col("_p").cast("bigint") * 1_000_000)).alias("_e")).select(*keys, F.timestamp_micros("_e").alias("expected"))


def duplicates(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """(keys, first, duplicate): every later row of a key with the key's smallest id. The firsts are pre-aggregated."""
    first = df.groupBy(*keys).agg(F.min(row_id).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.select(*keys, row_id).join(first, list(keys)).where(F.col(row_id) > F.col("first")).select(*keys, "first", F.col(row_id).alias("duplicate"))


def price_outliers(df: DataFrame, keys: Sequence[str], value: str, row_id: str, z: float = 3.0) -> DataFrame:
    """(row_id, z): rows beyond z population deviations of their key, if it has four rows or more."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n")).where("_n >= 4 and _s > 0")
    s = (F.col(value) - F.col("_m")) / F.col("_s")
    return df.select(*keys, row_id, value).join(g, list(keys)).withColumn("z", s).where(F.abs("z") > z).select(row_id, "z")


def volume_outliers(df: DataFrame, keys: Sequence[str], value: str, row_id: str, k: float = 1.5) -> DataFrame:
    """(row_id, low, high): rows outside quartile fences; quartiles are picks at positions n // 4 and 3 n // 4."""
    oc = ordered_counts(df, keys, value)
    q = oc.groupBy(*keys).agg(at_index(value, F.floor(F.col("total") / 4)).alias("q1"), at_index(value, F.floor(F.col("total") * 3 / 4)).alias("q3"))
    q = q.select(*keys, (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    return df.select(*keys, row_id, value).join(q, list(keys)).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(row_id, "low", "high")


def valid_bar() -> Column:
    """Positive prices, high on top, low at the bottom, volume not negative; null and NaN are not valid."""
    ok = None
    for c in ("open", "high", "low", "close"):
        x = (F.col(c) > 0) & ~F.isnan(c)
        ok = x if ok is None else ok & x
    ok = ok & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(ok & F.coalesce((F.col("volume") >= 0) & ~F.isnan("volume"), F.lit(True)), F.lit(False))


def quality_report(df: DataFrame, keys: Sequence[str], ts: str, period_s: Column, row_id: str) -> DataFrame:
    """One row per key: rows, valid, duplicates, gaps, missing, first, last, trading days, score in [0, 1].

    score: the valid share less capped penalties for missing periods, duplicates and gaps.
    """
    d = df.withColumn("_p", period_s)
    base = d.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(F.when(valid_bar(), 1)).alias("valid"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(F.to_date(ts)).alias("days"), F.max("_p").alias("_period"))
    dup = d.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg((F.count("*") - 1).alias("k")).groupBy(*keys).agg(F.sum("k").alias("duplicates"))
    g = gaps(d.drop("_p"), keys, ts, period_s, [row_id]).groupBy(*keys).agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing"))
    r = base.join(dup, list(keys), "left").join(g, list(keys), "left").fillna(0, ["duplicates", "gaps", "missing"])
    n = F.col("rows").cast("double")
    score = F.col("valid") / n - F.least(F.col("missing") / (n + F.col("missing")), F.lit(0.3)) - F.least(F.col("duplicates") / n, F.lit(0.2)) - F.least(F.col("gaps") / n, F.lit(0.1))
    return r.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("_period")


def leakage(rows: DataFrame, role: str, ts: str, label_end: str) -> DataFrame:
    """(earlier, later, last_label, first_row, leaks): label ends of one role against the first row of the next (train, validation, test)."""
    g = rows.groupBy(role).agg(F.min(ts).alias("a"), F.max(label_end).alias("z"))
    order = F.when(F.col(role) == "train", 0).when(F.col(role) == "validation", 1).otherwise(2)
    x = g.withColumn("o", order)
    y = x.select(F.col(role).alias("later"), F.col("a").alias("first_row"), (F.col("o") - 1).alias("o"))
    return x.join(y, "o").select(F.col(role).alias("earlier"), "later", F.col("z").alias("last_label"), "first_row", (F.col("z") >= F.col("first_row")).alias("leaks"))


def temporal_integrity(df: DataFrame, keys: Sequence[str], order: str, ts: str, known: str) -> DataFrame:
    """(keys, events, missing, out_of_order, duplicates, known_early): what breaks the order of events by `order`, a BIGINT that is unique.

    out_of_order counts stamps below that of the event before (events without one are passed over), duplicates the repeats of a
    stamp, known_early what was received before its stamp. Blocks with a halo row split a hot key.
    """
    f = Frames(keys=(*keys, "block"))
    g = df.groupBy(*keys).agg(F.count("*").alias("events"), F.count(F.when(F.col(ts).isNull(), 1)).alias("missing"), F.count(F.when(F.col(known) < F.col(ts), 1)).alias("known_early"))
    d = df.where(F.col(ts).isNotNull()).select(*keys, order, F.col(ts).alias("_ts"), F.timestamp_micros(F.col(order) * 1_000_000).alias("_at"))
    o = with_halo(numbered(d, keys, "_at", [order]), before=1).withColumn("_p", f.lag("_ts")).where("not halo").groupBy(*keys).agg(F.count(F.when(F.col("_ts") < F.col("_p"), 1)).alias("out_of_order"))
    c = d.groupBy(*keys, "_ts").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    return g.join(o, list(keys), "left").join(c, list(keys), "left").fillna(0, ["out_of_order", "duplicates"]).select(*keys, "events", "missing", "out_of_order", "duplicates", "known_early")


def numeric_parity(df: DataFrame, a: str, b: str, absolute: float, relative: float) -> DataFrame:
    """One row: compared, mismatches, max_absolute, max_relative, equal. Values agree within either tolerance, or if both are missing; rows with both missing aren't counted."""
    x, y = F.col(a), F.col(b)
    none = lambda c: c.isNull() | F.isnan(c)
    gap = F.abs(x - y)
    rel = F.try_divide(gap, F.greatest(F.abs(x), F.abs(y)))
    bad = none(x) | none(y) | ~((gap <= absolute) | (rel <= relative))
    d = df.where(~(none(x) & none(y)))
    return d.agg(F.count("*").alias("compared"), F.count(F.when(bad, 1)).alias("mismatches"), F.max(gap).alias("max_absolute"), F.max(rel).alias("max_relative")).withColumn("equal", F.col("mismatches") == 0)


def calendar_density(events: DataFrame, day: str, kind: str, severe: Column) -> DataFrame:
    """(day, kind, events, severe, share): events per day and kind, how many are severe, the kind's share of the day."""
    g = events.groupBy(day, kind).agg(F.count("*").alias("events"), F.count(F.when(severe, 1)).alias("severe"))
    t = g.groupBy(day).agg(F.sum("events").alias("_t"))
    return g.join(t, day).withColumn("share", F.col("events") / F.col("_t")).drop("_t")
