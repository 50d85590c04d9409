"""Rolling totals over trailing periods as a versioned daily state.

The state of a day is yesterday's totals plus today's arrivals minus the amounts that expire today, so a day
costs the same for any period length. Amounts are exact decimals: sums that are added and later taken off
again leave no rounding error, and a corrected history equals a fresh one bit for bit. Corrections
(`advance`) recompute only the days a changed day can reach and give those a new version. `maintained` runs both: the
state of what arrived in time, then the corrections by what came late.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.text_keys import symbol_key
from tapewright.runtime import cut

PERIODS = (7, 30)
#: How long after its stamp a row is received in time; later ones are corrections.
IN_TIME = "1 day"
#: Amounts are held in units of 1e-8; finer digits are rounded half up, values beyond 1e20 become null.
_AMOUNT = "decimal(28,8)"
_TOTAL = "decimal(38,8)"
#: What the state holds of each period.
PARTS = ("volume", "close", "n_close", "n_active")


def _amount(c: str) -> Column:
    """A finite DOUBLE as an exact amount; null, NaN and infinite values are no amounts."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) < 1e20), F.col(c)).try_cast(_AMOUNT)


def daily_amounts(rows: DataFrame) -> DataFrame:
    """(symbol, day, volume, close, active): what each symbol's day holds after resent rows are resolved.

    Rows of one symbol and stamp are one record: the row received last (ties: largest daily_id) counts, field by
    field, passing over null and unusable values. A day sums its records' volume; its close is that of its last
    record that has one. active tells whether any row at all, superseded ones included, has volume above zero.
    Rows without symbol or timestamp are left out. Two aggregations, both pre-aggregated before the shuffle and
    the second on the same leading keys.
    """
    return _days(rows, {"": F.lit(True)}).select("symbol", "day", "volume", "close", "active")


def _days(rows: DataFrame, views: dict[str, Column]) -> DataFrame:
    """(symbol, day, and with each view's prefix held, volume, close, active): `daily_amounts` of several selections of the rows in one pass; held tells whether a view has any row of the day."""
    order = F.struct("received_at", "daily_id")
    r = rows.where("symbol is not null and timestamp is not null").select(
        symbol_key("symbol").alias("symbol"), "timestamp", F.to_date("timestamp").alias("day"), order.alias("o"), _amount("volume").alias("volume"), _amount("close").alias("close"),
        F.coalesce((F.col("volume") > 0) & ~F.isnan("volume"), F.lit(False)).alias("active"), *[v.alias(f"_in_{p}") for p, v in views.items()],
    )
    last = lambda p, c: F.max(F.when(F.col(f"_in_{p}") & F.col(c).isNotNull(), F.struct("o", c)))[c].alias(p + c)
    records = r.groupBy("symbol", "day", "timestamp").agg(*[x for p in views for x in (F.max(f"_in_{p}").alias(f"{p}held"), last(p, "volume"), last(p, "close"), F.max(F.col("active") & F.col(f"_in_{p}")).alias(f"{p}active"))])
    return records.groupBy("symbol", "day").agg(*[
        x for p in views for x in (
            F.max(f"{p}held").alias(f"{p}held"),
            F.coalesce(F.sum(f"{p}volume"), F.lit(0)).cast(_TOTAL).alias(f"{p}volume"),
            F.max(F.when(F.col(f"{p}close").isNotNull(), F.struct("timestamp", f"{p}close")))[f"{p}close"].cast(_TOTAL).alias(f"{p}close"),
            F.max(f"{p}active").alias(f"{p}active"),
        )
    ])


def _amounts(daily: DataFrame, parts: tuple[str, ...]) -> list[Column]:
    have = {"volume": F.col("volume"), "close": F.coalesce("close", F.lit(0)).cast(_TOTAL), "n_close": F.when(F.col("close").isNotNull(), 1).otherwise(0), "n_active": F.when(F.col("active"), 1).otherwise(0)}
    return [_typed(p, have[p]) for p in parts]


def _names(parts: tuple[str, ...], periods: tuple[int, ...]) -> list[str]:
    """The state's totals; those of one day are the day's own amounts."""
    return [f"{p}_{n}" for n in (1, *periods) for p in parts]


def _typed(name: str, value: Column) -> Column:
    return value.cast(_TOTAL if name.startswith(("volume", "close")) else "bigint").alias(name)


def _with_live(state: DataFrame) -> DataFrame:
    """`state` plus live: whether the day lies between the symbol's first and last active day."""
    active = F.when(F.col("n_active_1") > 0, F.col("day"))
    ends = state.groupBy("symbol").agg(F.min(active).alias("_a"), F.max(active).alias("_b"))
    return state.join(ends, "symbol").withColumn("live", F.coalesce(F.col("day").between(F.col("_a"), F.col("_b")), F.lit(False))).drop("_a", "_b")


def rolling_state(daily: DataFrame, periods: tuple[int, ...] = PERIODS, version: int = 1, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The whole state: one row per symbol and calendar day between its first and last day with any row.

    For each period N, and for the day itself (N = 1): volume_N, close_N (totals), n_close_N (days with a close), n_active_N
    (active days), as far as `parts` names them (n_active always); live tells whether the day lies between the first and the
    last active day. Yesterday's totals, plus what arrives today, minus what arrived N days ago and expires, are today's.
    One shuffle by symbol of day amounts, at most the calendar's days per symbol; days without a row are made behind it.
    """
    w = Window.partitionBy("symbol").orderBy("day")
    d = daily.select("symbol", "day", *_amounts(daily, parts)).repartition("symbol")
    d = d.withColumn("_next", F.coalesce(F.date_sub(F.lead("day").over(w), 1), "day"))
    d = d.select("symbol", F.col("day").alias("_of"), *parts, F.explode(F.sequence("day", "_next")).alias("day"))
    d = d.select("symbol", "day", *[_typed(f"{p}_1", F.when(F.col("day") == F.col("_of"), F.col(p)).otherwise(0)) for p in parts])
    change = d.select("*", *[_typed(f"{p}_{n}", F.col(f"{p}_1") - F.coalesce(F.lag(f"{p}_1", n).over(w), F.lit(0))) for n in periods for p in parts])
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol")
    active = F.when(F.col("n_active_1") > 0, F.col("day"))
    live = F.coalesce(F.col("day").between(F.min(active).over(whole), F.max(active).over(whole)), F.lit(False)).alias("live")
    return change.select("symbol", "day", *[f"{p}_1" for p in parts], *[_typed(f"{p}_{n}", F.sum(f"{p}_{n}").over(upto)) for n in periods for p in parts], live, F.lit(version).alias("version"))


def _extension(state: DataFrame, after: DataFrame, periods: tuple[int, ...], parts: tuple[str, ...]) -> DataFrame:
    """Days that `after` adds to the symbols' ranges, with the totals that expiring amounts leave of the last day's; version 0."""
    names = _names(parts, periods)
    old = state.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    new = after.groupBy("symbol").agg(F.min("day").alias("na"), F.max("day").alias("nb")).join(old, "symbol", "left")
    new = cut(new.where("a is null or na < a or nb > b"))
    span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<date>"))
    more = F.when(F.col("a").isNull(), F.sequence("na", "nb")).otherwise(F.concat(span(F.col("na"), F.date_sub("a", 1)), span(F.date_add("b", 1), F.col("nb"))))
    days = new.select("symbol", F.explode(more).alias("day"))
    # only the last days of the symbols that grow can still expire: the last day's totals, then what leaves them
    tail = state.join(new.where("nb > b").select("symbol", "b"), "symbol").where(F.col("day") > F.date_sub("b", max(periods)))
    goes = F.array(*[F.struct(F.date_add("day", n).alias("day"), *[_typed(f"{p}_{m}", -F.col(f"{p}_1") if m == n else F.lit(0)) for m in (1, *periods) for p in parts]) for n in (1, *periods)])
    goes = F.filter(goes, lambda x: x["day"] > F.col("b"))
    here = F.filter(F.array(F.struct("day", *[_typed(c, F.col(c)) for c in names])), lambda _: F.col("day") == F.col("b"))
    events = tail.select("symbol", F.explode(F.concat(goes, here)).alias("x")).select("symbol", "x.*", F.lit(False).alias("added"))
    events = events.union(days.select("symbol", "day", *[_typed(c, F.lit(0)) for c in names], F.lit(True).alias("added")))
    per_day = events.groupBy("symbol", "day").agg(*[_typed(c, F.sum(c)) for c in names], F.max("added").alias("added"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("symbol", "day", "added", *[_typed(c, F.sum(c).over(w)) for c in names]).where("added").select("symbol", "day", *names, F.lit(False).alias("live"), F.lit(0).alias("version"))


def advance(state: DataFrame, before: DataFrame, after: DataFrame, periods: tuple[int, ...] = PERIODS, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The state's new and recomputed rows once the day amounts `before` have become `after`.

    Both need to hold only the days that arrivals touch (`before` lacks days that had no row). A changed day reaches itself and
    the N - 1 days after it: only those are recomputed, old totals plus the summed differences, under the next version; so are
    days that join or leave the span between the first and last active day. Days beyond the old range start from the totals
    of its last day less what expires, at version 1. Returned rows replace those of their (symbol, day), see `applied`; no
    row ever goes, so a day that is no longer live keeps its version. Nothing changed gives no rows.
    """
    keys, names, every = ["symbol", "day"], _names(parts, periods), (1, *periods)
    old, new = (d.select(*keys, *_amounts(d, parts)) for d in (before, after))
    diff = old.select(*keys, *[(-F.col(p)).alias(p) for p in parts]).union(new.select(*keys, *parts)).groupBy(*keys).agg(*[F.sum(p).alias(p) for p in parts])
    diff = diff.where(" or ".join(f"{p} <> 0" for p in parts))
    # as many rows as are rewritten
    shift = F.explode(F.sequence(F.lit(0), F.lit(max(periods) - 1)))
    reach = diff.withColumn("ago", shift).select("symbol", F.date_add("day", F.col("ago")).alias("day"), *[F.when(F.col("ago") < n, F.col(p)).otherwise(0).alias(f"{p}_{n}") for n in every for p in parts])
    delta = reach.groupBy(*keys).agg(*[F.sum(c).alias(f"d_{c}") for c in names], F.lit(True).alias("touched"))
    rows = state.select(*keys, *names, "live", "version").unionByName(_extension(state, after, periods, parts))
    moved = rows.join(after.select("symbol").distinct(), "symbol", "left_semi").join(delta, keys, "left")
    moved = moved.select(*keys, *[_typed(c, F.col(c) + F.coalesce(F.col(f"d_{c}"), F.lit(0))) for c in names], F.col("live").alias("was"), "version", F.coalesce("touched", F.lit(False)).alias("touched"))
    moved = _with_live(moved).where("touched or live <> was or version = 0")
    return moved.select(*keys, *names, "live", (F.col("version") + 1).alias("version"))


def applied(state: DataFrame, changed: DataFrame) -> DataFrame:
    """`state` with the rows of `changed` in place of those of their (symbol, day)."""
    return state.join(changed.select("symbol", "day"), ["symbol", "day"], "left_anti").unionByName(changed)


def maintained(rows: DataFrame, in_time: str = IN_TIME, periods: tuple[int, ...] = PERIODS, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The state after its corrections: built from the rows received within `in_time` of their stamp, then advanced by the others.

    Only days that a late row touches are compared. A null received_at is in time. `parts` are the amounts that are kept; with
    fewer of them a version counts the changes of those.
    """
    late = F.coalesce(F.col("received_at") > F.col("timestamp") + F.expr(f"interval {in_time}"), F.lit(False))
    needed = [c for c in ("volume", "close", "active") if c in parts or (c == "close" and "n_close" in parts) or (c == "active" and "n_active" in parts)]
    # one pass over the rows gives each day as it was in time and as it is now
    both = _days(rows, {"was_": ~late, "is_": F.lit(True), "late_": late})
    both = cut(both.select("symbol", "day", "was_held", "late_held", *[f"{p}{c}" for p in ("was_", "is_") for c in needed]))
    view = lambda p, rows: both.where(rows).select("symbol", "day", *[F.col(f"{p}{c}").alias(c) for c in needed])
    state = cut(rolling_state(view("was_", "was_held"), periods, parts=parts))
    changed = advance(state, view("was_", "was_held and late_held"), view("is_", "late_held"), periods, parts)
    return applied(state, cut(changed))


def trailing_report(state: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """One row per symbol, day and period: totals and averages of volume and close.

    avg_volume is the total over the period's days (days without activity count as zero), avg_close over the
    days that have a close (null where none has); idle tells that no day of the period is active.
    """
    def one(n: int) -> DataFrame:
        return state.where("live").select("symbol", "day", F.lit(n).alias("period_days"), F.col(f"volume_{n}").cast("double").alias("total_volume"), (F.col(f"volume_{n}").cast("double") / n).alias("avg_volume"), F.col(f"close_{n}").cast("double").alias("total_close"), F.try_divide(F.col(f"close_{n}").cast("double"), F.col(f"n_close_{n}").cast("double")).alias("avg_close"), (F.col(f"n_active_{n}") == 0).alias("idle"), "version")

    return reduce(DataFrame.union, map(one, periods))


def idle_periods(state: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(symbol, day, period_days): days with no active day in the whole trailing period."""
    found = F.filter(F.array(*[F.when(F.col(f"n_active_{n}") == 0, F.lit(n)) for n in periods]), lambda x: x.isNotNull())
    return state.where("live").select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(found).alias("period_days"))
