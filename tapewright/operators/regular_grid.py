"""Irregular readings onto a regular grid by shape-preserving monotone cubic interpolation.

Every usable reading is a knot (equal stamps count once, pre-aggregated before the shuffle). A series is cut into shards of
SHARD_PERIODS periods, so a task holds what falls into few hundred periods whatever a series' size. Shards of a series
exchange halo knots: each learns the last knot before it and the first two behind it from the shards' summaries, however
far away they are. A gap is filled by the cubic between the last reading before and the first one behind it. All of it is
built-in expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.text_keys import symbol_key

#: Seconds of a period by timeframe (fixed values of the data model).
PERIOD_S = {"S10": 10, "M1": 60, "M5": 300, "M15": 900, "H1": 3600}
SHARD_PERIODS = 512
#: Most periods in a row that are filled; longer gaps are marked.
MAX_GAP = 12
_CHUNK = 8192


def _inner(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the secants, zero at a turn."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end(h: Column, d: Column, h2: Column, d2: Column) -> Column:
    """One-sided three-point slope, kept from overshooting."""
    s = ((2 * h + h2) * d - h * d2) / (h + h2)
    return F.when(s * d <= 0, F.lit(0.0)).when((d * d2 <= 0) & (F.abs(s) > 3 * F.abs(d)), 3 * d).otherwise(s)


def regular_grid(readings: DataFrame, max_gap: int = MAX_GAP, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """(source, symbol, timeframe, slot_epoch, close, status, n_readings): one row per period of each series.

    From the first to the last period with a usable reading (close neither null nor NaN; timestamp and a
    known timeframe given). status is `observed` (close is the period's last usable reading; equal stamps:
    the one received last, then the largest reading_id), `filled` (a gap of at most `max_gap` periods, interpolated at
    the period's start within its segment) or `gap` (longer gaps, close null; segments end there). Symbols are
    trimmed and upper-cased. Infinite readings are usable but make what is filled from them null.
    """
    key = ["source", "symbol", "timeframe"]
    period = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in PERIOD_S.items()]).cast("bigint")
    usable = readings.where(F.col("close").isNotNull() & ~F.isnan("close") & F.col("timestamp").isNotNull() & F.trim("timeframe").isin(*PERIOD_S))
    r = usable.select("source", symbol_key("symbol").alias("symbol"), F.trim("timeframe").alias("timeframe"), F.unix_micros("timestamp").alias("t"), "received_at", "reading_id", "close")
    r = r.withColumn("slot", F.floor(F.col("t") / (period * 1_000_000)))
    knots = r.groupBy(*key, F.floor(F.col("slot") / F.lit(shard_periods)).alias("shard"), "slot", "t").agg(F.max(F.struct("received_at", "reading_id", "close")).alias("x"), F.count("*").alias("n"))
    knots = knots.select(*key, "shard", "slot", F.struct("slot", (F.col("t") / 1e6).alias("t"), F.col("x.close").alias("v"), "n").alias("k"))
    # the exchange is stated, and all it carries is in one column, so that both uses of the shards share it
    shards = knots.repartition(*key, "shard")
    w = Window.partitionBy(*key, "shard").orderBy("slot", "k")
    inside = shards.select(*key, "shard", "slot", F.sum("k.n").over(Window.partitionBy(*key, "shard", "slot")).alias("n"), "k", F.row_number().over(w).alias("rn"), F.lag("k").over(w).alias("p0"), F.lead("k").over(w).alias("q0"), F.lead("k", 2).over(w).alias("r0"))
    summary = inside.groupBy(*key, "shard").agg(F.max(F.when(F.col("rn") == 1, F.col("k"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("k"))).alias("second"), F.max("k").alias("last"))
    s = Window.partitionBy(*key).orderBy("shard")
    halo = summary.select(*key, "shard", F.lag("last").over(s).alias("hp"), F.lead("first").over(s).alias("hq"), F.coalesce(F.lead("second").over(s), F.lead("first", 2).over(s)).alias("hr"))
    # only a period's last reading is followed by other periods
    ends = inside.where("q0 is null or q0.slot > slot")
    cond = reduce(lambda a, b: a & b, (F.col(f"i.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*key, "shard")))
    k = ends.alias("i").join(halo.alias("h"), cond, "left")
    k = k.select(*[F.col(f"i.{c}").alias(c) for c in key], "slot", "n", "k", F.coalesce("p0", "hp").alias("p"), F.coalesce("q0", "hq").alias("q"), F.coalesce(F.col("r0"), F.when(F.col("q0").isNotNull(), F.col("hq")).otherwise(F.col("hr"))).alias("r"))
    # slopes belong to the knots, before the periods are made
    far = lambda a, b: F.coalesce(b - a - 1 <= max_gap, F.lit(False))
    k = k.select(
        *key, "slot", "n", F.col("k.t").alias("t"), F.col("k.v").alias("v"), F.col("q.slot").alias("q_slot"), F.col("q.v").alias("q_v"),
        (F.col("k.t") - F.col("p.t")).alias("h0"), (F.col("q.t") - F.col("k.t")).alias("h1"), (F.col("r.t") - F.col("q.t")).alias("h2"),
        (F.col("k.v") - F.col("p.v")).alias("e0"), (F.col("q.v") - F.col("k.v")).alias("e1"), (F.col("r.v") - F.col("q.v")).alias("e2"),
        far(F.col("p.slot"), F.col("slot")).alias("from_p"), far(F.col("slot"), F.col("q.slot")).alias("to_q"), far(F.col("q.slot"), F.col("r.slot")).alias("to_r"),
    )
    k = k.withColumns({f"d{i}": F.col(f"e{i}") / F.col(f"h{i}") for i in range(3)})
    h0, h1, h2, d0, d1, d2 = (F.col(x) for x in ("h0", "h1", "h2", "d0", "d1", "d2"))
    k = k.withColumns({
        "left": F.when(F.col("from_p"), _inner(h0, d0, h1, d1)).when(F.col("to_r"), _end(h1, d1, h2, d2)).otherwise(d1),
        "right": F.when(F.col("to_r"), _inner(h1, d1, h2, d2)).when(F.col("from_p"), _end(h1, d1, h0, d0)).otherwise(d1),
        "end": F.coalesce("q_slot", F.col("slot") + 1) - 1,
    })
    spans = k.withColumn("chunk", F.explode(F.sequence("slot", "end", F.lit(_CHUNK).cast("bigint"))))
    grid = spans.withColumn("at", F.explode(F.sequence("chunk", F.least(F.col("chunk") + _CHUNK - 1, "end"))))
    grid = grid.withColumn("u", (F.col("at") * period - F.col("t")) / h1)
    u = F.col("u")
    grid = grid.withColumn("value", (1 + 2 * u) * (1 - u) * (1 - u) * F.col("v") + u * (1 - u) * (1 - u) * h1 * F.col("left") + u * u * (3 - 2 * u) * F.col("q_v") + u * u * (u - 1) * h1 * F.col("right"))
    finite = F.when(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.col("value"))
    here = F.col("at") == F.col("slot")
    status = F.when(here, "observed").when(F.col("to_q"), "filled").otherwise("gap")
    return grid.select(*key, (F.col("at") * period).alias("slot_epoch"), F.when(here, F.col("v")).when(F.col("to_q"), finite).alias("close"), status.alias("status"), F.when(here, F.col("n")).otherwise(0).alias("n_readings"))
