"""Implausible spikes in measurements: a Kalman filter per series, its innovations and their variance.

Per series and field a local-level model follows the measure in units of the series' usual (median) value. A
reading whose standardised innovation exceeds the threshold is flagged and withheld from the update; readings whose
one-step innovations have lost their variance (over the last STUCK_RUN readings) are flagged as stuck. An exact check
follows: a flagged reading beyond SPIKE_TIMES usual values is a spike, any other a suspect; a flagged reading in a run
of STUCK_RUN equal values is stuck. Only flagged readings are checked. With the default bounds on level and variance
everything beyond LEVEL_MAX + THRESHOLD * sqrt(NOISE_MAX + GAIN_VAR) = 18.1 usual values is flagged.

A series is cut into blocks of time, so no task holds a whole series: a block's filter starts from the series'
median, and runs of equal values are continued across blocks by their first and last run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.text_keys import symbol_key
from tapewright.runtime import cut

FIELDS = ("high", "low", "spread", "tick_volume")
BLOCK_S = 7 * 86_400
THRESHOLD, LEVEL_MAX, NOISE_MIN, NOISE_MAX, DRIFT, GAIN_VAR = 4.0, 6.0, 0.25, 9.0, 0.01, 0.1
SPIKE_TIMES, STUCK_RUN = 22.0, 8

_OUT = "source string, symbol string, block bigint, bar_id bigint, field string, kind string, value double, times double, z double, run_end int, run int"


def _innovations(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Standardised innovations of one block's measures in usual values; flagged ones don't move the level."""
    level, var, noise = 1.0, GAIN_VAR, 1.0
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        if not math.isfinite(v):
            out[i] = 0.0
            continue
        var = min(var + DRIFT, GAIN_VAR)
        s = var + noise
        e = v - level
        z = e / math.sqrt(s)
        out[i] = z
        if abs(z) > threshold:
            continue
        k = var / s
        level = min(max(level + k * e, 0.0), LEVEL_MAX)
        var *= 1.0 - k
        noise = min(max(0.95 * noise + 0.05 * e * e, NOISE_MIN), NOISE_MAX)
    return out


def _no_variance(x: np.ndarray) -> np.ndarray:
    """Whether a reading is among STUCK_RUN ones whose innovations (steps from one reading to the next) have no variance about zero."""
    steps = STUCK_RUN - 1
    if len(x) <= steps:
        return np.zeros(len(x), dtype=bool)
    power = np.abs(np.diff(x))
    gone = np.lib.stride_tricks.sliding_window_view(power, steps).max(axis=1) == 0.0
    return np.convolve(gone, np.ones(STUCK_RUN)) > 0


def _block(cols: dict[str, np.ndarray], null: dict[str, np.ndarray], usual: dict[str, float], fixed: bool, threshold: float = THRESHOLD) -> Iterator[tuple]:
    """Rows (bar_id, field, kind, value, times, z, run_end, run) of one block: cases and the edge runs."""
    ids, o, c = cols["bar_id"], cols["open"], cols["close"]
    top, bottom = np.fmax(o, c), np.fmin(o, c)
    for f in FIELDS:
        v, there = cols[f], ~null[f]
        if f in ("high", "low"):
            bad = ~np.isfinite(v) | (v <= 0)
            bad |= (v < o) | (v < c) if f == "high" else (v > o) | (v > c)
            measure = v - top if f == "high" else bottom - v
        else:
            bad, measure = ~np.isfinite(v) | (v < 0), v
        at = np.flatnonzero(there)
        if not len(at):
            continue
        u = usual[f]
        times = measure[at] / u if u and u > 0 else np.full(len(at), np.nan)
        z = _innovations(times, threshold)
        flagged = z > threshold
        x = v[at]
        vanished = _no_variance(x)
        # the exact check of what is flagged
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        lengths = np.diff(np.r_[starts, len(x)])
        run = np.repeat(lengths, lengths)
        stuck = vanished & (run >= STUCK_RUN) & ~(f == "spread" and fixed)
        spike = flagged & (times > SPIKE_TIMES)
        for i in np.flatnonzero(bad[at] | flagged | stuck):
            j = at[i]
            kind = "impossible" if bad[j] else "spike" if spike[i] else "stuck" if stuck[i] else "suspect"
            yield int(ids[j]), f, kind, float(v[j]), float(times[i]), float(z[i]), None, int(run[i])
        if f == "spread" and fixed:
            continue
        edges = [(0, -1)] if len(starts) == 1 else [(0, -1), (len(starts) - 1, 1)]
        for r, side in edges:
            n, s = int(lengths[r]), int(starts[r])
            end = 0 if len(starts) == 1 else side
            yield None, f, "edge", float(x[s]), None, None, end, n
            if n < STUCK_RUN:
                for i in range(s, s + n):
                    yield int(ids[at[i]]), f, "pending", float(x[i]), float(times[i]), float(z[i]), end, n


def _filter(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by series, block and time; holds one block."""
    schema = pa.schema([("source", pa.string()), ("symbol", pa.string()), ("block", pa.int64()), ("bar_id", pa.int64()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.float64()), ("times", pa.float64()), ("z", pa.float64()), ("run_end", pa.int32()), ("run", pa.int32())])
    rows: list[tuple] = []

    def flush(key: tuple, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts)
        names = ("open", "close", *FIELDS)
        null = {f: t[f].is_null().to_numpy() for f in FIELDS}
        cols = {n: t[n].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names} | {"bar_id": t["bar_id"].to_numpy()}
        usual = {f: t[f"usual_{f}"][0].as_py() for f in FIELDS}
        with np.errstate(all="ignore"):
            rows.extend((*key, *r) for r in _block(cols, null, usual, bool(t["fixed"][0].as_py()), threshold))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, s.type) for x, s in zip(zip(*rows), schema)], schema=schema)

    now, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        src, sym, blk = b["source"].to_pylist(), b["symbol"].to_pylist(), b["block"].to_pylist()
        keys = list(zip(src, sym, blk))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(starts, starts[1:]):
            if keys[i] != now:
                if parts:
                    flush(now, parts)
                now, parts = keys[i], []
            parts.append(b.slice(i, j - i))
        if len(rows) >= 20_000:
            yield batch()
            rows.clear()
    if parts:
        flush(now, parts)
    if rows:
        yield batch()


def flag_spikes(bars: DataFrame, block_s: int = BLOCK_S, threshold: float = THRESHOLD) -> DataFrame:
    """(bar_id, field, kind, value, times, z): implausible high, low, spread and tick_volume values of `bars`.

    kind is impossible, spike, stuck (the first that holds) or suspect: flagged by its innovation, but not beyond what the
    exact rule calls a spike. A higher `threshold` flags less, spikes too. Null values are skipped, rows without timestamp
    left out; resent rows (same series and timestamp) count as one, the smallest bar_id. A series is (source,
    symbol) with the symbol trimmed and upper-cased; null sources or symbols form series of their own. `times` is
    the measure in usual values, null where the series' median is zero or unknown: then there are no spikes.
    """
    key = ["source", "symbol"]
    b = bars.where("timestamp is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(symbol_key("symbol"), F.lit("")).alias("symbol"), F.unix_micros("timestamp").alias("t"), F.struct("bar_id", "open", "close", *FIELDS).alias("r"))
    one = b.groupBy(*key, "t").agg(F.min_by("r", F.col("r.bar_id")).alias("r")).select(*key, "t", "r.*")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    measure = {"high": F.col("high") - top, "low": bottom - F.col("low"), "spread": F.col("spread"), "tick_volume": F.col("tick_volume")}
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    usual = one.groupBy(*key).agg(*[F.percentile_approx(finite(m), 0.5, F.lit(10_000)).alias(f"usual_{f}") for f, m in measure.items()])
    alike = one.where("spread is not null").groupBy(*key, "spread").count().groupBy(*key).agg((F.max("count") * 2 > F.sum("count")).alias("fixed"))
    stats = usual.join(alike, key, "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    blocks = one.join(stats, key).withColumn("block", F.floor(F.col("t") / F.lit(block_s * 1_000_000)))
    out = cut(blocks.repartition(*key, "block").sortWithinPartitions(*key, "block", "t").mapInArrow(partial(_filter, threshold=threshold), _OUT))
    # runs that may go on in the next block: pieces in order, a new island where the value changes or the block has more runs
    w = Window.partitionBy(*key, "field").orderBy("block", "run_end")
    pieces = out.where("kind = 'edge'").select(*key, "field", "block", "run_end", "value", "run")
    new = F.coalesce((F.col("value") != F.lag("value").over(w)) | (F.col("block") == F.lag("block").over(w)) | F.isnan("value"), F.lit(True))
    islands = pieces.withColumn("island", F.sum(new.cast("int")).over(w))
    long = islands.groupBy(*key, "field", "island").agg(F.sum("run").alias("total"), F.collect_list(F.struct("block", "run_end", "run")).alias("p")).where(F.col("total") >= STUCK_RUN)
    long = long.select(*key, "field", F.explode("p").alias("p")).select(*key, "field", "p.block", "p.run_end")
    late = out.where("kind = 'pending'").join(long, [*key, "field", "block", "run_end"], "left_semi").withColumn("kind", F.lit("stuck"))
    cols = ["bar_id", "field", "kind", "value", "times", "z"]
    found = out.where("kind in ('impossible', 'spike', 'stuck', 'suspect')").select(*cols).union(late.select(*cols))
    rank = F.when(F.col("kind") == "impossible", 0).when(F.col("kind") == "spike", 1).when(F.col("kind") == "stuck", 2).otherwise(3)
    return found.groupBy("bar_id", "field").agg(F.min(F.struct(rank.alias("rank"), "kind", "value", "times", "z")).alias("x")).select("bar_id", "field", "x.kind", "x.value", "x.times", "x.z")
