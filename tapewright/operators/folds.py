"""Ordered recursions over series: each row's output depends on all rows before it through a small state.

A fold runs in one pass over rows sorted by key and order and keeps only the state, never the rows. Recursions
that forget (exponential and Wilder averages) run in blocks with a halo of WARM rows per period, after which what
came before weighs less than 1e-17, so a hot series is split. State machines that don't forget run per series: one
task streams a series, many series run side by side.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql import types as T

#: Halo rows per period of a forgetting recursion.
WARM = 40

Step = Callable[..., tuple]
_ARROW = {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], keep: Sequence[str], make: Callable[[], Step], outputs: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """`keep` and `outputs` of each row: make() gives a fresh step per key, step(*inputs) gives the row's outputs.

    Rows are hash-partitioned by `keys` and sorted; batches stream through, so memory doesn't grow with a series.
    Null inputs reach the step as None.
    """
    nk, ni = len(keys), len(inputs)
    fields = {f.name: f for f in df.schema.fields}
    schema = StructType([fields[c] for c in keep] + [T.StructField(n, t) for n, t in outputs])
    out_types = [_ARROW[type(t)] for _, t in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[: nk + ni]]
            made = []
            for row in zip(*cols):
                if row[:nk] != now:
                    now, step = row[:nk], make()
                made.append(step(*row[nk:]))
            if made:
                arrays = [*b.columns[nk + ni :], *(pa.array(x, t) for x, t in zip(zip(*made), out_types))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    picked = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [*[f"k{i}" for i in range(nk)], *[f"i{i}" for i in range(ni)], *keep]
    return picked.select(*[picked[c].alias(n) for c, n in zip([*keys, *inputs, *keep], names)]).mapInArrow(run, schema)


def ordered_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], keep: Sequence[str], make: Callable[[], Callable[..., list[tuple]]], outputs: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Like `ordered_fold`, but step(*inputs) gives any number of output rows, each with the row's `keep`."""
    nk, ni = len(keys), len(inputs)
    fields = {f.name: f for f in df.schema.fields}
    schema = StructType([fields[c] for c in keep] + [T.StructField(n, t) for n, t in outputs])
    out_types = [_ARROW[type(t)] for _, t in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[: nk + ni]]
            made, at = [], []
            for i, row in enumerate(zip(*cols)):
                if row[:nk] != now:
                    now, step = row[:nk], make()
                for x in step(*row[nk:]):
                    made.append(x)
                    at.append(i)
            if made:
                kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[nk + ni :]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(zip(*made), out_types))], names=schema.names)

    picked = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [*[f"k{i}" for i in range(nk)], *[f"i{i}" for i in range(ni)], *keep]
    return picked.select(*[picked[c].alias(n) for c, n in zip([*keys, *inputs, *keep], names)]).mapInArrow(run, schema)


def series_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], make: Callable[[], tuple[Callable, Callable[[], list[tuple]]]], outputs: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """`keys` and the rows that a series ends with: make() gives (step, finish), step(*inputs) takes a row, finish() gives the outputs."""
    nk = len(keys)
    fields = {f.name: f for f in df.schema.fields}
    schema = StructType([fields[c] for c in keys] + [T.StructField(n, t) for n, t in outputs])
    types = [*[None] * nk, *[_ARROW[type(t)] for _, t in outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = step = finish = None
        key_types: list = []

        def close() -> pa.RecordBatch:
            rows = [(*now, *x) for x in finish()]
            return pa.RecordBatch.from_arrays([pa.array(x, t or k) for x, t, k in zip(zip(*rows), types, [*key_types, *types])], names=schema.names)

        for b in batches:
            key_types = [c.type for c in b.columns[:nk]]
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:nk] != now:
                    if finish and (last := close()).num_rows:
                        yield last
                    now = row[:nk]
                    step, finish = make()
                step(*row[nk:])
        if finish and (last := close()).num_rows:
            yield last

    picked = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [*[f"k{i}" for i in range(nk)], *[f"i{i}" for i in range(len(inputs))]]
    return picked.select(*[picked[c].alias(n) for c, n in zip([*keys, *inputs], names)]).mapInArrow(run, schema)


# averages

def ema(n: int, seed: str = "first") -> Step:
    """Exponential average, weight 2 / (n + 1). seed `first`: starts at the first value; `mean`: at the mean of the first n, null before."""
    a, e, got = 2.0 / (n + 1), None, []

    def step(x: float | None) -> float | None:
        nonlocal e
        if x is None:
            return e
        if e is not None:
            e += a * (x - e)
        elif seed == "first":
            e = x
        else:
            got.append(x)
            if len(got) == n:
                e = sum(got) / n
        return e

    return step


def wilder(n: int) -> Step:
    """Running mean with weight 1 / n, starting at the mean of the first n values; null before."""
    e, got = None, []

    def step(x: float | None) -> float | None:
        nonlocal e
        if x is None:
            return e
        if e is not None:
            e = (e * (n - 1) + x) / n
        else:
            got.append(x)
            if len(got) == n:
                e = sum(got) / n
        return e

    return step


def macd(fast: int = 12, slow: int = 26, signal: int = 9, seed: str = "first") -> Step:
    """(line, signal, histogram)."""
    a, b, c = ema(fast, seed), ema(slow, seed), ema(signal, seed)

    def step(x: float) -> tuple:
        f, s = a(x), b(x)
        if f is None or s is None:
            return None, None, None
        m = f - s
        g = c(m)
        return m, g, None if g is None else m - g

    return step


def rsi(n: int = 14) -> Step:
    """Relative strength with Wilder averages; 100 without losses."""
    up, down, last = wilder(n), wilder(n), None

    def step(x: float) -> tuple:
        nonlocal last
        if last is None:
            last = x
            return (None,)
        d, last = x - last, x
        g, lo = up(max(d, 0.0)), down(max(-d, 0.0))
        if g is None:
            return (None,)
        return (100.0 if lo == 0 else 100 - 100 / (1 + g / lo),)

    return step


def _true_range(h: float, lo: float, last: float | None) -> float:
    return h - lo if last is None else max(h - lo, abs(h - last), abs(lo - last))


def atr(n: int = 14) -> Step:
    """Wilder average of true ranges, the first being the bar's own range."""
    w, last = wilder(n), None

    def step(h: float, lo: float, c: float) -> tuple:
        nonlocal last
        tr, last = _true_range(h, lo, last), c
        return (w(tr),)

    return step


def keltner(n: int = 20, atr_n: int = 10, k: float = 2.0) -> Step:
    """(middle, upper, lower): exponential average plus and minus k average true ranges."""
    e, a = ema(n), atr(atr_n)

    def step(h: float, lo: float, c: float) -> tuple:
        m, r = e(c), a(h, lo, c)[0]
        return m, None if r is None else m + k * r, None if r is None else m - k * r

    return step


def mfi(n: int = 14) -> Step:
    """Money flow index with Wilder-smoothed flows; 100 without negative flow."""
    up, down, last = wilder(n), wilder(n), None

    def step(h: float, lo: float, c: float, v: float) -> tuple:
        nonlocal last
        t = (h + lo + c) / 3
        if last is None:
            last = t
            return (None,)
        p, q = up(t * v if t > last else 0.0), down(t * v if t < last else 0.0)
        last = t
        return (None if p is None else 100.0 if q == 0 else 100 - 100 / (1 + p / q),)

    return step


def directional(n: int = 14) -> Step:
    """(+DI, -DI, ADX, ADXR) with Wilder averages; no true range leaves the index null."""
    tr_, up_, dn_, adx_ = wilder(n), wilder(n), wilder(n), wilder(n)
    h0 = l0 = c0 = None
    past: list[float] = []

    def step(h: float, lo: float, c: float) -> tuple:
        nonlocal h0, l0, c0
        if c0 is None:
            h0, l0, c0 = h, lo, c
            return None, None, None, None
        u, d = h - h0, l0 - lo
        t = tr_(_true_range(h, lo, c0))
        p, m = up_(u if u > d and u > 0 else 0.0), dn_(d if d > u and d > 0 else 0.0)
        h0, l0, c0 = h, lo, c
        if not t:
            return None, None, None, None
        p, m = 100 * p / t, 100 * m / t
        a = adx_(100 * abs(p - m) / (p + m) if p + m else 0.0)
        r = None
        if a is not None:
            past.append(a)
            if len(past) > n:
                r = (a + past.pop(0)) / 2
        return p, m, a, r

    return step


# state machines

def supertrend(n: int = 10, k: float = 3.0) -> Step:
    """(line, trend): bands of k average true ranges that only tighten until the close crosses them."""
    a = atr(n)
    up = dn = last = None
    trend = 1

    def step(h: float, lo: float, c: float) -> tuple:
        nonlocal up, dn, last, trend
        r = a(h, lo, c)[0]
        if r is None:
            last = c
            return None, None
        mid = (h + lo) / 2
        u, d = mid + k * r, mid - k * r
        if up is not None:
            u = u if u < up or last > up else up
            d = d if d > dn or last < dn else dn
            if trend == 1 and c < d:
                trend = -1
            elif trend == -1 and c > u:
                trend = 1
        up, dn, last = u, d, c
        return (d if trend == 1 else u), trend

    return step


def parabolic(step_: float = 0.02, most: float = 0.2) -> Step:
    """(stop, trend): parabolic stop and reverse. It starts at the second bar, upwards unless that closes below the first."""
    bars: list[tuple[float, float]] = []
    sar = ep = af = first = None
    up = True

    def step(h: float, lo: float, c: float) -> tuple:
        nonlocal sar, ep, af, up, first
        if not bars:
            bars.append((h, lo))
            first = c
            return None, None
        if sar is None:
            up = c >= first
            sar, ep, af = (bars[-1][1], h, step_) if up else (bars[-1][0], lo, step_)
        else:
            sar += af * (ep - sar)
            near = bars[-2:]
            sar = min(sar, *(x[1] for x in near)) if up else max(sar, *(x[0] for x in near))
            if (lo < sar) if up else (h > sar):
                up, sar, ep, af = not up, ep, (h if not up else lo), step_
            elif up and h > ep:
                ep, af = h, min(af + step_, most)
            elif not up and lo < ep:
                ep, af = lo, min(af + step_, most)
        bars.append((h, lo))
        del bars[:-2]
        return sar, 1 if up else -1

    return step


def kalman(q: float = 1e-5, r: float = 0.01) -> Step:
    """(level, variance): scalar Kalman filter from the first value."""
    x, p = None, 1.0

    def step(z: float) -> tuple:
        nonlocal x, p
        if x is None:
            x = z
        else:
            p += q
            k = p / (p + r)
            x += k * (z - x)
            p *= 1 - k
        return x, p

    return step


def cusum(drift: float, threshold: float) -> Step:
    """(high, low, alarm): two-sided sums of what exceeds the drift; both start again after an alarm (+1 or -1)."""
    hi = lo = 0.0

    def step(z: float | None) -> tuple:
        nonlocal hi, lo
        if z is None:
            return hi, lo, 0
        hi, lo = max(0.0, hi + z - drift), max(0.0, lo - z - drift)
        alarm = 1 if hi > threshold else -1 if lo > threshold else 0
        seen = hi, lo
        if alarm:
            hi = lo = 0.0
        return *seen, alarm

    return step


def garch(omega: float, alpha: float = 0.1, beta: float = 0.85, gamma: float = 0.0, start: float | None = None) -> Step:
    """Variance of a GARCH(1,1); gamma weighs negative shocks (threshold form). Starts at `start` or the long-run variance."""
    v = start if start is not None else omega / max(1e-12, 1 - alpha - beta - gamma / 2)
    last = None

    def step(r: float | None) -> tuple:
        nonlocal v, last
        if last is not None:
            v = omega + (alpha + (gamma if last < 0 else 0.0)) * last * last + beta * v
        last = r if r is not None else last
        return (v,)

    return step


def egarch(omega: float, alpha: float = 0.1, beta: float = 0.85, gamma: float = -0.05) -> Step:
    """Variance of an exponential GARCH."""
    ln_v, last = omega / (1 - beta), None
    e_abs = math.sqrt(2 / math.pi)

    def step(r: float | None) -> tuple:
        nonlocal ln_v, last
        if last is not None:
            z = last / math.exp(ln_v / 2)
            ln_v = omega + alpha * (abs(z) - e_abs) + gamma * z + beta * ln_v
        last = r if r is not None else last
        return (math.exp(ln_v),)

    return step


def replay(cash: float = 100_000.0, fee: float = 0.001, slip: float = 0.0005, stop: float | None = None, take: float | None = None, hold: int | None = None) -> Step:
    """(equity, position, action): a long-only account that fills signals of one bar at the next bar's open.

    signal 1 buys with all cash, -1 sells. Exits inside a bar come before the signal: a stop (at the open if that
    is below it), then a target, then the longest holding time at the close. No position is added to.
    """
    qty, entry, age, wait = 0.0, 0.0, 0, 0

    def sell(price: float) -> None:
        nonlocal cash, qty, age
        cash += qty * price * (1 - slip) * (1 - fee)
        qty, age = 0.0, 0

    def step(o: float, h: float, lo: float, c: float, signal: int | None) -> tuple:
        nonlocal cash, qty, entry, age, wait
        action = ""
        if wait == 1 and not qty:
            entry = o * (1 + slip)
            qty, cash, age, action = cash / (entry * (1 + fee)), 0.0, 0, "BUY"
        elif wait == -1 and qty:
            sell(o)
            action = "SELL"
        if qty:
            age += 1
            if stop is not None and lo <= entry * (1 - stop):
                sell(min(o, entry * (1 - stop)))
                action += "STOP"
            elif take is not None and h >= entry * (1 + take):
                sell(max(o, entry * (1 + take)))
                action += "TARGET"
            elif hold is not None and age >= hold:
                sell(c)
                action += "HOLD"
        wait = signal or 0
        return cash + qty * c, qty, action

    return step


#: Swing widths, break bases, confirming bars and buffers (in average true ranges) of the screening grid (fixed values).
STRUCTURE_GRID = ((2, 3, 4, 5, 6, 8, 10), ("wick", "close"), (1, 2), (0.0, 0.05))


class Structure(NamedTuple):
    """One definition of market structure."""

    width: int = 3
    basis: str = "close"
    confirm: int = 1
    buffer: float = 0.0

    @property
    def name(self) -> str:
        return f"sw{self.width:02d}_{self.basis}_c{self.confirm}_atr{round(self.buffer * 10_000):04d}"


def structure_grid() -> list[Structure]:
    return [Structure(*x) for x in product(*STRUCTURE_GRID)]


def market_structures(variants: Sequence[Structure], atr_n: int = 14) -> Callable[..., list[tuple]]:
    """Events (variant, event, level) of each bar under every definition, in one pass.

    A swing is an extreme of `width` bars on both sides, known `width` bars later; no gap may lie among them. A level is
    broken once the last `confirm` bars, without a gap among them, lie beyond it by `buffer` average true ranges: with their
    highs and lows (basis wick) or closes. That is CHOCH against the trend of the last break, else BOS, and each level breaks
    once. A bar that breaks both levels is AMBIGUOUS and changes nothing. Swings, ranges and gaps are shared by all variants.
    """
    widths, longest = sorted({v.width for v in variants}), max(v.confirm for v in variants)
    bars: deque[tuple[float, float]] = deque(maxlen=2 * max(widths) + 1)
    recent: deque[tuple[float, float, float, float | None]] = deque(maxlen=longest)
    ranges: deque[float] = deque(maxlen=atr_n)
    # per variant: level above, level below (None: none, or broken already), trend
    state = [[None, None, 0] for _ in variants]
    names = [v.name for v in variants]
    last, run = None, 0

    def beyond(v: Structure, level: float | None, side: int) -> bool:
        if level is None or run < v.confirm or len(recent) < v.confirm:
            return False
        for i in range(-v.confirm, 0):
            high, low, close, mean = recent[i]
            if v.buffer and mean is None:
                return False
            room = v.buffer * mean if v.buffer else 0.0
            x = close if v.basis == "close" else high if side > 0 else low
            if not (x > level + room if side > 0 else x < level - room):
                return False
        return True

    def step(h: float, lo: float, c: float, gap: bool = False) -> list[tuple]:
        nonlocal last, run
        p = c if last is None else last
        ranges.append(max(h - lo, abs(h - p), abs(lo - p)))
        run = 1 if gap or last is None else run + 1
        last = c
        bars.append((h, lo))
        recent.append((h, lo, c, sum(ranges) / atr_n if len(ranges) == atr_n else None))
        out = []
        for v, name, now in zip(variants, names, state):
            up, down = beyond(v, now[0], 1), beyond(v, now[1], -1)
            if up and down:
                out.append((name, "AMBIGUOUS", None))
            elif up or down:
                side = 1 if up else -1
                out.append((name, "CHOCH" if now[2] == -side else "BOS", now[0 if up else 1]))
                now[0 if up else 1], now[2] = None, side
        for w in widths:
            if run < 2 * w + 1:
                continue
            around = list(bars)[-2 * w - 1 :]
            mh, ml = around.pop(w)
            top, bottom = all(mh > x for x, _ in around), all(ml < x for _, x in around)
            if top or bottom:
                for v, now in zip(variants, state):
                    if v.width == w:
                        now[0], now[1] = (mh if top else now[0]), (ml if bottom else now[1])
        return out

    return step


def market_structure(width: int = 2, basis: str = "close", confirm: int = 1, buffer: float = 0.0, atr_n: int = 14) -> Step:
    """(event, level) of each bar under one definition, see `market_structures`."""
    many = market_structures([Structure(width, basis, confirm, buffer)], atr_n)

    def step(h: float, lo: float, c: float, gap: bool = False) -> tuple:
        found = many(h, lo, c, gap)
        return found[0][1:] if found else (None, None)

    return step
