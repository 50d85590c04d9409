"""Rolling and analytic window operators as column builders.

Every builder takes a `Frames` (one order of rows, complete in blocks with halos) and columns, and returns a
column, so any number of them share one sort. Where two definitions go by one name, the variant is an argument.
Columns are null until their window is full unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.operators.blocks import Frames


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _safe(a: Column, b: Column, other: float | None = None) -> Column:
    """a / b, or `other` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(other).cast("double"))


# returns

def change(f: Frames, p: Column | str, kind: str = "percentage") -> Column:
    """Change from the row before: absolute, percentage or log. A zero (for log: non-positive) previous value gives 0."""
    p = _c(p)
    q = f.lag(p)
    how = {"absolute": p - q, "percentage": F.when(q == 0, 0.0).otherwise(p / F.when(q != 0, q) - 1), "log": F.when((q <= 0) | (p <= 0), 0.0).otherwise(F.ln(p / F.when(q != 0, q)))}
    return F.when(q.isNotNull(), how[kind])


def pct_return(f: Frames, p: Column | str) -> Column:
    """Fraction change, null when the previous value is zero."""
    p = _c(p)
    return _safe(p - f.lag(p), f.lag(p))


def log_return(f: Frames, p: Column | str) -> Column:
    """ln(p / previous), null unless both are positive."""
    p = _c(p)
    q = f.lag(p)
    return F.when((p > 0) & (q > 0), F.ln(p / F.when(q > 0, q)))


def momentum(f: Frames, p: Column | str, k: int) -> Column:
    return _c(p) - f.lag(p, k)


def rate_of_change(f: Frames, p: Column | str, k: int, percent: bool = False, zero: float | None = None) -> Column:
    """Change over k rows as a fraction or in percent; `zero` where the earlier value is zero."""
    q = f.lag(p, k)
    return F.when(q.isNotNull(), _safe(_c(p) - q, q, zero) * (100 if percent else 1))


def future_return(f: Frames, p: Column | str, h: int) -> Column:
    """Fraction change to h rows ahead; null on zero, NaN or infinite values."""
    p, q = _c(p), f.lead(p, h)
    ok = (p != 0) & ~F.isnan(p) & ~F.isnan(q) & (F.abs(p) < float("inf")) & (F.abs(q) < float("inf"))
    return F.when(ok, (q - p) / F.when(p != 0, p))


# moving statistics

def sma(f: Frames, p: Column | str, n: int) -> Column:
    """Mean of the last n rows, null if one of them is null."""
    w = f.last(n)
    return F.when(F.count(_c(p)).over(w) == n, F.avg(_c(p)).over(w))


def spread_of(f: Frames, p: Column | str, n: int, what: str = "stddev_samp") -> Column:
    """stddev_samp, stddev_pop, var_samp or var_pop of the last n rows."""
    w = f.last(n)
    return F.when(F.count(_c(p)).over(w) == n, getattr(F, what)(_c(p)).over(w))


def zscore(f: Frames, p: Column | str, n: int) -> Column:
    """(p - mean) / sample deviation of the last n rows; 0 when flat."""
    s = spread_of(f, p, n)
    return F.when(s.isNotNull(), F.when(s == 0, 0.0).otherwise((_c(p) - sma(f, p, n)) / F.when(s != 0, s)))


def percentile_of(f: Frames, p: Column | str, n: int, q: float) -> Column:
    """Interpolated q-quantile of the last n rows."""
    return f.full(n, F.percentile(_c(p), F.lit(q)).over(f.last(n)))


def correlation(f: Frames, x: Column | str, y: Column | str, n: int) -> Column:
    """Pearson correlation in the window, null without variance."""
    w, both = f.last(n), _c(x).isNotNull() & _c(y).isNotNull()
    s = F.stddev_pop(F.when(both, _c(x))).over(w) * F.stddev_pop(F.when(both, _c(y))).over(w)
    return f.full(n, F.covar_pop(_c(x), _c(y)).over(w) / F.when(s > 0, s))


def covariance(f: Frames, x: Column | str, y: Column | str, n: int) -> Column:
    return f.full(n, F.covar_samp(_c(x), _c(y)).over(f.last(n)))


def ma_distance(f: Frames, p: Column | str, n: int) -> Column:
    m = sma(f, p, n)
    return _safe(_c(p) - m, m)


def share_at_most(f: Frames, x: Column | str, n: int) -> Column:
    """Share of the last n values that are at most the present one."""
    x = _c(x)
    v = F.collect_list(x).over(f.last(n))
    return F.when(F.size(v) == n, F.size(F.filter(v, lambda a: a <= x)) / F.lit(float(n)))


def drawdown(f: Frames, p: Column | str, n: int) -> Column:
    m = F.max(_c(p)).over(f.last(n))
    return f.full(n, _safe(_c(p) - m, m))


def sign_of_difference(a: Column, b: Column) -> Column:
    return F.signum(a - b).cast("int")


def wma(f: Frames, p: Column | str, n: int) -> Column:
    """Linearly weighted mean, the newest row heaviest."""
    v = F.collect_list(_c(p)).over(f.last(n))
    total = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda a, k: a * k), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) == n, total / (n * (n + 1) / 2))


def vwma(f: Frames, p: Column | str, v: Column | str, n: int) -> Column:
    w = f.last(n)
    return f.full(n, _safe(F.sum(_c(p) * _c(v)).over(w), F.sum(_c(v)).over(w), 0.0))


# bar indicators

def typical(h: str = "high", lo: str = "low", c: str = "close") -> Column:
    return (F.col(h) + F.col(lo) + F.col(c)) / 3


def true_range(f: Frames) -> Column:
    """Largest of the bar's range and its distances from the close before; the first bar's own range."""
    pc = f.lag("close")
    return F.when(pc.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def atr_simple(f: Frames, tr: str, n: int, with_first: bool = False) -> Column:
    """Mean of n true ranges; the first bar has none, or its own range if `with_first`."""
    return F.when(f.rn >= n if with_first else f.rn > n, F.avg(F.col(tr)).over(f.last(n)))


def rsi_simple(f: Frames, diff: str, n: int) -> Column:
    """Relative strength with plain means of gains and losses; 100 without losses."""
    d = F.col(diff)
    up = F.avg(F.when(d > 0, d).otherwise(0.0)).over(f.last(n))
    dn = F.avg(F.when(d < 0, -d).otherwise(0.0)).over(f.last(n))
    return F.when(f.rn > n, F.when(dn == 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(dn != 0, dn))))


def bollinger(f: Frames, p: Column | str, n: int, k: float = 2.0) -> dict[str, Column]:
    """Bands of k population deviations, and the place between them."""
    m, s = sma(f, p, n), spread_of(f, p, n, "stddev_pop")
    return {"bb_mid": m, "bb_up": m + k * s, "bb_low": m - k * s, "bb_pct": _safe(_c(p) - (m - k * s), 2 * k * s)}


def stochastic_k(f: Frames, n: int, flat: float = 0.0) -> Column:
    w = f.last(n)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return f.full(n, _safe((F.col("close") - lo) * 100, hi - lo, flat))


def cci(f: Frames, tp: str, n: int) -> Column:
    """Commodity channel: distance from the mean in 0.015 mean absolute deviations; 0 when flat."""
    w = f.last(n)
    m = F.avg(F.col(tp)).over(w)
    v = F.collect_list(F.col(tp)).over(w)
    dev = F.aggregate(F.transform(v, lambda x: F.abs(x - m)), F.lit(0.0), lambda s, x: s + x) / n
    # equal values leave a last-bit deviation from their mean; that is flat too
    return f.full(n, F.when(dev <= 1e-12 * F.abs(m), 0.0).otherwise(_safe(F.col(tp) - m, 0.015 * dev, 0.0)))


def money_flow(f: Frames, up: str, down: str, n: int) -> Column:
    """100 - 100 / (1 + up / down) of window sums; 100 without negative flow."""
    a, b = F.sum(F.col(up)).over(f.last(n)), F.sum(F.col(down)).over(f.last(n))
    return F.when(f.rn > n, F.when(b == 0, 100.0).otherwise(100 - 100 / (1 + a / F.when(b != 0, b))))


def donchian(f: Frames, n: int) -> dict[str, Column]:
    w = f.last(n)
    hi, lo = f.full(n, F.max("high").over(w)), f.full(n, F.min("low").over(w))
    return {"dc_up": hi, "dc_low": lo, "dc_mid": (hi + lo) / 2}


def close_location(vol: str = "volume") -> Column:
    """Where the close lies in the bar's range, from -1 to 1, times volume; 0 for a flat bar."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    return F.when(h == lo, 0.0).otherwise(((c - lo) - (h - c)) / F.when(h != lo, h - lo)) * F.col(vol)


def cmf(f: Frames, clv: str, n: int) -> Column:
    w = f.last(n)
    return f.full(n, _safe(F.sum(F.col(clv)).over(w), F.sum("volume").over(w), 0.0))


def ichimoku(f: Frames, a: int = 9, b: int = 26, c: int = 52, shift: int = 26) -> dict[str, Column]:
    """Conversion, base and span lines; spans come from `shift` rows ago; chikou looks ahead by definition."""
    mid = lambda n: f.full(n, (F.max("high").over(f.last(n)) + F.min("low").over(f.last(n))) / 2)
    return {"ich_conv": mid(a), "ich_base": mid(b), "ich_mid_c": mid(c), "ich_chikou": f.lead("close", shift)}


# forward labels

def binary_label(ret: Column) -> Column:
    return F.when(ret.isNotNull(), F.when(ret > 0, 1).otherwise(0))


def three_way_label(ret: Column, threshold: float) -> Column:
    return F.when(ret.isNotNull(), F.when(ret > threshold, 1).when(ret < -threshold, -1).otherwise(0))


def first_touch(f: Frames, take: float, stop: float, h: int) -> Column:
    """1, -1 or 0: which of close * (1 + take) and close * (1 - stop) the next h closes reach first; null if fewer follow.

    The upper barrier is looked at first; a null close ends the scan with 0.
    """
    v = F.collect_list(F.struct(F.col("close").alias("x"))).over(f.ahead(h))
    up, dn = F.col("close") * (1 + take), F.col("close") * (1 - stop)
    hit = F.aggregate(v, F.lit(None).cast("int"), lambda s, r: F.coalesce(s, F.when(r["x"].isNull(), 0).when(r["x"] >= up, 1).when(r["x"] <= dn, -1)))
    return F.when(F.size(v) == h, F.coalesce(hit, F.lit(0)))


def barrier_outcome(f: Frames, atr: str, direction: str, take: float = 1.0, stop: float = 1.0, h: int = 16, entry_at: str = "next_open", both: str = "ambiguous") -> Column:
    """STRUCT<label, reason, bars, exit>: entry at the next open (or this close), barriers at multiples of ATR, held at most h bars.

    Bar by bar: an open beyond a barrier exits at that open; both barriers inside one bar are ambiguous (label
    null) or, with both="stop", a stop; else the touched barrier; after h bars the close. Fewer bars left: null with reason UNAVAILABLE.
    """
    v = F.collect_list(F.struct("open", "high", "low", "close")).over(f.ahead(h))
    d, a = F.col(direction), F.col(atr)
    entry = F.get(v, F.lit(0))["open"] if entry_at == "next_open" else F.col("close")
    tp, sl = entry + d * take * a, entry - d * stop * a
    none = F.lit(None).cast("struct<label:int,reason:string,bars:int,exit:double,n:int>")

    def out(label, reason: str, n: Column, price: Column) -> Column:  # noqa: ANN001
        return F.struct(F.lit(label).cast("int").alias("label"), F.lit(reason).alias("reason"), n.cast("int").alias("bars"), price.cast("double").alias("exit"), n.cast("int").alias("n"))

    def step(s: Column, r: Column) -> Column:
        n = F.coalesce(s["n"], F.lit(0)) + 1
        win = F.when(d > 0, r["high"] >= tp).otherwise(r["low"] <= tp)
        lose = F.when(d > 0, r["low"] <= sl).otherwise(r["high"] >= sl)
        gap_win, gap_lose = d * (r["open"] - tp) >= 0, d * (r["open"] - sl) <= 0
        new = (
            F.when(gap_lose, out(-1, "OPEN_STOP", n, r["open"]))
            .when(gap_win, out(1, "OPEN_TARGET", n, r["open"]))
            .when(win & lose, out(None, "AMBIGUOUS", n, r["close"]) if both == "ambiguous" else out(-1, "STOP", n, sl))
            .when(win, out(1, "TARGET", n, tp))
            .when(lose, out(-1, "STOP", n, sl))
            .otherwise(out(0, "OPEN", n, r["close"]))
        )
        return F.when(s["reason"].isNotNull() & (s["reason"] != "OPEN"), s).otherwise(new)

    end = F.aggregate(v, none, step)
    timed = F.when(end["reason"] == "OPEN", F.struct(F.lit(0).alias("label"), F.lit("TIMEOUT").alias("reason"), end["bars"].alias("bars"), end["exit"].alias("exit"))).otherwise(F.struct(end["label"].alias("label"), end["reason"].alias("reason"), end["bars"].alias("bars"), end["exit"].alias("exit")))
    unavailable = F.struct(F.lit(None).cast("int").alias("label"), F.lit("UNAVAILABLE").alias("reason"), F.lit(None).cast("int").alias("bars"), F.lit(None).cast("double").alias("exit"))
    ok = (F.size(v) == h) | (end["reason"] != "OPEN")
    return F.when(a.isNull() | (F.size(v) == 0) | ~ok, unavailable).otherwise(timed)
