"""Behaviour of series: clustering of volatility, persistence, breakouts, breaks of level, profiles, flow states, kinetics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.blocks import Frames, running_totals, with_halo
from tapewright.operators.folds import Step, ordered_fold
from tapewright.runtime import cut


def volatility_clustering(returns: DataFrame, keys: Sequence[str], r: str) -> DataFrame:
    """(keys, acf_abs, acf_sq): lag-1 autocorrelation of absolute and squared returns."""
    keys = list(keys)
    m = returns.groupBy(*keys).agg(F.avg(F.abs(r)).alias("_a"), F.avg(F.col(r) * F.col(r)).alias("_q"))
    d = returns.join(m, keys).withColumns({"_x": F.abs(r) - F.col("_a"), "_y": F.col(r) * F.col(r) - F.col("_q")})
    f = Frames(keys=(*keys, "block"))
    d = with_halo(d, before=1).withColumns({"_x1": f.lag("_x"), "_y1": f.lag("_y")}).where("not halo")
    acf = lambda a, b: F.try_divide(F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a)))
    return d.groupBy(*keys).agg(acf("_x", "_x1").alias("acf_abs"), acf("_y", "_y1").alias("acf_sq"))


def persistence(returns: DataFrame, keys: Sequence[str], r: str, n: int = 10, band: float = 0.001) -> DataFrame:
    """(keys, trend, reversion): how often the sum of n rows and that of the next n agree in sign; how often a sum beyond the band is followed by the opposite sign."""
    keys = list(keys)
    f = Frames(keys=(*keys, "block"))
    d = with_halo(returns, before=n, after=n).withColumns({"_a": f.full(n, F.sum(r).over(f.last(n))), "_b": F.when(F.count(r).over(f.ahead(n)) == n, F.sum(r).over(f.ahead(n))), "_n": f.lead(r)}).where("not halo")
    agree = F.avg(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.signum("_a") == F.signum("_b")).cast("int")))
    back = F.avg(F.when((F.abs("_a") > band) & F.col("_n").isNotNull(), (F.signum("_a") == -F.signum("_n")).cast("int")))
    return d.groupBy(*keys).agg(agree.alias("trend"), back.alias("reversion"))


def breakouts(bars: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """(keys, up, down): share of rows whose next close leaves the range of the last n bars."""
    keys = list(keys)
    f = Frames(keys=(*keys, "block"))
    d = with_halo(bars, before=n, after=1).withColumns({"_h": f.full(n, F.max("high").over(f.last(n))), "_l": f.full(n, F.min("low").over(f.last(n))), "_n": f.lead("close")}).where("not halo and _h is not null and _n is not null")
    return d.groupBy(*keys).agg(F.avg((F.col("_n") > F.col("_h")).cast("int")).alias("up"), F.avg((F.col("_n") < F.col("_l")).cast("int")).alias("down"))


def mean_shift(df: DataFrame, keys: Sequence[str], value: str, critical: float = 2.0) -> DataFrame:
    """(keys, at, statistic, broken): the split between a quarter and three quarters with the largest standardised mean shift; by running sums."""
    keys = list(keys)
    t = running_totals(df.where(F.col(value).isNotNull()), keys, [value])
    g = t.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.stddev_samp(value).alias("_sd"))
    d = t.join(g, keys).where("rn >= _n div 4 and rn < 3 * _n div 4 and rn > 0 and _sd > 0")
    left, right = F.col(f"{value}_total") / F.col("rn"), (F.col("_s") - F.col(f"{value}_total")) / (F.col("_n") - F.col("rn"))
    z = F.abs(left - right) / (F.col("_sd") * F.sqrt(1 / F.col("rn") + 1 / (F.col("_n") - F.col("rn"))))
    b = d.groupBy(*keys).agg(F.max_by(F.struct(F.col("rn").alias("at"), z.alias("statistic")), F.struct(z, -F.col("rn"))).alias("b"))
    return b.select(*keys, "b.at", "b.statistic", (F.col("b.statistic") > critical).alias("broken"))


def kpss(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, statistic): level stationarity without lag correction, from running sums of deviations."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    d = running_totals(df.join(m, keys).withColumn("_e", F.col(value) - F.col("_m")), keys, ["_e"])
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_e_total") * F.col("_e_total")) / F.pow(F.count("*").cast("double"), F.lit(2.0)), F.sum(F.col("_e") * F.col("_e")) / F.count("*")).alias("statistic"))


def kpss_bartlett(df: DataFrame, keys: Sequence[str], value: str, trend: bool = False) -> DataFrame:
    """(keys, statistic, lags, n): KPSS of rows of `numbered` with a Bartlett long-run variance of int(sqrt(n)) lags, about a level or a straight trend.

    Weighed autocovariances up to lag L are the mean square of sums over L + 1 neighbours, so running totals and one join at that
    distance give them for any number of lags. Fewer than four rows give none.
    """
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, "rn", F.col(value).cast("double").alias("_y"))
    m = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_y").alias("_m"), F.avg("rn").alias("_x"), F.regr_slope("_y", F.col("rn").cast("double")).alias("_b")).where("_n >= 4")
    e = F.col("_y") - F.col("_m") - (F.col("_b") * (F.col("rn") - F.col("_x")) if trend else F.lit(0.0))
    t = running_totals(d.join(m, keys).withColumn("_e", e).select(*keys, "rn", "_e"), keys, ["_e"])
    t = cut(t.join(m.select(*keys, "_n", F.floor(F.sqrt("_n")).cast("bigint").alias("_l")), keys).select(*keys, "rn", "_e", F.col("_e_total").alias("_s"), "_n", "_l"))
    far = t.select(*keys, (F.col("rn") + F.col("_l") + 1).alias("rn"), F.col("_s").alias("_p"))
    w = t.join(far, [*keys, "rn"], "left")
    step = F.col("_s") - F.coalesce("_p", F.lit(0.0))
    # sums that begin before the last row and end behind it
    tail = F.when((F.col("rn") >= F.col("_n") - F.col("_l")) & (F.col("rn") < F.col("_n")), F.col("_s") * F.col("_s")).otherwise(0.0)
    g = w.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_l").alias("lags"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(step * step + tail).alias("_v"))
    variance = F.greatest(F.col("_v") / (F.col("lags") + 1) / F.col("n"), F.lit(1e-12))
    return g.select(*keys, (F.col("_ss") / (F.col("n").cast("double") * F.col("n") * variance)).alias("statistic"), F.col("lags").cast("int").alias("lags"), "n")


def trend_regime(f: Frames, n: int = 100, adx_n: int = 14, strong: float = 25.0, steep: float = 0.05) -> list[dict[str, Column]]:
    """Columns in four steps: state UP, DOWN or RANGE from directional movement (plain sums) and the slope of log closes in deviations of log returns.

    Each step is added before the next is built. The frame needs n + 2 rows before; rows before the warm-up have no state.
    """
    tr, up, dn = F.col("_tr"), F.col("high") - f.lag("high"), f.lag("low") - F.col("low")
    first = {"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.coalesce(f.lag("close"), "close")), F.abs(F.col("low") - F.coalesce(f.lag("close"), "close"))), "_up": F.when((up > dn) & (up > 0), up).otherwise(0.0), "_dn": F.when((dn > up) & (dn > 0), dn).otherwise(0.0), "_ln": F.ln("close"), "_lr": F.ln(F.col("close") / f.lag("close"))}
    total = lambda c: F.sum(c).over(f.last(adx_n))
    second = {"_plus": F.when((f.rn >= adx_n) & (total(tr) > 0), 100 * total("_up") / total(tr)), "_minus": F.when((f.rn >= adx_n) & (total(tr) > 0), 100 * total("_dn") / total(tr))}
    second["_dx"] = F.try_divide(100 * F.abs(second["_plus"] - second["_minus"]), second["_plus"] + second["_minus"])
    place = sum([F.lit(float(-i)) * f.lag("_ln", i) for i in range(1, n)], F.lit(0.0))
    slope = (place + n * (n - 1) / 2.0 * F.avg("_ln").over(f.last(n))) / (n * (n * n - 1) / 12.0)
    third = {"adx": F.when(F.count("_dx").over(f.last(adx_n)) == adx_n, F.round(F.avg("_dx").over(f.last(adx_n)), 9)), "slope": F.round(F.coalesce(F.try_divide(slope, F.stddev_pop("_lr").over(f.last(n - 1))), F.lit(0.0)), 9)}
    ready = (f.rn >= max(n, 2 * adx_n + 1)) & F.col("adx").isNotNull()
    side = F.when((F.col("adx") >= strong) & (F.col("slope") > steep) & (F.col("_plus") > F.col("_minus")), "UP").when((F.col("adx") >= strong) & (F.col("slope") < -steep) & (F.col("_minus") > F.col("_plus")), "DOWN").otherwise("RANGE")
    return [first, second, third, {"state": F.when(ready, side)}]


def volume_profile(bars: DataFrame, keys: Sequence[str], price: str, volume: str, tick: float, share: float = 0.7) -> DataFrame:
    """(keys, poc, low, high, total): volume by price bin; the busiest bin (ties: the lower price) and the value area grown from it, ties to the lower side.

    A key's bins, not its rows, are folded: a price range has few bins.
    """
    keys = list(keys)
    b = bars.where((F.col(price).isNotNull()) & (F.col(volume) > 0)).groupBy(*keys, F.floor(F.col(price) / tick + 1e-9).alias("_b")).agg(F.sum(volume).alias("_v"))
    rows = b.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_v"))).alias("_a"))
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "poc double, low double, high double, total double"])

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for p in batches:
            out = []
            for r in p.to_dict("records"):
                bins, v = [x["_b"] for x in r["_a"]], [x["_v"] for x in r["_a"]]
                i = max(range(len(v)), key=lambda k: (v[k], -bins[k]))
                a = z = i
                have, need = v[i], share * sum(v)
                while have < need and (a > 0 or z < len(v) - 1):
                    below = v[a - 1] if a > 0 else -1.0
                    above = v[z + 1] if z < len(v) - 1 else -1.0
                    if below >= above:
                        a, have = a - 1, have + below
                    else:
                        z, have = z + 1, have + above
                out.append((*[r[k] for k in keys], bins[i] * tick, bins[a] * tick, (bins[z] + 1) * tick, sum(v)))
            yield pd.DataFrame(out, columns=[*keys, "poc", "low", "high", "total"])

    return rows.mapInPandas(run, ddl)


def order_flow_imbalance(f: Frames, bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    """Best-level imbalance between two quotes; 0 for the first."""
    pb, pbs, pa, pas = (f.lag(c) for c in (bid, bid_size, ask, ask_size))
    b = F.when(F.col(bid) > pb, F.col(bid_size)).when(F.col(bid) == pb, F.col(bid_size) - pbs).otherwise(-pbs)
    a = F.when(F.col(ask) < pa, F.col(ask_size)).when(F.col(ask) == pa, F.col(ask_size) - pas).otherwise(-pas)
    return F.when(pb.isNull(), 0.0).otherwise(b - a)


def kinetics(f: Frames, close: str, seconds: str) -> dict[str, Column]:
    """velocity (log change per second), acceleration and kinetic energy; null across a gap in time."""
    step = F.when(f.lag(seconds) == F.col(seconds), F.ln(F.col(close) / f.lag(close)) / F.col(seconds))
    return {"velocity": step, "energy": 0.5 * step * step}


def efficiency_state(f: Frames, close: str, move: str, n: int = 10, least: float = 0.4, bps: float = 2.0) -> Column:
    """UP, DOWN or RANGE by net move against path length of the last n rows (`move` is the row's absolute change); WARMUP before."""
    net, path = F.col(close) - f.lag(close, n), F.sum(move).over(f.last(n))
    ok = (path > 0) & (F.round(F.abs(net) / F.when(path > 0, path), 9) >= least) & (F.round(F.abs(net) / f.lag(close, n) * 1e4, 9) >= bps)
    return F.when(f.rn <= n, "WARMUP").when(ok & (net > 0), "UP").when(ok, "DOWN").otherwise("RANGE")


def footprint_state(delta_share: Column, progress: Column, strong: float = 0.2, far: float = 1.0) -> Column:
    """Aggression against progress: INITIATIVE (both), ABSORPTION (aggression only), VACUUM (progress only), BALANCE."""
    a, p = F.abs(delta_share) >= strong, F.abs(progress) >= far
    return F.when(a & p, "INITIATIVE").when(a, "ABSORPTION").when(p, "VACUUM").otherwise("BALANCE")


def _absorption(least: int) -> Step:
    count, end, side = 0, None, None

    def step(start: int, stop: int, state: str, sign: int) -> tuple:
        nonlocal count, end, side
        if state == "ABSORPTION" and (end is None or start >= end):
            count = count + 1 if sign == side else 1
            side, end = sign, stop
        elif state == "INITIATIVE":
            count, side = 0, None
        return count, count >= least

    return step


def absorption_tests(windows: DataFrame, keys: Sequence[str], start: str, stop: str, state: str, sign: str, keep: Sequence[str], least: int = 3) -> DataFrame:
    """`keep`, tests, candidate: consecutive non-overlapping windows of aggression without progress on one side."""
    return ordered_fold(windows, keys, [start], [start, stop, state, sign], keep, lambda: _absorption(least), [("tests", T.IntegerType()), ("candidate", T.BooleanType())])


def sweeps(f: Frames, n: int = 20, back: int = 3) -> Column:
    """ABOVE or BELOW when a bar passes the extreme of the n bars before it and one of the next `back` closes is inside again."""
    hi, lo = F.max("high").over(f.prior(n)), F.min("low").over(f.prior(n))
    inside_h = F.min("close").over(f.w.rowsBetween(0, back)) < hi
    inside_l = F.max("close").over(f.w.rowsBetween(0, back)) > lo
    return F.when(f.rn <= n, None).when((F.col("high") > hi) & inside_h, "ABOVE").when((F.col("low") < lo) & inside_l, "BELOW")


def causal_score(f: Frames, tr: str, gap: str, k: int = 8) -> Column:
    """(close - close k rows ago) / mean true range of the k rows before; null if a gap in time lies inside."""
    mean = F.avg(tr).over(f.prior(k))
    gaps = F.sum(gap).over(f.last(k))
    return F.when((f.rn > k) & (gaps == 0) & (mean > 0), (F.col("close") - f.lag("close", k)) / F.when(mean > 0, mean))


def deterministic_top(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """The n best rows per key by score, ties by `tie`: a top-k report. Each task passes on n rows per key at most."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def volatility_gate(f: Frames, tr: str, n: int = 200, least: int = 50, floor: float = 0.6) -> dict[str, Column]:
    """percentile: the share of the n ranges before that are at most the bar's own; status: WARMUP below `least` of them, else HIGH_VOLATILITY from `floor` on."""
    before = F.collect_list(tr).over(f.prior(n))
    share = F.size(F.filter(before, lambda x: x <= F.col(tr))) / F.size(before)
    enough = F.size(before) >= least
    return {"percentile": F.when(enough, share), "status": F.when(~enough, "WARMUP").when(share >= floor, "HIGH_VOLATILITY").otherwise("LOW_OR_MID_VOLATILITY")}


def pivot(f: Frames, p: str, side: int) -> Column:
    """The value where it is at least (side 1) or at most (side -1) both neighbours, else null."""
    a, b, c = f.lag(p), F.col(p), f.lead(p)
    return F.when((b >= a) & (b >= c) if side > 0 else (b <= a) & (b <= c), b)


def window_geometry(f: Frames, p: str, n: int) -> dict[str, Column]:
    """slope, angle (degrees), magnitude, curvature and mean pivots of the last n values at unit steps.

    The frame needs the columns lo and hi of `pivot` and n + 1 rows before. Angle and magnitude are those of the line from
    the first to the last value, curvature is that of the circle through the last three points; pivots lie inside the window.
    """
    from tapewright.functions.scalars import menger_curvature

    c, c1, c2, first = F.col(p), f.lag(p), f.lag(p, 2), f.lag(p, n - 1)
    # steps count from the row itself, so that digits don't cancel at large row numbers
    place = [F.lit(float(-i)) * (f.lag(p, i) if i else c) for i in range(n)]
    sxy, sx = sum(place[1:], place[0]), -n * (n - 1) / 2.0
    slope = (sxy - sx * F.avg(p).over(f.last(n))) / (n * (n * n - 1) / 12.0)
    inner = f.w.rowsBetween(-(n - 2), -1)
    at = lambda v: F.lit(float(v))
    return {
        "slope": slope,
        "angle": F.degrees(F.atan2(c - first, at(n - 1))),
        "magnitude": F.sqrt(F.lit(float((n - 1) ** 2)) + (c - first) * (c - first)),
        "curvature": menger_curvature(at(0), c2, at(1), c1, at(2), c),
        "support": F.avg("lo").over(inner),
        "resistance": F.avg("hi").over(inner),
    }


def count_windows(df: DataFrame, keys: Sequence[str], size: int, step: int) -> DataFrame:
    """Rows of `numbered` in each window of `size` rows that starts every `step` rows: start_window counts the starts from 0."""
    last = F.floor((F.col("rn") - 1) / F.lit(step))
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - 1 - size) / F.lit(step)) + 1)
    return df.withColumn("start_window", F.explode(F.sequence(first, last)))


def streaks(df: DataFrame, f: Frames, keys: Sequence[str], ret: str, most: int) -> DataFrame:
    """(keys, side, length, following, wins): the outcomes after `length` outcomes of one sign in a row, of rows with a halo of `most` + 1."""
    sign = F.signum(ret).cast("int")
    d = df.withColumns({"side": sign, "_before": F.collect_list(sign).over(f.prior(most - 1)), "_next": f.lead(ret)}).where("not halo and side <> 0 and _next is not null")
    # the run that ends at the row, as far as `most` rows back
    other = F.array_max(F.transform(F.col("_before"), lambda x, i: F.when(x != F.col("side"), i + 1).otherwise(0)))
    run = F.size("_before") - F.coalesce(other, F.lit(0)) + 1
    d = d.withColumn("length", F.explode(F.when(run >= 2, F.sequence(F.lit(2), run)).otherwise(F.array().cast("array<int>"))))
    return d.groupBy(*keys, "side", "length").agg(F.count("*").alias("following"), F.count(F.when(F.col("_next") > 0, 1)).alias("wins"))
