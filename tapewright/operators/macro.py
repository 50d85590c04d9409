"""Macro regimes: detectors over feature columns, composite assessment, transitions, release lags, curves and baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vote(level: Column, trend: Column, momentum: Column, hi: float, lo: float) -> Column:
    """+1, 0 or -1 for each of level, trend and momentum, summed; missing ones don't vote."""
    one = lambda c, h, m: F.coalesce(F.when(c > h, 1).when(c < m, -1), F.lit(0))
    return one(level, hi, lo) + one(trend, 0.0, 0.0) + one(momentum, 0.0, 0.0)


def _regime(votes: Column, up: str, down: str) -> Column:
    return F.when(votes >= 2, up).when(votes <= -2, down).otherwise("NEUTRAL")


def _confidence(votes: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + 0.15 * F.abs(votes))


#: Detector: names of its level features in order of preference, bounds, names of its states.
DETECTORS = {
    "inflation": (("core_cpi", "cpi", "core_pce", "pce"), 3.0, 1.5, "RISING", "FALLING"),
    "growth": (("gdp", "pmi_gap"), 2.0, 0.5, "EXPANSION", "CONTRACTION"),
    "monetary": (("policy_rate",), 4.0, 1.0, "TIGHT", "EASY"),
    "liquidity": (("liquidity_index",), 0.5, -0.5, "ABUNDANT", "SCARCE"),
    "employment": (("employment_gap",), 0.5, -0.5, "STRONG", "WEAK"),
    "risk": (("risk_index",), 0.5, -0.5, "RISK_ON", "RISK_OFF"),
}


def detect(df: DataFrame, which: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    """`df` plus name, name_confidence per detector: votes of level, <level>_trend and <level>_momentum.

    Inflation below zero is DEFLATION and above eight HIGH, whatever the votes. A detector without any level column
    is NEUTRAL at 0.5.
    """
    out = df
    for name in which:
        levels, hi, lo, up, down = DETECTORS[name]
        have = [c for c in levels if c in df.columns]
        pick = lambda tail: F.coalesce(*[F.col(c + tail) for c in have if c + tail in df.columns], F.lit(None).cast("double"))  # noqa: E731, B023
        level = pick("")
        v = _vote(level, pick("_trend"), pick("_momentum"), hi, lo)
        state, conf = _regime(v, up, down), _confidence(v)
        if name == "inflation":
            state = F.when(level < 0, "DEFLATION").when(level > 8, "HIGH").otherwise(state)
            conf = F.when((level < 0) | (level > 8), F.lit(0.95)).otherwise(conf)
        out = out.withColumns({name: state, f"{name}_confidence": conf})
    return out


def assess(df: DataFrame) -> DataFrame:
    """`df` plus dominant (the first of risk, growth, inflation that isn't neutral), primary (growth_inflation) and the mean confidence."""
    d = detect(df)
    dominant = F.coalesce(*[F.when(F.col(c) != "NEUTRAL", F.col(c)) for c in ("risk", "growth", "inflation")], F.lit("NEUTRAL"))
    conf = sum((F.col(f"{c}_confidence") for c in DETECTORS), F.lit(0.0)) / len(DETECTORS)
    return d.withColumns({"dominant": dominant, "primary": F.concat_ws("_", "growth", "inflation"), "confidence": conf})


def smoothed_transitions(prior: dict[tuple[str, str], float], observed: DataFrame, state: str, after: str, alpha: float = 0.1) -> dict[tuple[str, str], float]:
    """p <- alpha * observed share + (1 - alpha) * p, rows normalised. States are few; only their counts leave the rows. More than 10,000 pairs of states raise."""
    counts = {(r[0], r[1]): r[2] for r in observed.groupBy(state, after).count().limit(10_001).collect()}
    if len(counts) > 10_000:
        raise ValueError("states are a short list: these have more than 10,000 pairs")
    states = sorted({s for k in [*prior, *counts] for s in k})
    out = {}
    for a in states:
        n = sum(counts.get((a, b), 0) for b in states)
        row = {b: (alpha * counts.get((a, b), 0) / n if n else 0.0) + ((1 - alpha) if n else 1.0) * prior.get((a, b), 1 / len(states)) for b in states}
        total = sum(row.values()) or 1.0
        out.update({(a, b): v / total for b, v in row.items()})
    return out


def available_at(event: Column, release: Column, lag_days: Column) -> Column:
    """When a value may be used: the later of the event and its release plus the factor's lag in days."""
    return F.greatest(event, F.try_add(release, F.make_dt_interval(lag_days)))


def curve(df: DataFrame, keys: Sequence[str], maturity: str, value: str) -> DataFrame:
    """(keys, level, slope, curvature, s10_2, s30_10, s10_3m): level is the longest yield, slope by least squares on years."""
    at = lambda m: F.max(F.when(F.abs(F.col(maturity) - m) < 1e-9, F.col(value)))
    short, mid = F.min_by(value, maturity), F.percentile_approx(maturity, 0.5)
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, maturity).alias("level"), F.regr_slope(value, maturity).alias("slope"), short.alias("_s"), mid.alias("_mm"), at(2.0).alias("y2"), at(10.0).alias("y10"), at(30.0).alias("y30"), at(0.25).alias("y3m"), F.array_sort(F.collect_list(F.struct(F.col(maturity).alias("m"), F.col(value).alias("v")))).alias("_a"))
    m = F.get(F.filter("_a", lambda x: x["m"] >= F.col("_mm")), F.lit(0))["v"]
    return g.select(*keys, "level", "slope", (F.col("_s") + F.col("level") - 2 * m).alias("curvature"), (F.col("y10") - F.col("y2")).alias("s10_2"), (F.col("y30") - F.col("y10")).alias("s30_10"), (F.col("y10") - F.col("y3m")).alias("s10_3m"))


def basket_ratios(df: DataFrame, item: str, value: str, ts: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, ratio) of the latest values of pairs of items."""
    last = df.where(F.col(value).isNotNull()).groupBy(item).agg(F.max_by(value, ts).alias("v"))
    p = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    x = last.select(F.col(item).alias("i"), "v", F.explode(p).alias("p")).where((F.col("i") == F.col("p.a")) | (F.col("i") == F.col("p.b")))
    g = x.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max(F.when(F.col("i") == F.col("p.a"), F.col("v"))).alias("x"), F.max(F.when(F.col("i") == F.col("p.b"), F.col("v"))).alias("y"))
    return g.select("a", "b", F.try_divide("x", "y").alias("ratio"))


def similarity(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted similarity in [0, 1]: 1 - |a - b| / (|a| + |b|) for numbers, 1 or 0 for texts (weights of texts end in '=')."""
    total, top = sum(weights.values()), None
    for k, w in weights.items():
        n = k.rstrip("=")
        s = F.when(a[n].eqNullSafe(b[n]), 1.0).otherwise(0.0) if k.endswith("=") else F.coalesce(1 - F.try_divide(F.abs(a[n] - b[n]), F.abs(a[n]) + F.abs(b[n])), F.lit(1.0))
        top = s * w if top is None else top + s * w
    return top / total


def clusters_in_window(rows: DataFrame, ticker: str, person: str, event: str, usable: str, as_of: Column, days: int = 60, least: int = 3) -> DataFrame:
    """(ticker, people, rows, clustered): distinct people within `days` before the date, of rows usable by then."""
    d = rows.where((F.col(usable) <= as_of) & (F.col(event) <= as_of) & (F.col(event) > F.try_subtract(as_of, F.make_dt_interval(F.lit(days)))))
    return d.groupBy(ticker).agg(F.count_distinct(person).alias("people"), F.count("*").alias("rows")).withColumn("clustered", F.col("people") >= least)
