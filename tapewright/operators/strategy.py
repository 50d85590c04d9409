"""Strategies over ordered bars: signals of several indicators, an account with costs on both sides, parameters chosen walk-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.blocks import Frames
from tapewright.operators.folds import Step


def cost_spec(text: str | None, default: float = 0.0) -> tuple[str, float]:
    """(kind, value) of `fixed:10`, `pct:0.001` or a bare number; empty means fixed at `default`. Other kinds raise."""
    if not text:
        return "fixed", default
    kind, sep, value = text.partition(":")
    if not sep:
        return "fixed", float(text)
    if (kind := kind.strip().lower()) not in ("fixed", "pct"):
        raise ValueError(f"a cost is fixed or pct, not {kind!r}")
    return kind, float(value)


def execution(cash: float = 100_000.0, commission: str = "fixed:0", slippage: str = "fixed:0", size: float = 1.0) -> Step:
    """(quantity, cash, realised, equity, trade) of each bar: an account that may be long or short, filled at the bar's close.

    signal 1 buys, -1 sells, 0 or null does nothing; a signal in the direction already held does nothing either. Against a
    position it closes the whole of it, from flat it opens `size`. Slippage moves the fill against the order, a commission
    is a sum per fill or a share of its value. trade is the profit of a round trip after both commissions, null otherwise.
    """
    (ck, cv), (sk, sv) = cost_spec(commission), cost_spec(slippage)
    qty = entry = entry_fee = realised = 0.0

    def step(signal: int | None, close: float) -> tuple:
        nonlocal cash, qty, entry, entry_fee, realised
        trade = None
        if signal and signal * qty <= 0:
            n = abs(qty) or size
            price = close + signal * (close * sv if sk == "pct" else sv)
            fee = abs(price * n) * cv if ck == "pct" else cv
            cash -= signal * price * n + fee
            if qty:
                trade = (entry - price) * n * signal - entry_fee - fee
                realised += trade
                qty = 0.0
            else:
                qty, entry, entry_fee = signal * n, price, fee
        return qty, cash, realised, cash + qty * close, trade

    return step


def votes(rsi: Column, hist: Column, before: Column, price: Column, low: Column, high: Column) -> Column:
    """BUY or SELL where two of three agree: relative strength beyond 30 or 70, a turn of the MACD histogram, a price beyond the bands. Else null."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    buy = one(rsi < 30) + one((hist > 0) & (before <= 0)) + one(price < low)
    sell = one(rsi > 70) + one((hist < 0) & (before >= 0)) + one(price > high)
    return F.when(buy >= 2, "BUY").when(sell >= 2, "SELL")


def position_returns(f: Frames, ret: str, position: str, cost: float = 0.0) -> Column:
    """Return of holding the position of the row before, less `cost` per unit of position changed then. Null without a row before."""
    held = f.lag(position)
    return held * F.col(ret) - cost * F.abs(held - F.coalesce(f.lag(position, 2), F.lit(0)))


def walk_forward(runs: DataFrame, keys: Sequence[str], parameters: Sequence[str], result: str, train: int, test: int) -> DataFrame:
    """(keys, fold, parameters, train_total, test_total, rows): the parameters that did best on `train` rows, and what they did on the `test` rows behind them.

    `runs` has a row per key, rn and parameter set. Fold k trains on rows k * test + 1 .. k * test + train. Rows are summed per
    stretch of `test` rows first, so a fold is a few sums whatever its length; `train` must be a multiple of `test`.
    Equal results are settled by the smaller parameters. Folds without a full test are left out.
    """
    if train % test:
        raise ValueError("train must be a multiple of test")
    n = train // test
    s = runs.withColumn("_s", F.floor((F.col("rn") - 1) / F.lit(test))).groupBy(*keys, *parameters, "_s").agg(F.sum(result).alias("_t"), F.count("*").alias("_n"))
    # a stretch belongs to the training of the n folds from its own backwards, and is the test of the fold n before it
    use = F.array(*[F.struct((F.col("_s") - i).alias("fold"), F.lit(i == n).alias("test")) for i in range(n + 1)])
    u = s.withColumn("_u", F.explode(use)).where("_u.fold >= 0")
    of = lambda test, c: F.sum(F.when(F.col("_u.test") == test, F.col(c)))
    g = u.groupBy(*keys, F.col("_u.fold").alias("fold"), *parameters).agg(of(False, "_t").alias("train_total"), of(True, "_t").alias("test_total"), of(True, "_n").alias("rows")).where(F.col("rows") == test)
    best = F.struct(F.coalesce(F.round("train_total", 12), F.lit(0.0)).alias("r"), *[(-F.col(p)).alias(p) for p in parameters])
    picked = g.groupBy(*keys, "fold").agg(F.max_by(F.struct(*parameters, "train_total", "test_total", "rows"), best).alias("b"))
    return picked.select(*keys, "fold", "b.*")
