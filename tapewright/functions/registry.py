"""Named operators with parameters: batches of specifications become one projection over one sort."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from tapewright.operators import rolling
from tapewright.operators.blocks import Frames, numbered, with_halo

Builder = Callable[..., "Column | dict[str, Column]"]
_OPS: dict[str, tuple[str, dict, Builder]] = {}


def register(name: str, category: str, **defaults):  # noqa: ANN003, ANN201
    """Decorator: `name` builds columns from a Frames and parameters; `defaults` are its parameters."""
    def add(f: Builder) -> Builder:
        if name in _OPS:
            raise ValueError(f"{name} is registered already")
        _OPS[name] = (category, defaults, f)
        return f

    return add


def catalogue() -> list[tuple[str, str, dict]]:
    return sorted((n, c, dict(d)) for n, (c, d, _) in _OPS.items())


def compute(bars: DataFrame, specs: list[tuple[str, dict]], block_rows: int = 100_000) -> DataFrame:
    """`bars` (series, ts, bar_id, prices, volume) plus a column per specification, named name_param_value...; all in one sort.

    Unknown names or parameters raise. Two equal specifications are one column.
    """
    f, cols, reach = Frames(), {}, 1
    for name, params in specs:
        if name not in _OPS:
            raise KeyError(name)
        _, defaults, build = _OPS[name]
        if unknown := set(params) - set(defaults):
            raise KeyError(f"{name}: {sorted(unknown)}")
        p = {**defaults, **params}
        reach = max([reach, *[int(v) for v in p.values() if isinstance(v, int)]])
        made = build(f, **p)
        label = re.sub(r"[^A-Za-z0-9_]", "_", "_".join([name, *[f"{k}{v}" for k, v in p.items()]]))
        for k, c in (made if isinstance(made, dict) else {"": made}).items():
            cols[f"{label}_{k}" if k else label] = c
    df = with_halo(numbered(bars, ["series"], "ts", ["bar_id"]), before=2 * reach + 2, block_rows=block_rows)
    return df.withColumns(cols).where("not halo").drop("block", "halo")


register("sma", "trend", period=20)(lambda f, period: rolling.sma(f, "close", period))
register("wma", "trend", period=20)(lambda f, period: rolling.wma(f, "close", period))
register("vwma", "trend", period=20)(lambda f, period: rolling.vwma(f, "close", "volume", period))
register("bollinger", "volatility", period=20, width=2.0)(lambda f, period, width: rolling.bollinger(f, "close", period, width))
register("donchian", "volatility", period=20)(lambda f, period: rolling.donchian(f, period))
register("stochastic", "momentum", period=14)(lambda f, period: rolling.stochastic_k(f, period, 50.0))
register("momentum", "momentum", period=12)(lambda f, period: rolling.momentum(f, "close", period))
register("roc", "momentum", period=12)(lambda f, period: rolling.rate_of_change(f, "close", period, percent=True, zero=0.0))
register("zscore", "statistics", period=20)(lambda f, period: rolling.zscore(f, "close", period))
register("std", "statistics", period=20)(lambda f, period: rolling.spread_of(f, "close", period))


def topological(needs: dict[str, Sequence[str]]) -> list[str]:
    """The names so that each follows what it needs, by name where free; needs that aren't names are inputs. A circle raises."""
    left = {n: {x for x in d if x in needs} for n, d in needs.items()}
    out: list[str] = []
    while left:
        ready = sorted(n for n, d in left.items() if not d)
        if not ready:
            raise ValueError(f"features need each other: {sorted(left)}")
        out += ready
        left = {n: d - set(ready) for n, d in left.items() if n not in ready}
    return out


def pipeline(df: DataFrame, features: dict[str, tuple[Sequence[str], Callable[[], Column]]]) -> DataFrame:
    """`df` plus each feature, a (needs, builder), added in topological order; neighbouring projections are merged by the optimiser."""
    for n in topological({n: d for n, (d, _) in features.items()}):
        df = df.withColumn(n, features[n][1]())
    return df
