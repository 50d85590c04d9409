"""Resampling and simulation: bootstraps in one pass, path simulation in parallel, robustness attacks.

Every random number is a hash of (seed, row, replicate), so results don't depend on partitions, retries or the
number of executors. A bootstrap gives each row a Poisson weight per replicate, which needs no sampling with
replacement and combines map-side; a moving-block bootstrap weighs block starts the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.blocks import Frames, numbered, with_halo


def _uniform(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of the seed and two counters."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed) * np.uint64(0x165667B19E3779F9)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _poisson(u: np.ndarray, rate: float) -> np.ndarray:
    """Poisson counts by inverting the distribution."""
    out = np.zeros(u.shape, dtype=np.int64)
    p = np.exp(-rate)
    c, k = p, 0
    while k < 60 and (left := u > c).any():
        out += left
        k += 1
        p *= rate / k
        c += p
    return out


def bootstrap_means(df: DataFrame, keys: Sequence[str], value: str, row: str, reps: int = 1000, seed: int = 42, rate: float = 1.0) -> DataFrame:
    """(keys, rep, mean): the weighted mean of each replicate. Each task emits one partial sum per key and replicate."""
    keys = list(keys)
    schema = df.select(*keys).schema.simpleString()[7:-1]
    ddl = ", ".join(x.replace(":", " ", 1) for x in schema.split(",")) + ", rep int, sw double, sx double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, g in b.groupby(keys, sort=False):
                acc = held.setdefault(k if isinstance(k, tuple) else (k,), np.zeros((2, reps)))
                x, r = g[value].to_numpy(float), g[row].to_numpy().astype(np.int64)
                for i in range(0, len(x), 4096):
                    w = _poisson(_uniform(seed, r[i : i + 4096, None], np.arange(reps)[None, :]), rate)
                    acc[0] += w.sum(axis=0)
                    acc[1] += x[i : i + 4096] @ w
            if len(held) >= 200:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict) -> Iterator[pd.DataFrame]:
        for k, acc in held.items():
            yield pd.DataFrame({**{n: [v] * reps for n, v in zip(keys, k)}, "rep": np.arange(reps), "sw": acc[0], "sx": acc[1]})
        held.clear()

    part = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*keys, value, row).mapInPandas(run, ddl)
    return part.groupBy(*keys, "rep").agg(F.try_divide(F.sum("sx"), F.sum("sw")).alias("mean"))


def bootstrap_interval(df: DataFrame, keys: Sequence[str], value: str, row: str, reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(keys, mean, low, high): percentile interval of the mean."""
    b = bootstrap_means(df, keys, value, row, reps, seed)
    a = (1 - level) / 2
    ci = b.groupBy(*keys).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ci, list(keys))


def block_bootstrap_interval(df: DataFrame, keys: Sequence[str], value: str, ts: str, ties: Sequence[str], block: int, reps: int = 1000, seed: int = 42, level: float = 0.95, circular: bool = False) -> DataFrame:
    """(keys, mean, low, high): moving blocks of `block` rows, each start weighed; replicates average n / block blocks.

    circular: the series goes on with its first rows behind its last, so that every row is in as many blocks.
    """
    keys = list(keys)
    n = numbered(df.where(F.col(value).isNotNull()), keys, ts, ties)
    f = Frames(keys=(*keys, "block"))
    if circular:
        size = n.groupBy(*keys).agg(F.max("rn").alias("_n"))
        n = n.join(size, keys).withColumn("rn", F.explode(F.when(F.col("rn") < block, F.array("rn", F.col("rn") + F.col("_n"))).otherwise(F.array("rn"))))
    v = with_halo(n, after=block)
    v = v.withColumn("_m", F.avg(value).over(f.w.rowsBetween(0, block - 1))).withColumn("_k", F.count(value).over(f.w.rowsBetween(0, block - 1))).where(f"not halo and _k = {block}")
    v = v.where("rn <= _n") if circular else v
    b = bootstrap_means(v, keys, "_m", "rn", reps, seed, rate=1.0 / block)
    a = (1 - level) / 2
    ci = b.groupBy(*keys).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ci, keys)


def simulate(spark: SparkSession, model: str, paths: int, steps: int, seed: int = 42, parts: int = 8, **p: float) -> DataFrame:
    """(path, terminal, low, high): simulated paths of gbm, heston, ou or jump; parameters s0, mu, sigma, dt and the model's own.

    gbm steps are exact in logs, ou steps exact, heston is an Euler scheme whose variance is cut at zero, jump adds a
    normal log jump with probability lam * dt. Paths are spread over tasks; each path's numbers depend on its id.
    """
    s0, mu, sigma, dt = (p.get(k, v) for k, v in (("s0", 100.0), ("mu", 0.05), ("sigma", 0.2), ("dt", 1 / 252)))

    def normals(ids: np.ndarray, step: int, stream: int) -> np.ndarray:
        u, v = (_uniform(seed + 7919 * stream + k, ids, np.full(len(ids), step)) for k in (1, 2))
        return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            x = np.full(len(ids), np.log(s0) if model != "ou" else s0)
            var = np.full(len(ids), p.get("v0", sigma**2))
            low, high = x.copy(), x.copy()
            for t in range(steps):
                z = normals(ids, t, 1)
                if model == "gbm":
                    x = x + (mu - sigma**2 / 2) * dt + sigma * np.sqrt(dt) * z
                elif model == "jump":
                    jump = _uniform(seed + 5, ids, np.full(len(ids), t)) < p.get("lam", 1.0) * dt
                    x = x + (mu - sigma**2 / 2) * dt + sigma * np.sqrt(dt) * z + jump * (p.get("jump_mu", -0.02) + p.get("jump_sigma", 0.05) * normals(ids, t, 2))
                elif model == "heston":
                    rho = p.get("rho", -0.5)
                    w = rho * z + np.sqrt(1 - rho**2) * normals(ids, t, 2)
                    vp = np.maximum(var, 0)
                    x = x + (mu - vp / 2) * dt + np.sqrt(vp * dt) * z
                    var = var + p.get("kappa", 2.0) * (p.get("theta", sigma**2) - vp) * dt + p.get("xi", 0.3) * np.sqrt(vp * dt) * w
                elif model == "ou":
                    k, m = p.get("kappa", 2.0), p.get("theta", s0)
                    e = np.exp(-k * dt)
                    x = m + (x - m) * e + sigma * np.sqrt((1 - e * e) / (2 * k)) * z
                else:
                    raise ValueError(model)
                low, high = np.minimum(low, x), np.maximum(high, x)
            f = (lambda y: y) if model == "ou" else np.exp
            yield pd.DataFrame({"path": ids, "terminal": f(x), "low": f(low), "high": f(high)})

    return spark.range(0, paths, 1, parts).mapInPandas(run, "path bigint, terminal double, low double, high double")


def resampled_terminals(returns: DataFrame, keys: Sequence[str], value: str, row: str, sims: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, rep, growth): exp of resampled log growth over as many steps as the key has rows, by Poisson weights."""
    logs = returns.where(F.col(value) > -1).withColumn("_l", F.log1p(value))
    n = logs.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = bootstrap_means(logs, keys, "_l", row, sims, seed)
    return m.join(n, list(keys)).select(*keys, "rep", F.exp(F.col("mean") * F.col("_n")).alias("growth"))


def _omissions(batches: Iterator[pa.RecordBatch], reps: int, omit: float, seed: int) -> Iterator[pa.RecordBatch]:
    """A task's sums and counts of what each replicate keeps: one row per replicate."""
    s, n = np.zeros(reps), np.zeros(reps, dtype=np.int64)
    for b in batches:
        h, y = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy()
        for i in range(0, len(h), 2_000):
            kept = _uniform(seed, h[i : i + 2_000, None], np.arange(1, reps + 1, dtype=np.uint64)[None, :]) >= omit
            s += y[i : i + 2_000] @ kept
            n += kept.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1, dtype=np.int32)), pa.array(s), pa.array(n)], names=["r", "s", "n"])


def attacks(df: DataFrame, outcome: str, asset: str, regime: str, chunk: Column, row: str, reps: int = 200, omit: float = 0.3, seed: int = 42) -> DataFrame:
    """(attack, value, survives): mean outcome without the best asset, the best regime, the five best rows; share of positive chunks; of positive 30 % omissions."""
    total = df.agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    def without(c: str) -> DataFrame:
        g = df.groupBy(c).agg(F.sum(outcome).alias("a"), F.count(outcome).alias("k"))
        top = g.orderBy(F.desc("a"), c).limit(1)
        return top.join(total).select(F.lit(f"without best {c}").alias("attack"), F.try_divide(F.col("s") - F.col("a"), F.col("n") - F.col("k")).alias("value")).withColumn("survives", F.col("value") > 0)

    best = df.orderBy(F.desc(outcome), row).limit(5).agg(F.sum(outcome).alias("a"), F.count("*").alias("k")).join(total)
    best = best.select(F.lit("without best five").alias("attack"), F.try_divide(F.col("s") - F.col("a"), F.col("n") - F.col("k")).alias("value")).withColumn("survives", F.col("value") > 0)
    c = df.groupBy(chunk.alias("c")).agg(F.avg(outcome).alias("m")).agg(F.avg((F.col("m") > 0).cast("int")).alias("value")).select(F.lit("chunks").alias("attack"), "value", (F.col("value") >= 0.9).alias("survives"))
    x = df.where(F.col(outcome).isNotNull()).select(F.xxhash64(row).alias("h"), F.col(outcome).cast("double").alias("y"))
    u = x.mapInArrow(partial(_omissions, reps=reps, omit=omit, seed=seed), "r int, s double, n bigint")
    o = u.groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n")).where("n > 0").agg(F.avg((F.col("m") > 0).cast("int")).alias("value")).select(F.lit("omission").alias("attack"), "value", (F.col("value") >= 0.95).alias("survives"))
    return without(asset).union(without(regime)).union(best).union(c).union(o)
