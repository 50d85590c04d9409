"""Rows per second on synthetic bars of many series: python bench_scale.py [rows] [series]. Prints one JSON line; nothing is kept."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators import folds, orderstats, rolling, stats
from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.runtime import session


def main(rows: int = 1_000_000, series: int = 100) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("scale", f"local[{cpus}]", spark__sql__shuffle__partitions=str(4 * int(cpus)), spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    i = F.col("id")
    base = 100 + 10 * F.sin(i / 500) + (F.xxhash64("id") % 1000) / 1000.0
    b = spark.range(0, rows, 1, 4 * int(cpus)).select(F.concat(F.lit("s"), (i % series).cast("string")).alias("series"), F.timestamp_seconds(1_600_000_000 + F.floor(i / series) * 300).alias("ts"), i.alias("bar_id"), base.alias("open"), (base + 0.7).alias("high"), (base - 0.6).alias("low"), (base + 0.1).alias("close"), ((i * 7919) % 1000).cast("double").alias("volume"))
    path = f"/tmp/tapewright-scale-{os.getpid()}"
    b.write.mode("overwrite").parquet(path)
    b = spark.read.parquet(path)
    f = Frames()
    halo = lambda n: with_halo(numbered(b, ["series"], "ts", ["bar_id"]), before=n)
    signal = lambda d: d.withColumn("signal", F.when(F.col("bar_id") % 17 == 0, 1).when(F.col("bar_id") % 23 == 0, -1))
    work = {
        "scan": lambda: b,
        "rolling_mean_volatility": lambda: halo(20).withColumns({"m": rolling.sma(f, "close", 20), "s": rolling.spread_of(f, "close", 20)}),
        "resample_1h": lambda: b.groupBy("series", F.window("ts", "1 hour")).agg(F.min_by("open", "ts"), F.max("high"), F.min("low"), F.max_by("close", "ts"), F.sum("volume")),
        "regression": lambda: b.groupBy("series").agg(*[c.alias(n) for n, c in stats.ols("close", "volume").items()]),
        "quantiles": lambda: orderstats.ordered_counts(b, ["series"], "close").groupBy("series").agg(orderstats.interpolated("close", 0.05)),
        "ema": lambda: folds.ordered_fold(halo(folds.WARM * 20), ["series", "block"], ["rn"], ["close"], ["bar_id", "halo"], lambda: (lambda e: lambda c: (e(c),))(folds.ema(20)), [("e", T.DoubleType())]),
        "replay": lambda: folds.ordered_fold(signal(b), ["series"], ["ts", "bar_id"], ["open", "high", "low", "close", "signal"], ["bar_id"], lambda: folds.replay(stop=0.02), [("equity", T.DoubleType()), ("position", T.DoubleType()), ("action", T.StringType())]),
    }
    out = {}
    for n, make in work.items():
        make().write.format("noop").mode("overwrite").save()
        t = time.time()
        make().write.format("noop").mode("overwrite").save()
        out[n] = {"sec": round(time.time() - t, 3), "rows_per_sec": round(rows / (time.time() - t))}
    print(json.dumps({"rows": rows, "series": series, "cpus": int(cpus), "spark": spark.version, "results": out}))
    import shutil

    shutil.rmtree(path, ignore_errors=True)
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
