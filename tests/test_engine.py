"""Readers, stores, streams, blocks, folds and numeric functions."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from conftest import SF, rows
from tapewright.functions import registry, special
from tapewright.operators import asof, blocks, folds, intervals, islands, linear, orderstats, portfolio, resample, stats, strategy
from tapewright.plans import base, joins, measures
from tapewright.runtime import table
from tapewright.sources import candles, store
from tapewright.streaming import events as live

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_blocks_number_rows_and_complete_frames(spark, size):
    data = [("a" if i % 3 else "b", T0 + dt.timedelta(hours=(i * 37) % 1000), i, float(i % 11)) for i in range(120)]
    df = spark.createDataFrame(data, "series string, ts timestamp, id long, x double")
    n = blocks.numbered(df, ["series"], "ts", ["id"], shard_s=86_400)
    f = blocks.Frames()
    got = blocks.with_halo(n, before=4, after=2, block_rows=size).withColumns({"m": F.sum("x").over(f.last(5)), "s": F.sum("x").over(f.ahead(2))}).where("not halo")
    want = pd.DataFrame(data, columns=["series", "ts", "id", "x"]).sort_values(["series", "ts", "id"])
    want["rn"] = want.groupby("series").cumcount() + 1
    want["m"] = want.groupby("series").x.transform(lambda v: v.rolling(5, min_periods=1).sum())
    want["s"] = want.groupby("series").x.transform(lambda v: sum(v.shift(-k).fillna(0) for k in (1, 2)))
    assert rows(got.select("id", "rn", "m", F.coalesce("s", F.lit(0.0)).alias("s")).toPandas()) == rows(want[["id", "rn", "m", "s"]])
    t = blocks.running_totals(n, ["series"], ["x"], block_rows=size).toPandas()
    assert np.allclose(t.sort_values("id").x_total, want.assign(c=want.groupby("series").x.cumsum()).sort_values("id").c)


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_runs_across_blocks(spark, size):
    rng = random.Random(1)
    v = [rng.choice([1, 1, 1, 2, None]) for _ in range(60)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, o long, v int")
    want, start = [], 0
    for i in range(1, 61):
        if i == 60 or v[i] != v[start]:
            want.append((v[start], start, i - 1, i - start))
            start = i
    got = sorted(((r.v, r.start, r.end, r.n) for r in islands.runs(df, ["k"], "o", "v", block_rows=size).collect()), key=lambda x: x[1])
    assert got == want


def test_asof_in_small_buckets(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(0, 500)) for i in range(80)] + [(200, None)]
    b = [(i, rng.randrange(0, 500), i * 10) for i in range(25)]
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("k", i, at(t)) for i, t in a], "k string, id long, t timestamp")
    right = spark.createDataFrame([("k", i, at(t), v) for i, t, v in b], "k string, id long, t timestamp, v long")
    for direction, strict, tol in (("backward", False, None), ("backward", True, None), ("forward", False, None), ("forward", True, 20_000_000)):
        got = {r.id: r.r_v for r in asof.asof_join(left, right, by=["k"], left_time="t", right_time="t", values=["v"], direction=direction, strict=strict, tolerance_us=tol, tie="id", bucket_s=7).collect()}
        want = {}
        for i, t in a:
            c = [] if t is None else [(x, j, v) for j, x, v in b if (x < t if strict else x <= t)] if direction == "backward" else [(-x, j, v) for j, x, v in b if (x > t if strict else x >= t)]
            best = max(c, default=None)
            want[i] = best[2] if best and (tol is None or abs(abs(best[0]) - t) * 1_000_000 <= tol) else None
        assert got == want, (direction, strict)


def test_intervals(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    iv = [(i, "k", at(s), at(e)) for i, (s, e) in enumerate([(0, 10), (10, 20), (30, 40), (35, 36), (50, 50)])]
    df = spark.createDataFrame(iv, "id long, k string, s timestamp, e timestamp")
    assert [(r.s, r.e) for r in intervals.merge_intervals(df, ["k"], "s", "e").orderBy("s").collect()] == [(at(0).replace(tzinfo=None), at(20).replace(tzinfo=None)), (at(30).replace(tzinfo=None), at(40).replace(tzinfo=None)), (at(50).replace(tzinfo=None), at(50).replace(tzinfo=None))]
    probe = spark.createDataFrame([(1, "k", at(20), at(25)), (2, "k", at(21), at(29)), (3, "k", at(-5), at(0)), (4, "x", at(0), at(9))], "id long, k string, s timestamp, e timestamp")
    assert {r.id: r.overlaps for r in intervals.overlaps_any(probe, df, ["k"], "s", "e").collect()} == {1: True, 2: False, 3: True, 4: False}
    c = intervals.concurrency(df, ["k"], "s", "e").first()
    assert (c.n, c.most, c.pairs) == (4, 2, 1)


def test_order_statistics(spark):
    rng = random.Random(8)
    v = [rng.choice([1.0, 2.0, 2.5, rng.random() * 100]) for _ in range(400)]
    df = spark.createDataFrame([("k", x) for x in v] + [("k", None), ("k", float("nan"))], "k string, x double")
    oc = orderstats.ordered_counts(df, ["k"], "x")
    r = oc.groupBy("k").agg(orderstats.at_index("x", F.lit(100)).alias("a"), orderstats.interpolated("x", 0.37).alias("q")).first()
    assert r.a == sorted(v)[100] and math.isclose(r.q, np.percentile(v, 37))
    ranks = {x.x: x.r for x in orderstats.average_ranks(df.where("x is not null and not isnan(x)"), ["k"], "x", "r").collect()}
    assert all(math.isclose(ranks[x], pd.Series(v).rank()[i]) for i, x in enumerate(v))


def test_forgetting_recursions_agree_with_whole_series(spark):
    df = base.clean_bars(spark, SF)
    n = blocks.numbered(df, ["series"], "ts", ["bar_id"])
    one = folds.ordered_fold(blocks.with_halo(n), ["series"], ["rn"], ["close"], ["bar_id"], lambda: (lambda e: lambda c: (e(c),))(folds.ema(3)), [("e", DoubleType())]).toPandas().sort_values("bar_id")
    cut = blocks.with_halo(n, before=folds.WARM * 3, block_rows=130)
    two = folds.ordered_fold(cut, ["series", "block"], ["rn"], ["close"], ["bar_id", "halo"], lambda: (lambda e: lambda c: (e(c),))(folds.ema(3)), [("e", DoubleType())]).where("not halo").toPandas().sort_values("bar_id")
    assert np.allclose(one.e, two.e, rtol=1e-14)


def test_state_machines():
    s = folds.supertrend(2, 1.0)
    out = [s(10 + i, 9 + i, 9.5 + i) for i in range(6)] + [s(5, 4, 4.5), s(5, 4, 4.2)]
    assert [x[1] for x in out[1:]] == [1] * 5 + [-1] * 2
    p = folds.parabolic()
    trend = [p(10 + i, 9 + i, 0)[1] for i in range(5)] + [p(6, 2, 0)[1]]
    assert trend == [None, 1, 1, 1, 1, -1]
    c = folds.cusum(0.5, 2.0)
    assert [c(1.5)[2] for _ in range(4)] == [0, 0, 1, 0]
    k = folds.kalman(0.0, 1.0)
    assert [round(k(x)[0], 6) for x in (0.0, 1.0)] == [0.0, 0.5]
    r = folds.replay(1000.0, fee=0.0, slip=0.0, stop=0.1)
    assert [r(10, 10, 10, 10, 1)[2], r(10, 11, 10, 11, None)[2], r(10, 10, 8, 8, None)] == ["", "BUY", (900.0, 0.0, "STOP")]
    m = folds.market_structure(1)
    ev = [m(h, h - 1, h - 0.5)[0] for h in (1, 3, 2, 1.5, 5, 6)]
    assert ev[4] == "BOS"


def test_distribution_functions():
    assert math.isclose(special.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    assert math.isclose(special.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(special.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.f_upper(4.964602744, 1, 10), 0.05, rel_tol=1e-7)
    for k, n, p in ((0, 5, 0.3), (3, 7, 0.5), (60, 100, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert math.isclose(special.binomial_tail(k, n, p), exact, rel_tol=1e-9)
    assert math.isclose(special.binomial_tail(2, 10, 0.5, "two"), 2 * sum(math.comb(10, i) for i in range(3)) / 1024)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=8, max_size=40))
def test_least_squares_from_moments(pts):
    x, y = np.array(pts).T
    if np.std(x) < 1e-3:
        return
    a = np.c_[np.ones(len(x)), x, y]
    f = linear.fit(a.T @ a, len(x))
    b, *_ = np.linalg.lstsq(a[:, :2], y, rcond=None)
    assert np.allclose(a[:, :2] @ f["b"], a[:, :2] @ b, rtol=1e-5, atol=1e-4)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    bh = {r.i: r.adjusted for r in stats.adjust_p(df, "p", "i").collect()}
    holm = {r.i: r.adjusted for r in stats.adjust_p(df, "p", "i", "holm").collect()}
    assert [round(bh[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.5]
    assert [round(holm[i], 6) for i in range(5)] == [0.04, 0.09, 0.09, 0.025, 0.5]


def test_unit_root_and_causality(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=800)
    walk, white = e.cumsum(), rng.normal(size=800)
    follow = np.r_[0, white[:-1]] + 0.1 * rng.normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"k": "k", "ts": [T0 + dt.timedelta(minutes=i) for i in range(800)], "walk": walk, "white": white, "follow": follow}))
    n = blocks.numbered(df, ["k"], "ts", []).cache()
    assert linear.dickey_fuller(n, ["k"], "white").first().stationary and not linear.dickey_fuller(n, ["k"], "walk").first().stationary
    assert linear.granger(n, ["k"], "white", "follow").first().p < 1e-6 < linear.granger(n, ["k"], "walk", "white").first().p
    lags = {r.lag: r["corr"] for r in linear.cross_lags(n, ["k"], "white", "follow", 3).collect()}
    assert max(lags, key=lags.get) == 1
    ac = {r.lag: r for r in linear.autocorrelations(n, ["k"], "walk", 3).collect()}
    assert ac[1].acf > 0.95 and abs(ac[2].pacf) < 0.2 and ac[3].p < 1e-9
    n.unpersist()
    eig, trace = linear.johansen(np.c_[walk, walk + white])
    assert trace[0] > 15.4 and (np.diff(eig) <= 0).all()


def test_logistic_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 2))
    y = (rng.random(3_000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    b = linear.logistic(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})), ["a", "b"], "y")
    assert np.allclose(b, [0.5, 1, -2], atol=0.25)


def test_bootstraps_are_stable_and_sane(spark):
    x = np.random.default_rng(3).normal(1, 2, 2_000)
    df = spark.createDataFrame(pd.DataFrame({"k": "k", "x": x, "id": np.arange(2_000), "ts": [T0 + dt.timedelta(minutes=i) for i in range(2_000)]}))
    a, b = (resample.bootstrap_interval(df.repartition(n), ["k"], "x", "id", 400).first() for n in (1, 7))
    assert math.isclose(a.low, b.low, rel_tol=1e-12) and math.isclose(a.high, b.high, rel_tol=1e-12)
    se = x.std() / math.sqrt(len(x))
    assert abs((a.high - a.low) / (2 * 1.96 * se) - 1) < 0.15 and a.low < a.mean < a.high
    c = resample.block_bootstrap_interval(df, ["k"], "x", "ts", ["id"], 10, 400).first()
    assert abs((c.high - c.low) / (2 * 1.96 * se) - 1) < 0.3
    g = resample.simulate(spark, "gbm", 20_000, 12, dt=1 / 12, mu=0.1, sigma=0.2).agg(F.avg("terminal")).first()[0]
    assert abs(g / (100 * math.exp(0.1)) - 1) < 0.01


def test_portfolios():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = portfolio.minimum_variance(cov, short=True)
    assert np.allclose(w, np.array([0.08, 0.03]) / 0.11) and np.allclose(portfolio.minimum_variance(cov), w, atol=1e-4)
    s = portfolio.maximum_sharpe(np.array([0.1, 0.02]), cov)
    assert s[0] > 0.8 and math.isclose(s.sum(), 1) and math.isclose(portfolio.risk_contributions(w, cov).sum(), 1)


def test_csv_layouts(spark, tmp_path):
    files = {"mt.csv": "<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<TICKVOL>\n2024.01.01,00:00:00,1,2,0.5,1.5,7\n2024.01.01,00:01:00,1,0.2,0.5,1.5,7\n", "tv.csv": "time,open,high,low,close\n2024-01-01T00:00:00Z,1,2,0.5,1.5\n2024-01-01T00:00:00Z,1,2,0.5,1.75\nx,1,2,0.5,1.5\n", "ep.csv": "timestamp,o,h,l,c,v\n1704067200,1,2,0.5,1.5,3\n1704067260000,1,2,0.5,1.5,3\n"}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    mt = candles.read_csv(spark, str(tmp_path / "mt.csv"), "X", "M1", zone="Europe/Berlin").orderBy("ts").collect()
    assert [(r.ts, r.problem, r.volume) for r in mt] == [(dt.datetime(2023, 12, 31, 23), None, 7.0), (dt.datetime(2023, 12, 31, 23, 1), "geometry", 7.0)]
    tv = candles.read_csv(spark, str(tmp_path / "tv.csv"), "X").collect()
    assert sorted((r.problem or "", r.close) for r in tv) == [("", 1.75), ("timestamp", 1.5)]
    ep = candles.read_csv(spark, str(tmp_path / "ep.csv"), "X")
    assert [r.ts.minute for r in ep.orderBy("ts").collect()] == [0, 1] and candles.timeframe_of(ep) == 60
    with pytest.raises(Exception, match="unreadable row"):
        candles.read_csv(spark, str(tmp_path / "mt.csv"), "X", strict=True).collect()
    (tmp_path / "u.csv").write_bytes("time,open,high,low,close\n2024-01-01 00:00:00,1,2,0.5,1.5\n".encode("utf-16"))
    assert candles.read_csv(spark, str(tmp_path / "u.csv"), "X", encoding="UTF-16").first().close == 1.5


def test_store(spark, tmp_path):
    df = base.clean_bars(spark, SF).withColumnRenamed("series", "symbol")
    p = str(tmp_path / "s")
    store.save(df, p)
    back = store.scan(spark, p, columns=df.columns)
    assert store.dataset_hash(back) == store.dataset_hash(df.repartition(3)) != store.dataset_hash(df.limit(5))
    one = df.first()
    got = store.scan(spark, p, start=one.ts, end=one.ts, symbol=one.symbol, limit=3).collect()
    assert [r.bar_id for r in got] == [one.bar_id]
    plan = store.scan(spark, p, symbol=one.symbol)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    new = df.where(F.col("bar_id") == one.bar_id).withColumn("close", F.lit(1.0))
    u = store.upserted(df, new, ["symbol", "ts"], "bar_id")
    assert u.count() == df.count() and u.where(F.col("bar_id") == one.bar_id).first().close == 1.0
    rows_, n, pages = store.page(df, 2, 50, "ts", tie="bar_id")
    assert rows_.count() == 50 and pages == -(-n // 50)
    with pytest.raises(ValueError):
        store.page(df, 0)
    log = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "x")], "i int, digest string, prev string")
    assert [r.i for r in store.verify_chain(log, "i", "digest", "prev").collect()] == [3]


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def _stream(spark, df, tmp_path, files, order):
    p = str(tmp_path / "in")
    for i, part in enumerate(np.array_split(df.orderBy(order).toPandas(), files)):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{p}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/*")


def test_streamed_ledger_equals_batch(spark, tmp_path):
    from tapewright.operators.orderflow import replay_ledger

    m = [(t, a, r, c, d) for t in (1, 2) for a, r, c, d in (("NEW", 1, 10, f"{t}a"), ("CORRECT", 2, 20, f"{t}b"), ("CORRECT", 2, 25, f"{t}b"), ("CORRECT", 4, 30, f"{t}c"), ("CANCEL", 3, 40, f"{t}d"), ("CORRECT", 4, 50, f"{t}e"))] + [(3, "CANCEL", 1, 5, "z")]
    df = spark.createDataFrame(m, "trade_id long, action string, revision int, receive_us long, digest string")
    _run(live.ledger(_stream(spark, df, tmp_path, 3, "receive_us")), "ledger_out")
    got, want = spark.table("ledger_out").toPandas(), replay_ledger(df).toPandas()
    assert rows(got) == rows(want)
    assert want[want.trade_id == 1].outcome.tolist() == ["APPLIED", "APPLIED", "DUPLICATE", "REJECT_REVISION", "APPLIED", "REJECT_CANCELLED"]


def test_streamed_guard_equals_batch(spark, tmp_path):
    from tapewright.operators.orderflow import sequence_faults

    df = spark.createDataFrame([("s", T0 + dt.timedelta(seconds=i), v) for i, v in enumerate([1, 2, 2, 5, 4, 5, 6])], "k string, ts timestamp, seq long")
    _run(live.sequence_guard(_stream(spark, df, tmp_path, 2, "ts"), "k", ["ts"], "seq"), "guard_out")
    assert rows(spark.table("guard_out").toPandas()) == rows(sequence_faults(df, "k", ["ts"], "seq").toPandas())


def test_streamed_windows(spark, tmp_path):
    df = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=10 * i), "BUY" if i % 2 else "SELL", 1.5) for i in range(30)], "k string, ts timestamp, side string, quantity double")
    _run(live.flow_windows(_stream(spark, df, tmp_path, 3, "ts"), ["k"], "ts", "1 hour"), "flow_out")
    got = spark.table("flow_out").orderBy("start").collect()
    assert len(got) >= 3 and all(float(r.buy) == float(r.sell) == 4.5 for r in got)


def test_streamed_states(spark, tmp_path):
    df = base.clean_bars(spark, SF).select("series", "ts", "bar_id", "high", "low", "close")
    s = _stream(spark, df, tmp_path, 2, "ts")
    _run(live.range_velocity(s, "series", ["ts", "bar_id"]), "velocity_out")
    _run(live.three_state(s, "series", ["ts", "bar_id"]), "state_out")
    v = spark.table("velocity_out")
    assert v.count() == df.count() == spark.table("state_out").count() and v.where("z is not null").count() > 0
    assert set(r.state for r in spark.table("state_out").select("state").distinct().collect()) <= {"WARMUP", "UP", "DOWN", "RANGE"}


def test_freshness(spark):
    df = spark.createDataFrame([(0, 1_000_000), (0, 99_000_000), (99_000_000, 0), (None, 1)], "e long, i long")
    assert [r.reasons for r in live.freshness(df, "e", "i", 15_000_000).collect()] == [[], ["STALE"], ["FUTURE"], ["NO_CLOCK"]]


def test_plans_push_filters_and_prune_columns(spark):
    plan = measures.m_performance(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "trades_count" not in plan
    assert "CartesianProduct" not in joins.j_overlap(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    e = table(spark, SF, "bars").limit(0).select(F.lit("s").alias("series"), F.col("timestamp").alias("ts"), "bar_id", "close")
    n = blocks.numbered(e, ["series"], "ts", ["bar_id"])
    assert n.count() == 0 and blocks.with_halo(n, before=3).count() == 0
    assert orderstats.ordered_counts(e, ["series"], "close").count() == 0
    assert islands.runs(n, ["series"], "rn", "close").count() == 0


def test_a_chain_links_and_shows_what_was_altered(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(40)], "i long, log string, v double")
    log = store.chain(df, "i", ["i", "v"], ["log"])
    assert log.where("prev is null").count() == 2
    assert store.verify_chain(log, "i", "digest", "prev", ["log"]).count() == store.verify_digests(log, ["i", "v"]).count() == 0
    bad = log.withColumn("v", F.when(F.col("i") == 7, 0.0).otherwise(F.col("v")))
    assert [r.i for r in store.verify_digests(bad, ["i", "v"]).collect()] == [7]
    assert [r.i for r in store.verify_chain(log.where("i <> 8"), "i", "digest", "prev", ["log"]).collect()] == [10]


def test_outcomes_of_many_bars_a_day(spark):
    rng = np.random.default_rng(4)
    n = 600
    ts = pd.date_range("2024-01-01", periods=n, freq="144min", tz="UTC") + pd.to_timedelta(rng.integers(0, 100, n), unit="s")
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    p = pd.DataFrame({"s": "A", "ts": ts, "high": close + rng.random(n), "low": close - rng.random(n), "close": close})
    got = {(r.at_us, r.days): (r.ret, r.mfe, r.mae) for r in asof.forward_outcomes(spark.createDataFrame(p), "s", (1, 20)).collect()}
    want = {}
    for h in (1, 20):
        for i in range(n):
            j = next((j for j in range(i, n) if ts[j] >= ts[i] + pd.Timedelta(days=h)), None)
            if j is not None:
                want[(ts[i].value // 1000, h)] = tuple(round(x / close[i] - 1, 8) for x in (close[j], p.high[i + 1 : j + 1].max(), p.low[i + 1 : j + 1].min()))
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=2e-8)


def test_query_blocks_of_any_length(spark, monkeypatch):
    from tapewright.operators import retrieval

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    whole = sorted(map(tuple, retrieval.nearest_vectors(df, df.where("id % 5 = 0"), "id", "v").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 8 * 3)
    assert sorted(map(tuple, retrieval.nearest_vectors(df, df.where("id % 5 = 0"), "id", "v").collect())) == whole and len(whole) == 60


def test_account_of_both_sides_and_cost_specs():
    a = strategy.execution(1000.0, commission="fixed:1", slippage="pct:0.01", size=2.0)
    out = [a(1, 100.0), a(1, 110.0), a(-1, 110.0), a(-1, 100.0), a(1, 90.0), a(None, 90.0)]
    assert [x[0] for x in out] == [2, 2, 0, -2, 0, 0]
    assert np.isclose(out[2][4], (108.9 - 101) * 2 - 2) and np.isclose(out[4][4], (99 - 90.9) * 2 - 2) and np.isclose(out[5][3], 1000 + out[2][4] + out[4][4])
    assert strategy.cost_spec("PCT:0.5") == ("pct", 0.5) and strategy.cost_spec("3") == ("fixed", 3.0) and strategy.cost_spec(None, 2.0) == ("fixed", 2.0)
    with pytest.raises(ValueError):
        strategy.cost_spec("share:1")


def test_features_in_order_and_in_circles():
    assert registry.topological({"a": ("b", "close"), "b": ("c",), "c": ()}) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        registry.topological({"a": ("b",), "b": ("a",)})


def test_market_structure_with_gaps_confirmation_and_double_breaks():
    one = folds.market_structure(1, basis="wick", confirm=2)
    bars = [(2, 1, 1.5), (4, 1, 2), (3, 0.5, 2), (3, 1, 2), (5, 1, 4), (6, 2, 5)]
    assert [one(*b)[0] for b in bars] == [None] * 5 + ["BOS"]
    one = folds.market_structure(1, basis="wick", confirm=2)
    assert [one(*b, gap=i == 5)[0] for i, b in enumerate(bars)] == [None] * 6
    both = folds.market_structure(1, basis="wick")
    assert [both(*b)[0] for b in [*bars[:4], (5, 0.1, 2), (5, 0.7, 2)]] == [None] * 4 + ["AMBIGUOUS", "BOS"]
    assert len(folds.structure_grid()) == 56
    p = folds.parabolic()
    assert [p(10, 9, 9.8)[1], p(11, 9, 9.5)[1]] == [None, -1]


def test_prediction_interval_and_t_quantile(spark):
    assert np.isclose(special.t_quantile(0.975, 10), 2.228138852, atol=1e-8)
    x = np.arange(12.0)
    y = 2 * x + np.where(np.arange(12) % 2, 1.0, -1.0)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    r = stats.prediction_interval(df, ["k"], "y", "x", "x").first()
    b, a = np.polyfit(x, y, 1)
    s = np.sqrt(((y - a - b * x) ** 2).sum() / 10) * np.sqrt(1 + 1 / 12)
    assert np.allclose([r.prediction, r.scale, r.low, r.high], [a + 11 * b, s, a + 11 * b - 2.228138852 * s, a + 11 * b + 2.228138852 * s])
