"""Probability, research, macro, registry, graph and learning operators against closed forms and brute force."""

import datetime as dt
import inspect
import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import registry, scalars
from tapewright.operators import behaviour, blocks, chance, graph, hierarchy, learning, macro, quality, research, resample, retrieval, splits
from tapewright.plans import base, joins, models, problems, studies
from conftest import SF, rows

T0 = dt.datetime(2024, 1, 1)


def test_viterbi_against_all_paths():
    s, a, b = [0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [[0.8, 0.2], [0.3, 0.7]]
    obs = [0, 1, 1, 0, 1]
    best = max(product((0, 1), repeat=5), key=lambda p: s[p[0]] * b[p[0]][obs[0]] * math.prod(a[p[i - 1]][p[i]] * b[p[i]][obs[i]] for i in range(1, 5)))
    assert chance.viterbi(obs, s, a, b) == list(best)
    f = chance.forward(s, a, b)
    total = sum(s[p[0]] * b[p[0]][obs[0]] * math.prod(a[p[i - 1]][p[i]] * b[p[i]][obs[i]] for i in range(1, 5)) for p in product((0, 1), repeat=5))
    assert math.isclose([f(o) for o in obs][-1][2], math.log(total), rel_tol=1e-12)


def test_beta_binomial_sums_to_one():
    assert math.isclose(sum(chance.beta_binomial_pmf(12, 2.5, 0.7)), 1, rel_tol=1e-9)


def test_isotonic_and_temperature(spark):
    rng = np.random.default_rng(0)
    p = rng.random(4_000)
    y = (rng.random(4_000) < p**2).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    s = chance.isotonic_steps(df, "p", "y", 50)
    assert s.value.is_monotonic_increasing and abs(s.value.iloc[-1] - 0.95) < 0.1
    b = df.agg(F.avg((chance.apply_steps(F.col("p"), s) - F.col("y")) ** 2).alias("a"), F.avg((F.col("p") - F.col("y")) ** 2).alias("b")).first()
    assert b.a < b.b
    sharp = df.withColumn("q", 1 / (1 + F.exp(-3 * F.ln(F.col("p") / (1 - F.col("p"))))))
    z = (np.random.default_rng(1).random(4_000) < p).astype(float)
    df2 = spark.createDataFrame(pd.DataFrame({"p": p, "z": z})).withColumn("q", 1 / (1 + F.exp(-3 * F.ln(F.col("p") / (1 - F.col("p"))))))
    assert 2.3 < chance.temperature(df2, "q", "z") < 3.7 and chance.temperature(sharp.limit(10), "q", "y") == 1.0


def test_pool(spark):
    r = chance.pool(spark.createDataFrame([("a", 0.2, 1.0), ("a", 0.8, 3.0), ("b", 0.5, 0.0), ("a", None, 9.0)], "k string, p double, w double"), ["k"], "p", "w")
    assert {x.k: x.probability for x in r.collect()} == {"a": pytest.approx(0.65), "b": None}


def test_conditions(spark):
    df = spark.createDataFrame([(1, "x", 0.5), (2, "y", None), (3, "x", 2.0)], "i int, s string, v double")
    ids = lambda spec: [r.i for r in df.where(research.matches(spec, df.columns)).orderBy("i").collect()]
    assert ids({"s": "x"}) == [1, 3] and ids({"v": (None, 1.0)}) == [1] and ids({"v": (1.0, None), "s": ["x", "y"]}) == [3] and ids({"nope": 1}) == [] and ids({}) == [1, 2, 3]


def test_conflicts_and_prefixes(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 2), (2, "c", 1)], "id int, v string, o int")
    one, bad = research.conflicts(df, "id", ["o", "v"])
    assert sorted((r.id, r.v) for r in one.collect()) == [(1, "a"), (2, "c")] and [r.id for r in bad.collect()] == [2]
    full = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "v int, at int")
    assert research.prefix_differences(full, full.where("at <= 20"), "at", F.lit(20)).count() == 0
    assert research.prefix_differences(full, full.where("at <= 10"), "at", F.lit(20)).count() == 1


def test_tolerant_batches(spark):
    df = spark.createDataFrame([("k", float(a), p) for a, p in [(10, "a"), (11, "b"), (12, "c"), (13, "a"), (40, "d")]], "k string, amount double, person string")
    got = sorted((r.low, r.high, r.people, r.rows) for r in research.amount_batches(df, ["k"], "amount", "person", 3, 2.0).collect())
    assert got == [(10.0, 12.0, 3, 3)]


def test_reaction_and_breaks(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=600)
    e[::50] += 8
    r = np.r_[np.zeros(3), 2 * e[:-3]] + rng.normal(size=600)
    x = rng.normal(size=600)
    y = np.r_[x[:300], -x[300:]] + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"k": "k", "ts": [T0 + dt.timedelta(minutes=i) for i in range(600)], "e": e, "r": r, "x": x, "y": y}))
    n = blocks.numbered(df, ["k"], "ts", [])
    lags = {z.lag: z.mean_abs_z for z in research.reaction_delay(n, ["k"], "e", "r", 3.0, 6).collect()}
    assert max(lags, key=lags.get) == 3
    b = research.correlation_breaks(n, ["k"], "x", "y").first()
    assert b.before > 0.5 > b.after
    assert research.heteroscedasticity(n, ["k"], "r", "e").first().lm >= 0
    assert abs(behaviour.mean_shift(n.withColumn("z", F.col("x") + F.when(F.col("rn") > 250, 5).otherwise(0)), ["k"], "z").first()["at"] - 250) <= 3


def test_macro(spark):
    df = spark.createDataFrame([(-0.5, 0.0, 0.0), (9.0, 0.0, 0.0), (4.0, 1.0, 0.0), (1.0, -1.0, 0.0), (None, None, None)], "cpi double, cpi_trend double, cpi_momentum double")
    assert [r.inflation for r in macro.detect(df, ["inflation"]).collect()] == ["DEFLATION", "HIGH", "RISING", "FALLING", "NEUTRAL"]
    c = spark.createDataFrame([("d", m, v) for m, v in ((0.25, 5.0), (2.0, 4.5), (10.0, 4.0), (30.0, 4.2))], "d string, m double, y double")
    r = macro.curve(c, ["d"], "m", "y").first()
    assert (r.level, r.s10_2, r.s10_3m) == (4.2, -0.5, -1.0) and math.isclose(r.s30_10, 0.2) and r.slope < 0
    p = macro.smoothed_transitions({("a", "a"): 0.5, ("a", "b"): 0.5}, spark.createDataFrame([("a", "b")] * 4, "s string, t string"), "s", "t", 0.5)
    assert math.isclose(p[("a", "b")], 0.75) and math.isclose(p[("b", "a")] + p[("b", "b")], 1)
    t = macro.basket_ratios(spark.createDataFrame([("g", 1, 10.0), ("g", 2, 20.0), ("s", 1, 5.0)], "i string, t int, v double"), "i", "v", "t", [("g", "s")]).first()
    assert t.ratio == 4.0


def test_registry(spark):
    bars = base.clean_bars(spark, SF)
    out = registry.compute(bars, [("sma", {"period": 5}), ("bollinger", {}), ("sma", {"period": 5})])
    assert {"sma_period5", "bollinger_period20_width2_0_bb_up"} <= set(out.columns) and out.count() == bars.count()
    with pytest.raises(KeyError):
        registry.compute(bars, [("nope", {})])
    with pytest.raises(KeyError):
        registry.compute(bars, [("sma", {"length": 3})])
    with pytest.raises(ValueError):
        registry.register("sma", "trend")(lambda f: None)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), (None, "x")], "parent string, child string")
    s = spark.createDataFrame([("a",), ("z",)], "start string")
    got = {(r.start, r.node): (r.distance, r.path) for r in graph.shortest_paths(e, s).collect()}
    assert got[("a", "c")] == (2, ["a", "b", "c"]) and got[("z", "z")] == (0, ["z"]) and len(got) == 5
    assert {r.node for r in graph.ancestors(e, s).where("start = 'a'").collect()} == {"a", "b", "c", "d"}
    assert graph.shortest_paths(e, s, hops=1).count() == 4
    assert graph.shortest_paths(e, s, directed=False).where("node = 'c'").first().distance == 1
    assert sorted(r.node for r in graph.missing_ends(e, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "id").collect()) == ["d", "x"]


def test_shortest_paths_from_roots_have_no_limit_of_steps(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    edges = [*chain, ("n00", "n02"), ("b", "n11"), ("n12", "n10"), ("s", "s"), ("p", "q"), ("a", "p"), ("a", "r"), ("r", "q")]
    df = spark.createDataFrame([(a, b, "feeds") for a, b in edges], "parent_hash string, child_hash string, relation string")
    roots = {a for a, _ in edges} - {b for _, b in edges}

    def brute(pairs):
        out = {}
        for r in roots:
            level = [(r,)]
            while level:
                for p in sorted(level, reverse=True):
                    out[r, p[-1]] = (len(p) - 1, list(p))
                level = [(*p, b) for p in level for a, b in pairs if a == p[-1] and (r, b) not in out]
        return out

    for directed, pairs in ((True, edges), (False, [*edges, *((b, a) for a, b in edges)])):
        for most in (hierarchy.MAX_EDGES, 6):
            got = hierarchy.shortest_from_roots(df, directed, most).collect()
            assert {(r.start, r.node): (r.distance, r.path) for r in got} == brute(pairs) and len(got) == len(brute(pairs))


def test_registered_shortest_paths_reach_beyond_five_steps(spark):
    q = models.QUERIES
    near, whole = (rows(q[n](spark, SF).toPandas()) for n in ("x_shortest_paths", "x_all_shortest_paths"))
    assert near == rows(q["x_all_shortest_paths"](spark, SF).where("distance <= 5").toPandas()) and len(whole) > len(near)
    reach = problems.p1_descendants(spark, SF).toPandas()
    roots = reach[~reach.artifact_hash.isin(reach.descendant_hash)]
    assert len(whole) == len(roots) + roots.artifact_hash.nunique()


def test_registered_replicates_are_the_defaults_or_the_references(spark, monkeypatch):
    means, seen = resample.bootstrap_means, {}

    def recorded(*a, **k):
        seen[name] = inspect.signature(means).bind(*a, **k).arguments.get("reps", 1000)
        return means(*a, **k)

    attack = resample.attacks
    monkeypatch.setattr(resample, "bootstrap_means", recorded)
    monkeypatch.setattr(resample, "attacks", lambda *a: seen.update(x_attacks=inspect.signature(attack).bind(*a).arguments["reps"]) or attack(*a))
    for name in ("x_bootstrap", "x_block_bootstrap", "x_growth", "x_attacks", "r_conditional"):
        {**models.QUERIES, **studies.QUERIES}[name](spark, SF)
    assert seen == {"x_bootstrap": 1000, "x_block_bootstrap": 1000, "x_growth": 1000, "x_attacks": 1000, "r_conditional": 500}


def test_registered_reaction_has_twenty_lags(spark):
    lags = studies.QUERIES["r_reaction"](spark, SF).groupBy("series").agg(F.collect_set("lag").alias("l")).collect()
    assert lags and all(sorted(r.l) == list(range(21)) for r in lags)


def test_forward_outcomes_of_dense_bars(spark, tmp_path):
    """Six stamps a day: the first bar at or after 20 days is 120 rows ahead."""
    n = 200
    df = pd.DataFrame({"daily_id": range(n), "symbol": "A", "timestamp": [T0 + dt.timedelta(hours=4 * i) for i in range(n)], "high": 2.0 + np.arange(n), "low": 0.5 + np.arange(n), "close": 1.0 + np.arange(n), "received_at": T0})
    spark.createDataFrame(df).write.parquet(str(tmp_path / "daily_bars.parquet"))
    got = joins.QUERIES["j_forward_outcomes"](spark, str(tmp_path)).where("days = 20").orderBy("at_us").collect()
    assert len(got) == n - 120
    assert all(math.isclose(r.ret, 120 / (i + 1), abs_tol=1e-7) and math.isclose(r.mfe, 121 / (i + 1), abs_tol=1e-7) and math.isclose(r.mae, 0.5 / (i + 1), abs_tol=1e-7) for i, r in enumerate(got))


def test_permutation_importance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_000, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2_000), "a": x[:, 0], "b": x[:, 1], "label": (x[:, 0] > 0).astype(float)}))
    scored = lambda d: d.withColumn("p", 1 / (1 + F.exp(-5 * F.col("a"))))
    imp = {r.feature: r.loss for r in learning.permutation_importance(scored, df, ["a", "b"], "id").collect()}
    assert imp["a"] > 0.2 and abs(imp["b"]) < 0.01
    m = df.withColumn("p", F.when(F.col("a") > 0, 0.9).otherwise(0.1)).agg(*[c.alias(n) for n, c in learning.binary_metrics("label", "p").items()]).first()
    assert m.accuracy == m.f1 == 1.0 and math.isclose(m.brier, 0.01)


def test_neighbours_in_blocks(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    got = retrieval.nearest_vectors(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", 3).toPandas()
    v32 = v.astype(np.float32).astype(float)
    for q, g in got.groupby("query"):
        d = np.sqrt(((v32 - v32[q]) ** 2).sum(1))
        d[q] = np.inf
        assert g.sort_values("rank").neighbour.tolist() == np.argsort(d, kind="stable")[:3].tolist()
    assert retrieval.nearest_vectors(df, df.limit(0), "vec_id", "embedding").count() == 0


def test_profile_and_quality(spark):
    b = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.1, 9.0), ("k", 1.2, 4.0), ("k", 1.3, 4.0)], "k string, p double, v double")
    r = behaviour.volume_profile(b, ["k"], "p", "v", 0.1).first()
    assert math.isclose(r.poc, 1.1) and math.isclose(r.low, 1.0) and math.isclose(r.high, 1.3) and r.total == 22
    ts = [T0 + dt.timedelta(minutes=m) for m in (0, 1, 2, 5, 6)]
    q = spark.createDataFrame([("k", t, i) for i, t in enumerate(ts)], "k string, ts timestamp, id int")
    assert [r.missing for r in quality.gaps(q, ["k"], "ts", F.lit(60), ["id"]).collect()] == [2]
    assert quality.missing_periods(q, ["k"], "ts", F.lit(60), ["id"], 30).count() == 2


def test_splits(spark):
    got = lambda s: [tuple(r) for r in s.collect()]
    assert got(splits.chronological(spark, 11)) == [(0, "train", 1, 6), (0, "validation", 7, 8), (0, "test", 9, 11)]
    assert got(splits.rolling(spark, 10, 4, 2, 3)) == [(0, "train", 1, 4), (0, "validation", 5, 6), (1, "train", 4, 7), (1, "validation", 8, 9)]
    with pytest.raises(ValueError):
        splits.rolling(spark, 3, 4, 2, 1)
    assert ("train", 1, 1) in [r[1:] for r in got(splits.k_fold(spark, 10, 5, 1, 1))]


def test_scalars(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 21), dt.datetime(2024, 1, 7, 22), "h1", 0.05, 0.02)], "a timestamp, b timestamp, tf string, n double, i double")
    r = df.select(scalars.gap_class("a", "b").alias("g"), scalars.gap_class("a", "a").alias("g2"), scalars.timeframe_seconds("tf").alias("s"), scalars.real_yield("n", "i", True).alias("y"), scalars.kelly(F.lit(0.6), F.lit(1.0)).alias("k"), scalars.volatility_target(F.lit(0.01)).alias("v"), scalars.z_class(F.lit(-2.5)).alias("z"), scalars.iso("a").alias("iso"), scalars.normal_pdf(F.lit(0.0)).alias("pdf"), scalars.policy_action(F.lit(1.0), F.lit(2.0)).alias("p"),
                  scalars.menger_curvature(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, -1.0, 0.0)]).alias("c"), scalars.clean_headline(F.lit("  GOLD** up 2.5%!  ")).alias("h")).first()
    assert (r.g, r.g2, r.s, r.v, r.z, r.p, r.h) == ("weekend", "gap", 3600, 3.0, "strong", "hike", "gold up 2.5%")
    assert math.isclose(r.y, 1.05 / 1.02 - 1) and math.isclose(r.k, 0.2) and r.iso == "2024-01-05T21:00:00.000000Z" and math.isclose(r.pdf, 0.39894228, rel_tol=1e-7) and math.isclose(abs(r.c), 1.0)


def test_attacks(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "r", 0.01 if i != 3 else 5.0) for i in range(100)], "id long, asset string, regime string, y double")
    r = {x.attack: x for x in resample.attacks(df, "y", "asset", "regime", F.floor(F.col("id") / 10), "id", 20).collect()}
    assert r["without best five"].survives and math.isclose(r["without best five"].value, 0.01) and r["chunks"].value == 1.0 and r["omission"].survives


def test_barriers_against_brute_force(spark):
    from tapewright.operators import rolling

    rng = np.random.default_rng(9)
    n, h = 160, 6
    o = 100 + rng.normal(size=n).cumsum()
    c = o + rng.normal(size=n)
    hi, lo = np.maximum(o, c) + abs(rng.normal(size=n)), np.minimum(o, c) - abs(rng.normal(size=n))
    d = rng.choice([-1, 1], n)
    df = spark.createDataFrame(pd.DataFrame({"series": "s", "ts": [T0 + dt.timedelta(minutes=i) for i in range(n)], "bar_id": np.arange(n), "open": o, "high": hi, "low": lo, "close": c, "atr": 1.5, "dir": d}))
    for entry_at, both, size in (("next_open", "ambiguous", 1000), ("close", "stop", 40)):
        f = blocks.Frames()
        b = blocks.with_halo(blocks.numbered(df, ["series"], "ts", ["bar_id"]), after=h, block_rows=size)
        got = {r.bar_id: (r.o.label, r.o.reason, r.o.bars) for r in b.withColumn("o", rolling.barrier_outcome(f, "atr", "dir", 1.5, 1.0, h, entry_at, both)).where("not halo").collect()}
        for i in range(n):
            e = (o[i + 1] if i + 1 < n else None) if entry_at == "next_open" else c[i]
            want = (None, "UNAVAILABLE", None)
            if e is not None and i + 1 < n:
                tp, sl = e + d[i] * 1.5 * 1.5, e - d[i] * 1.5
                res = None
                for k, j in enumerate(range(i + 1, min(i + h, n - 1) + 1), 1):
                    win, lose = (hi[j] >= tp, lo[j] <= sl) if d[i] > 0 else (lo[j] <= tp, hi[j] >= sl)
                    if d[i] * (o[j] - sl) <= 0:
                        res = (-1, "OPEN_STOP", k)
                    elif d[i] * (o[j] - tp) >= 0:
                        res = (1, "OPEN_TARGET", k)
                    elif win and lose:
                        res = (None, "AMBIGUOUS", k) if both == "ambiguous" else (-1, "STOP", k)
                    elif win or lose:
                        res = (1, "TARGET", k) if win else (-1, "STOP", k)
                    if res:
                        break
                want = res or ((0, "TIMEOUT", h) if i + h <= n - 1 else want)
            assert got[i] == want, (i, got[i], want)
