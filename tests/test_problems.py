"""General problems: brute force, giant groups, edges."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from tapewright.operators import hierarchy, nearest, regular_grid, spikes, stamps, strict_csv, trailing
from tapewright.plans import problems
from tapewright.runtime import table

UTC = dt.timezone.utc


def at(s):
    return dt.datetime.fromisoformat(s).replace(tzinfo=UTC)


def lineage(spark, edges):
    return spark.createDataFrame([(a, b, r, 1) for a, b, r in edges], "parent_hash string, child_hash string, relation string, path int")


def test_giant_components_give_the_same_rows(spark):
    t = table(spark, SF, "lineage")
    for f in (hierarchy.cycles, hierarchy.paths, hierarchy.descendants):
        assert rows(f(t).withColumn("x", F.lit(1)).toPandas().astype(str)) == rows(f(t, max_edges=3).withColumn("x", F.lit(1)).toPandas().astype(str)), f.__name__


def test_cycles_paths_and_descendants_of_a_small_graph(spark):
    df = lineage(spark, [("a", "b", "feeds"), (" A", "sha256:B", "Feeds "), ("b", "c", "derives"), ("a", "c", "produces"), ("c", "d", "feeds"), ("d", "c", "feeds"), ("d", "e", "feeds"), ("s", "s", "feeds"), (None, "z", "feeds"), ("e", None, "feeds"), ("q", "r", None), ("e", "a", "cites")])
    assert sorted(map(tuple, hierarchy.cycles(df).collect())) == [("c", "c"), ("d", "c"), ("s", "s")]
    p = {r.artifact_hash: (r.root_hash, r.depth, r.max_depth, r.n_paths, r.path) for r in hierarchy.paths(df).collect()}
    assert p == {"a": ("a", 0, 0, 1, ["a"]), "b": ("a", 1, 1, 1, ["a", "b"]), "c": ("a", 1, 2, 2, ["a", "c"]), "e": ("a", 2, 3, 2, ["a", "c", "e"]), "s": ("s", 0, 0, 1, ["s"])}
    d = {(r[0], r[1]): r[2] for r in hierarchy.descendants(df).collect()}
    assert d[("a", "e")] == 3 and d[("c", "c")] == 2 and d[("s", "s")] == 1 and ("e", "a") not in d
    assert hierarchy.cycles(df.limit(0)).count() == 0 and hierarchy.paths(df.limit(0)).count() == 0


def test_every_path_from_every_root(spark):
    df = lineage(spark, [("r", "a", "feeds"), ("r", "b", "feeds"), ("a", "c", "feeds"), ("b", "c", "feeds"), ("a", "b", "feeds"), ("s", "b", "feeds"), ("c", "d", "feeds"), ("d", "c", "feeds"), ("d", "e", "feeds")])
    want = {"r": (0, 1), "r>a": (1, 1), "r>b": (2, 2), "r>a>b": (2, 2), "r>a>c": (3, 3), "r>b>c": (3, 3), "r>a>b>c": (3, 3), "r>a>c>e": (4, 3), "r>b>c>e": (4, 3), "r>a>b>c>e": (4, 3)}
    want |= {"s": (0, 1), "s>b": (1, 1), "s>b>c": (2, 1), "s>b>c>e": (3, 1)}
    for most in (hierarchy.MAX_EDGES, 3):
        got = hierarchy.every_path(df, most).collect()
        assert {">".join(r.path): (r.max_depth, r.n_paths) for r in got} == want and len(got) == len(want)
        assert all((r.root_hash, r.artifact_hash, r.depth) == (r.path[0], r.path[-1], len(r.path) - 1) for r in got)
    assert hierarchy.every_path(df.limit(0)).count() == 0


def test_p1_paths_leaves_no_path_out(spark):
    t = problems.p1_paths(spark, SF).toPandas()
    one = hierarchy.paths(table(spark, SF, "lineage")).toPandas()
    n = t.groupby(["artifact_hash", "root_hash"]).agg(rows=("path", "nunique"), all=("path", "size"), shortest=("depth", "min"), longest=("depth", "max")).reset_index()
    m = n.merge(one, on=["artifact_hash", "root_hash"], how="outer")
    assert len(m) == len(one) < len(t) == one.n_paths.sum()
    assert (m.rows == m.n_paths).all() and (m["all"] == m.n_paths).all() and (m.shortest == m.depth).all() and (m.longest == m.max_depth).all()
    assert rows(hierarchy.every_path(table(spark, SF, "lineage"), max_edges=3).withColumn("path", F.array_join("path", ">")).toPandas()) == rows(t)


def test_a_long_chain_and_a_hub(spark):
    df = lineage(spark, [(f"n{i:04}", f"n{i + 1:04}", "feeds") for i in range(1500)] + [("hub", f"leaf{i}", "feeds") for i in range(3000)])
    assert hierarchy.paths(df).agg(F.max("depth"), F.count("*")).first()[:] == (1500, 4502)


def test_cycles_of_a_component_of_a_million_edges(spark):
    n = 1_000_000  # a binary tree; some nodes lead back three levels up
    name = lambda c: F.lpad(c.cast("string"), 7, "0")
    down = spark.range(2, n).select(name(F.floor(F.col("id") / 2)).alias("parent_hash"), name(F.col("id")).alias("child_hash"), F.lit("feeds").alias("relation"))
    up = spark.range(8, n).where("id % 997 = 7").select(name(F.col("id")), name(F.floor(F.col("id") / 8)), F.lit("feeds"))
    top: dict[int, int] = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for i in range(8, n):
        if i % 997 == 7:
            for j in (i >> 1, i >> 2, i >> 3):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    want = {f"{i:07}": f"{find(i):07}" for i in list(top)}
    assert dict(map(tuple, hierarchy.cycles(down.union(up), max_edges=1_000).collect())) == want
    edges = down.union(up).select(F.col("parent_hash").alias("parent"), F.col("child_hash").alias("child"))
    assert dict(map(tuple, hierarchy.coloured(edges).collect())) == want


def test_a_corrected_history_equals_a_fresh_one(spark):
    rng = random.Random(2)
    days = [dt.datetime(2024, 1, 1, 12, tzinfo=UTC) + dt.timedelta(days=i) for i in range(70)]
    r = [(i, rng.choice(["A", " a", "B"]), rng.choice(days), rng.choice([None, 10.25, 11.5, float("nan")]), rng.choice([None, 0.0, 5.0, 7.75, float("nan")]), dt.datetime(2024, 5, 1, tzinfo=UTC) + dt.timedelta(seconds=i), 0) for i in range(60)]
    schema = "daily_id long, symbol string, timestamp timestamp, close double, volume double, received_at timestamp, day int"
    before, after = (trailing.daily_amounts(spark.createDataFrame(x, schema)) for x in (r[:45], r))
    old, new = trailing.rolling_state(before), trailing.rolling_state(after)
    changed = trailing.advance(old, before, after)
    kept = old.join(changed, ["symbol", "day"], "left_anti").unionByName(changed).where("version > 0").drop("version")
    assert rows(kept.toPandas()) == rows(new.drop("version").toPandas())
    assert trailing.advance(old, before, before).count() == 0
    assert trailing.rolling_state(before.limit(0)).count() == 0


def test_corrections_in_turn_keep_versions_and_end_at_the_fresh_state(spark):
    rng = random.Random(5)
    days = [dt.datetime(2024, 1, 1, 12, tzinfo=UTC) + dt.timedelta(days=3 * i) for i in range(30)]
    r = [(i, rng.choice(["A", "B", "C"]), rng.choice(days), rng.choice([None, 10.25, float("nan")]), rng.choice([None, 0.0, 5.0]), dt.datetime(2024, 5, 1, tzinfo=UTC) + dt.timedelta(seconds=i), 0) for i in range(50)]
    schema = "daily_id long, symbol string, timestamp timestamp, close double, volume double, received_at timestamp, day int"
    amounts = lambda n: trailing.daily_amounts(spark.createDataFrame(r[:n], schema))
    state, seen = trailing.cut(trailing.rolling_state(amounts(20))), {}
    for a, b in ((20, 35), (35, 50)):
        before = {(x.symbol, x.day): x.version for x in state.collect()}
        changed = trailing.cut(trailing.advance(state, amounts(a), amounts(b)))
        assert all(x.version == before.get((x.symbol, x.day), 0) + 1 for x in changed.collect())
        state = trailing.cut(trailing.applied(state, changed))
        seen |= before
        assert set(seen) <= {(x.symbol, x.day) for x in state.select("symbol", "day").collect()}
        assert rows(state.drop("version").toPandas()) == rows(trailing.rolling_state(amounts(b)).drop("version").toPandas())


def test_a_correction_that_comes_late_changes_the_rows(spark):
    t = lambda d: dt.datetime(2024, 1, d, 12, tzinfo=UTC)
    r = [(1, "A", t(1), 1.0, 5.0, t(1)), (2, "A", t(12), 1.0, 5.0, t(12)), (3, "A", t(3), 2.0, 7.0, t(20)), (4, "A", t(25), 2.0, 1.0, t(30)), (5, None, t(1), 1.0, 1.0, t(9)), (6, "A", None, 1.0, 1.0, t(9)), (7, "B", t(2), None, None, None)]
    df = spark.createDataFrame(r, "daily_id long, symbol string, timestamp timestamp, close double, volume double, received_at timestamp")
    got = {x.day.day: (float(x.volume_7), x.version) for x in trailing.maintained(df).where("live").collect()}
    assert len(got) == 25 and got[1] == (5, 1) and got[3] == (12, 2) and got[9] == (7, 2) and got[12] == (5, 2) and got[20] == (0, 1) and got[25] == (1, 1)
    assert trailing.maintained(df.limit(0)).count() == 0


def test_nearest_edges(spark):
    left = spark.createDataFrame([(1, "s", at("2024-01-01T00:02:00"), 9), (2, "s", at("2024-01-01T03:00:00"), 9), (3, None, at("2024-01-01T00:02:00"), 9), (4, "s", None, 9), (1, "s", at("2024-01-01T00:02:00"), 9)], "bar_id long, e string, t timestamp, r int")
    right = spark.createDataFrame([(7, "s", at("2024-01-01T00:00:00")), (6, "s", at("2024-01-01T00:00:00")), (5, "s", at("2024-01-01T00:04:00")), (8, "s", at("2024-01-01T02:57:59.999999")), (9, "x", at("2024-01-01T03:00:00"))], "dxy_id long, e string, t timestamp")
    kw = {"entity": "e", "left_time": "t", "right_time": "t", "left_id": "bar_id", "right_id": "dxy_id", "tolerance_us": 120_000_000}
    assert sorted(map(tuple, nearest.nearest_in_time(left, right, **kw).collect())) == [(1, 6, 120_000_000)] * 2
    assert nearest.nearest_in_time(left.limit(0), right, **kw).count() == nearest.nearest_in_time(left, right.limit(0), **kw).count() == 0


def test_nearest_against_brute_force_across_buckets(spark):
    rng = random.Random(4)
    a = [(i, "s", rng.randrange(0, 40_000_000)) for i in range(400)]
    b = [(i, "s", rng.randrange(0, 40_000_000)) for i in range(300)]
    df = lambda x, n: spark.createDataFrame(x, f"{n} long, e string, us long").withColumn("t", F.timestamp_micros("us"))
    got = {r[0]: r[1] for r in nearest.nearest_in_time(df(a, "l"), df(b, "q"), entity="e", left_time="t", right_time="t", left_id="l", right_id="q", tolerance_us=20_000).collect()}
    want = {}
    for i, _, t in a:
        best = min(((abs(t - u), u, j) for j, _, u in b if abs(t - u) <= 20_000), default=None)
        if best:
            want[i] = best[2]
    assert got == want


def test_the_filter_decides_what_is_checked(spark):
    t0 = at("2024-01-01T00:00:00")
    ticks = [10.0 + i % 3 for i in range(40)] + [300.0, 11.0, 120.0] + [10.0 + i % 3 for i in range(7)] + [5.0] * 8
    bars = [(i, "s", "X", t0 + dt.timedelta(minutes=5 * i), 10.0, 11.0 + i % 2, 9.0 - 0.1 * (i % 3), 10.0, None, v) for i, v in enumerate(ticks)]
    df = spark.createDataFrame(bars, "bar_id long, source string, symbol string, timestamp timestamp, open double, high double, low double, close double, spread double, tick_volume double")
    kinds = lambda **kw: {r.bar_id: r.kind for r in spikes.flag_spikes(df, **kw).where("field = 'tick_volume'").collect()}
    stuck = dict.fromkeys(range(50, 58), "stuck")
    assert kinds() == {40: "spike", 42: "suspect"} | stuck
    assert kinds(threshold=30.0) == {40: "spike"} | stuck and kinds(threshold=60.0) == stuck


def test_runs_continue_across_blocks(spark):
    t0 = at("2024-01-01T00:00:00")
    bars = [(i, "s", "X", t0 + dt.timedelta(minutes=5 * i), 10.0, 11.0 + (0.5 if i % 2 else 0), 9.0 - 0.1 * (i % 3), 10.0, 2.5 if 20 <= i < 29 else 1.0 + i % 7, None) for i in range(60)]
    bars.append((900, "s", " x", t0 + dt.timedelta(minutes=100), 10.0, 11.5, 9.0, 10.0, 2.5, None))
    bars.append((901, "s", "X", None, 10.0, -1.0, 9.0, 10.0, 2.0, None))
    df = spark.createDataFrame(bars, "bar_id long, source string, symbol string, timestamp timestamp, open double, high double, low double, close double, spread double, tick_volume double")
    for block in (900, 1800, 86_400):
        got = sorted((r.bar_id, r.field, r.kind) for r in spikes.flag_spikes(df, block_s=block).collect())
        assert got == [(i, "spread", "stuck") for i in range(20, 29)], block
    assert spikes.flag_spikes(df.limit(0)).count() == 0


def test_impossible_and_spiking_values(spark):
    t0 = at("2024-01-01T00:00:00")
    bars = [[i, "s", "X", t0 + dt.timedelta(minutes=5 * i), 10.0, 10.2 + 0.01 * (i % 9), 9.8 - 0.01 * (i % 9), 10.0, 1.0 + i % 5, 100.0 + i] for i in range(100)]
    bars[10][5], bars[11][5], bars[12][6], bars[13][8], bars[14][9], bars[15][5] = float("nan"), 9.0, float("inf"), -1.0, 9e4, 30.0
    bars[16][4], bars[17][5] = float("nan"), None
    df = spark.createDataFrame(bars, "bar_id long, source string, symbol string, timestamp timestamp, open double, high double, low double, close double, spread double, tick_volume double")
    got = sorted((r.bar_id, r.field, r.kind) for r in spikes.flag_spikes(df).collect())
    assert got == [(10, "high", "impossible"), (11, "high", "impossible"), (12, "low", "impossible"), (13, "spread", "impossible"), (14, "tick_volume", "spike"), (15, "high", "spike")]


@pytest.mark.parametrize("line,fields", [("", [""]), ("a,b", ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('"x""y",', ['x"y', ""]), ('"open', None), ('a"b,c', None), ('"a"b,c', None), ('""', [""]), ('"a\nb",""', ["a\nb", ""]), (",", ["", ""])])
def test_splitting(line, fields):
    assert strict_csv.split_quoted(line) == fields


def test_reasons_in_order(spark):
    good = "A,2024-01-01 00:00:00,1,2,1,1,{v},n"
    lines = {good.format(v=""): None, good.format(v=" 5 "): None, good.format(v="1e3"): None, good.format(v="-1"): "volume", good.format(v="1."): "volume", good.format(v="1e999"): "volume", good.format(v="٣"): "volume",
             good.format(v="5") + ",x": "columns", "": "columns", None: "columns", '"': "quoting", good.format(v="5").replace("01-01", "02-30"): "timestamp", good.format(v="5").replace("00:00:00", "24:00:00"): "timestamp",
             good.format(v="5").replace(",1,2", ",0,2"): "open", good.format(v="5").replace(",1,2", ",+1.5E-1,2"): None, strict_csv.HEADER: None, '"' + "x" * 200_000 + '""' * 50_000: "quoting", good.format(v="5").replace(",n", ',"' + 'y""' * 50_000 + '"'): None, "A,2024.01.01 23:59,1,x,1,1,,": None, "A,2024-01-01T00:00:00Z,,x,1,1,,": "open"}
    df = spark.createDataFrame([(i, "f", i, x) for i, x in enumerate(lines)], "raw_id long, file_name string, line_no int, line string")
    got = {r.raw_id: r.reason for r in strict_csv.rejected(df).collect()}
    assert got == {i: w for i, w in enumerate(lines.values()) if w}
    loaded = strict_csv.strict_load(df)
    assert {r.raw_id for r in loaded.collect()} == {i for i, (x, w) in enumerate(lines.items()) if not w and x != strict_csv.HEADER}
    assert strict_csv.rejected(df.limit(0)).count() == 0


def pchip(t, v, x):
    n = len(t)
    h = [t[i + 1] - t[i] for i in range(n - 1)]
    d = [(v[i + 1] - v[i]) / h[i] for i in range(n - 1)]

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m = [0.0] * n
    for i in range(1, n - 1):
        m[i] = 0 if d[i - 1] * d[i] <= 0 else (3 * (h[i - 1] + h[i])) / ((2 * h[i] + h[i - 1]) / d[i - 1] + (h[i] + 2 * h[i - 1]) / d[i])
    m[0], m[-1] = (end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])) if n > 2 else (d[0], d[0])
    i = max(j for j in range(n - 1) if t[j] <= x)
    u = (x - t[i]) / h[i]
    return (1 + 2 * u) * (1 - u) ** 2 * v[i] + u * (1 - u) ** 2 * h[i] * m[i] + u * u * (3 - 2 * u) * v[i + 1] + u * u * (u - 1) * h[i] * m[i + 1]


@pytest.mark.parametrize("shard", [1, 2, 5, 4096])
def test_grid_against_brute_force(spark, shard):
    rng = random.Random(6)
    slots = sorted(rng.sample(range(100, 180), 30)) + [400, 402, 900, 905, 2000]
    pts = [(s, s * 60 + rng.uniform(0, 59), rng.uniform(1, 9)) for s in slots]
    data = [(i, "s", " x", "M1", at("1970-01-01T00:00:00") + dt.timedelta(seconds=t), c, at("2024-01-01T00:00:00")) for i, (_, t, c) in enumerate(pts)]
    data.append((99, "s", "X", "M1", data[0][4], float("nan"), at("2024-01-01T00:00:00")))
    data.append((98, "s", "X", "M1", data[-1][4] + dt.timedelta(days=1), None, at("2024-01-01T00:00:00")))
    df = spark.createDataFrame(data, "reading_id long, source string, symbol string, timeframe string, timestamp timestamp, close double, received_at timestamp").withColumn("slot", F.lit(1))
    got = {r.slot_epoch // 60: (r.close, r.status) for r in regular_grid.regular_grid(df, shard_periods=shard).collect()}
    assert sorted(got) == list(range(slots[0], slots[-1] + 1))
    segments, cur = [], [0]
    for i in range(1, len(slots)):
        if slots[i] - slots[i - 1] - 1 > regular_grid.MAX_GAP:
            segments.append(cur)
            cur = []
        cur.append(i)
    segments.append(cur)
    us = lambda t: round(t * 1e6) / 1e6
    for s, (c, status) in got.items():
        if s in slots:
            assert status == "observed" and c == pts[slots.index(s)][2]
            continue
        inside = [g for g in segments if slots[g[0]] < s < slots[g[-1]]]
        assert status == ("filled" if inside else "gap")
        if inside:
            g = inside[0]
            assert math.isclose(c, pchip([us(pts[i][1]) for i in g], [pts[i][2] for i in g], s * 60), rel_tol=1e-7)
        else:
            assert c is None
    assert regular_grid.regular_grid(df.limit(0)).count() == 0


STAMPS = {
    "2024-03-10 02:30:00": ("ny", "2024-03-10T07:30:00"), "2024-11-03 01:30:00": ("ny", "2024-11-03T05:30:00"), "2024-07-01T00:00:00.123456789": (None, "2024-07-01T00:00:00.123456"), "07/04/2024 12:00:00 AM": ("ny", "2024-07-04T04:00:00"),
    "25/12/2024 10:00:00": ("ny", None), "1.2.2024 03:04": ("tokyo", "2024-01-31T18:04:00"), "2024.02.01 03:04": ("tokyo", "2024-01-31T18:04:00"), "Sun, 07 Apr 2024 02:12:56 +0545": ("ny", "2024-04-06T20:27:56"), "May 17, 2024 10:00:00": ("ny", "2024-05-17T14:00:00"), "17 May 2024": (None, "2024-05-17T00:00:00"), "7-Apr-2024 01:00": (None, "2024-04-07T01:00:00"), "2024/02/01 03:04": ("tokyo", "2024-01-31T18:04:00"), "2024.2.1": (None, "2024-02-01T00:00:00"), "7 Apr 2024, 02:12:56": ("tokyo", "2024-04-06T17:12:56"),
    "2024-10-27T02:15:02+02:00[Europe/Berlin]": ("ny", "2024-10-27T00:15:02"), "2024-01-02 03:04:05 JST": ("ny", "2024-01-01T18:04:05"), "20240102T030405Z": ("ny", "2024-01-02T03:04:05"), "20240102 030405": ("tokyo", "2024-01-01T18:04:05"), "20240102": ("tokyo", "2024-01-01T15:00:00"), "2024-01-02": (None, "2024-01-02T00:00:00"),
    "1704164645": ("ny", "2024-01-02T03:04:05"), "1704164645123": ("ny", "2024-01-02T03:04:05.123000"), "1704164645123456": ("ny", "2024-01-02T03:04:05.123456"), "1704164645123456789": ("ny", "2024-01-02T03:04:05.123456"), "1704164645.5": ("ny", "2024-01-02T03:04:05.500000"), "12": ("ny", None), "": ("ny", None), " ": ("ny", None), "n/a": ("ny", None),
    "2024-02-30 00:00:00": ("ny", None), "2023-02-29": ("ny", None), "2024-01-02 24:00:00": ("ny", None), "13/45/2024": ("ny", None), "2024-01-02 03:04:05 XYZ": ("ny", None), " 2024-01-02T03:04:05Z ": ("ny", "2024-01-02T03:04:05"), "2024-01-02 03:04:05,5": (None, "2024-01-02T03:04:05.500000"), "x" * 100_000: ("ny", None), "9" * 50_000: ("ny", None), "2024-01-02 03:04:05-03": ("ny", "2024-01-02T06:04:05"),
}


def test_stamps(spark):
    src = spark.createDataFrame([("ny", "America/New_York", "k"), ("tokyo", "Asia/Tokyo", "k"), ("utc", None, "k"), ("bad", "Mars/Base", "k")], "source string, zone_name string, layout string")
    ab = spark.createDataFrame([("JST", 540), ("EST", -300)], "abbrev string, offset_minutes int")
    data = [(i, s or "utc", t) for i, (t, (s, _)) in enumerate(STAMPS.items())] + [(900, "ny", None), (901, "bad", "2024-01-02"), (902, "missing", "2024-01-02"), (903, None, "2024-01-02")]
    df = spark.createDataFrame(data, "record_id long, source string, timestamp string").withColumn("layout", F.lit("x"))
    got = {int(r.record_key): r for r in stamps.normalise_stamps(df, "record_id", "timestamp", src, ab).collect()}
    assert len(got) == len(data)
    for i, (t, (_, want)) in enumerate(STAMPS.items()):
        r = got[i]
        us = None if want is None else int((at(want) - at("1970-01-01T00:00:00")) / dt.timedelta(microseconds=1))
        assert (r.utc_us if r.status != "contrary" else None) == us, t[:60]
    assert got[900].status == got[901].status == "unreadable" and got[902].status == got[903].status == "read"
    assert got[list(STAMPS).index("25/12/2024 10:00:00")].status == "contrary"
    assert stamps.normalise_stamps(df.limit(0), "record_id", "timestamp", src, ab).count() == 0


def test_ambiguity_is_marked():
    out = stamps._fit(pd.DataFrame({"source": ["s", "s"], "signature": ["point_dmy|point_ymd", "iso"], "n": [5, 5]}))
    assert out.posterior[0] < stamps.CERTAIN <= out.posterior[1]
    out = stamps._fit(pd.DataFrame({"source": ["s", "s"], "signature": ["slash_dmy|slash_mdy", "slash_dmy"], "n": [5, 50]}))
    assert out.layout[0] == "slash_mdy"


def test_a_source_outweighs_the_conventions(spark):
    src = spark.createDataFrame([("a", None)], "source string, zone_name string")
    ab = spark.createDataFrame([], "abbrev string, offset_minutes int")
    day_first = [(i, "a", f"{13 + i % 15}/{1 + i % 12}/2024") for i in range(2500)]
    for n, want in ((2500, ("2024-06-05", "read", "read", "contrary")), (100, ("2024-05-06", "ambiguous", "contrary", "read")), (0, ("2024-05-06", "read", None, "read"))):
        df = spark.createDataFrame([*day_first[:n], (9000, "a", "05/06/2024"), (9001, "a", "05/16/2024")], "record_id long, source string, timestamp string")
        got = {int(r.record_key): r for r in stamps.normalise_stamps(df, "record_id", "timestamp", src, ab).where("record_key in (0, 9000, 9001)").collect()}
        assert got[9000].utc_us == (at(want[0]) - at("1970-01-01")) / dt.timedelta(microseconds=1)
        assert (got[9000].status, got[0].status if n else None, got[9001].status) == want[1:]


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_queries_have_unique_found_rows(spark, name):
    df = problems.QUERIES[name](spark, SF)
    n = df.count()
    assert n > 0
    if name.endswith("_found"):
        assert df.distinct().count() == n
