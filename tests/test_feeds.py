"""Feeds: reasons are kept, clocks respected, hashes checked."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tapewright.sources import feeds


def test_scalar_series(spark, tmp_path):
    (tmp_path / "f.csv").write_text("DATE,DGS10\n2024-01-02,3.95\n2024-01-03,.\nbad,1\n")
    got = [(r.series, str(r.day), r.value) for r in feeds.read_scalar_series(spark, str(tmp_path / "f.csv")).collect()]
    assert got == [("DGS10", "2024-01-02", 3.95), ("DGS10", "2024-01-03", None), ("DGS10", "None", 1.0)]
    d = spark.createDataFrame([(1704067200,), (1704067200000,), (5,)], "v long").select(feeds.utc_days(F.col("v")).alias("d")).collect()
    assert [str(r.d) for r in d] == ["2024-01-01", "2024-01-01", "None"]


def test_quotes(spark, tmp_path):
    now = 1_704_067_200_000_000
    make = lambda bid, ask, t, digest=None: json.dumps({"payload": {"symbol": "X", "bid": bid, "ask": ask, "as_of_us": t}, "sha256": digest or feeds.quote_digest("X", bid, ask, t)})
    (tmp_path / "q.json").write_text("\n".join([make(1.5, 1.75, now - 1_000_000), make(1.5, 1.75, now, "0"), make(1.5, 1.75, now - 16_000_000), make(1.5, 1.75, now + 3_000_000), make(1.75, 1.5, now), make(-1.5, 1.5, now), "{}"]))
    assert [r.reasons for r in feeds.read_quotes(spark, str(tmp_path / "q.json"), now).collect()] == [[], ["HASH"], ["STALE"], ["FUTURE"], ["CROSSED"], ["PRICE"], ["MALFORMED"]]


def test_filings(spark):
    ok = {"Ticker": " abc ", "Name": "P", "TransactionCode": "p", "Shares": 10, "PricePerShare": 2.5, "Date": "2024-01-01", "fileDate": "2024-01-03"}
    rows = [ok, {**ok, "Ticker": ""}, {**ok, "Date": "x"}, {**ok, "fileDate": "2023-01-01"}, {**ok, "Shares": None}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",), (None,)], "value string")
    got = feeds.normalise_filings(df).collect()
    assert [r.problem for r in got] == [None, "ticker", "date", "order", "amount", "ticker", "ticker"] and (got[0].ticker, got[0].amount) == ("ABC", 25.0)


def test_signals(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    p = spark.createDataFrame([("X", at(5), 0.4), ("X", at(9), -0.6), ("X", at(9), 0.01), ("Y", at(5), 0.9)], "symbol string, ts timestamp, score double")
    prices = spark.createDataFrame([("X", at(5), 10.0), ("X", at(9), 11.0)], "symbol string, ts timestamp, close double")
    f = spark.createDataFrame([(at(1), 1.0), (at(4), 2.0), (at(8), 3.0)], "ts timestamp, value double")
    got = sorted((r.ts.day, r.signal, r.cpi) for r in feeds.write_signals(p, prices, {"cpi": (f, 2)}, str(tmp_path / "s"), 0.1).collect())
    assert got == [(5, "BUY", 1.0), (9, "SELL", 2.0)]
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 100)
    got = {r.path.rpartition("/")[2]: r.sha256 for r in feeds.file_hashes(spark, str(tmp_path), 50).collect()}
    assert got == {"a.bin": hashlib.sha256(b"abc").hexdigest(), "b.bin": None}


def test_joined_daily(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "day int, x double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "day int, y double")
    assert [tuple(r) for r in feeds.joined_daily(a, b).collect()] == [(2, 2.0, 5.0)]
    with pytest.raises(Exception, match="twice"):
        feeds.joined_daily(a.union(a), b).collect()
    with pytest.raises(Exception, match="null"):
        feeds.joined_daily(a, b.withColumn("y", F.lit(None).cast("double"))).collect()
