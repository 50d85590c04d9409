"""Structured Streaming counterparts of the event operators: the same steps, with state kept by the engine.

Event-time aggregates use watermarks; per-key logic keeps a small state per key (`applyInPandasWithState`), whose
rows are sorted inside each micro-batch. Late rows are told apart before the aggregation, not dropped silently.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stateful(stream: DataFrame, key: str, order: list[str], init: Callable[[], dict], step: Callable[[dict, dict], dict], output: str, timeout: str = "NoTimeout") -> DataFrame:
    """Rows of `step(state, row)` per key; state is a JSON object. Rows of a key are taken in `order` within a batch."""
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else init()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out = [step(held, r) for r in rows.to_dict("records")]
        state.update((json.dumps(held),))
        yield pd.DataFrame([x for x in out if x is not None])

    return stream.groupBy(key).applyInPandasWithState(run, output, "held string", "append", timeout)


def ledger(stream: DataFrame) -> DataFrame:
    """trade_id, revision, action, outcome, active_revision: NEW, CORRECT and CANCEL applied, repeated or rejected, as in batch."""
    def step(s: dict, r: dict) -> dict:
        rev, action, digest, recv = int(r["revision"]), r["action"], r["digest"], int(r["receive_us"])
        if digest in s["seen"]:
            out = "DUPLICATE"
        elif s["clock"] is not None and recv < s["clock"]:
            out = "REJECT_CLOCK"
        elif action == "NEW" and s["rev"]:
            out = "REJECT_EXISTS"
        elif action == "NEW" and rev != 1:
            out = "REJECT_REVISION"
        elif action != "NEW" and not s["rev"]:
            out = "REJECT_UNKNOWN"
        elif action != "NEW" and s["dead"]:
            out = "REJECT_CANCELLED"
        elif action != "NEW" and rev != s["rev"] + 1:
            out = "REJECT_REVISION"
        else:
            out = "APPLIED"
            s["seen"].append(digest)
            s.update(rev=rev, dead=action == "CANCEL", clock=recv)
        return {"trade_id": r["trade_id"], "revision": rev, "action": action, "outcome": out, "active_revision": s["rev"]}

    return stateful(stream, "trade_id", ["receive_us", "revision", "digest"], lambda: {"rev": 0, "dead": False, "seen": [], "clock": None}, step, "trade_id long, revision int, action string, outcome string, active_revision int")


def sequence_guard(stream: DataFrame, key: str, order: list[str], seq: str, key_type: str = "string") -> DataFrame:
    """(key, seq, fault): MISSING, DUPLICATE, REGRESSION or GAP against the last sequence number seen."""
    def step(s: dict, r: dict) -> dict | None:
        v, last = r[seq], s["last"]
        if v is None or v != v:
            return {key: r[key], "seq": None, "fault": "MISSING"}
        v = int(v)
        fault = None if last is None or v == last + 1 else "DUPLICATE" if v == last else "REGRESSION" if v < last else "GAP"
        s["last"] = v
        return {key: r[key], "seq": v, "fault": fault} if fault else None

    return stateful(stream, key, order, lambda: {"last": None}, step, f"{key} {key_type}, seq long, fault string")


def range_velocity(stream: DataFrame, key: str, order: list[str], window: int = 20, key_type: str = "string") -> DataFrame:
    """(key, bar_id, velocity, z): (high - low) per second and its z against the `window` bars before, in constant state."""
    def step(s: dict, r: dict) -> dict:
        v = (r["high"] - r["low"]) / 60.0
        past = s["past"]
        z = None
        if len(past) == window:
            m = sum(past) / window
            sd = (sum((x - m) ** 2 for x in past) / window) ** 0.5
            z = (v - m) / sd if sd > 0 else 0.0
        past.append(v)
        del past[:-window]
        return {key: r[key], "bar_id": int(r["bar_id"]), "velocity": v, "z": z}

    return stateful(stream, key, order, lambda: {"past": []}, step, f"{key} {key_type}, bar_id long, velocity double, z double")


def three_state(stream: DataFrame, key: str, order: list[str], window: int = 10, efficiency: float = 0.4, least_bps: float = 2.0, key_type: str = "string") -> DataFrame:
    """(key, bar_id, state): UP, DOWN or RANGE by the efficiency ratio and the move over the last closes."""
    def step(s: dict, r: dict) -> dict:
        c = s["c"]
        c.append(float(r["close"]))
        del c[: -(window + 1)]
        state = "WARMUP"
        if len(c) == window + 1:
            path = sum(abs(b - a) for a, b in zip(c, c[1:]))
            move = c[-1] - c[0]
            ok = path > 0 and abs(move) / path >= efficiency and abs(move) / c[0] * 1e4 >= least_bps
            state = ("UP" if move > 0 else "DOWN") if ok else "RANGE"
        return {key: r[key], "bar_id": int(r["bar_id"]), "state": state}

    return stateful(stream, key, order, lambda: {"c": []}, step, f"{key} {key_type}, bar_id long, state string")


def flow_windows(stream: DataFrame, by: list[str], ts: str, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling event-time windows of signed flow under a watermark, in exact decimals."""
    q = F.col("quantity").cast("decimal(38,8)")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, q)), F.lit(0)).cast("decimal(38,8)")
    g = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w")).agg(of("BUY").alias("buy"), of("SELL").alias("sell"), F.sum(q).alias("total"), F.count("*").alias("trades"))
    return g.select(*by, F.col("w.start").alias("start"), "buy", "sell", "total", "trades")


def sessions(stream: DataFrame, by: list[str], ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows that close after a gap without events."""
    return stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def freshness(events: DataFrame, event_us: str, ingest_us: str, most_age_us: int, skew_us: int = 2_000_000) -> DataFrame:
    """`events` plus reasons ARRAY<STRING>: NO_CLOCK, FUTURE (beyond the skew) or STALE; empty means accepted. Works on streams and tables."""
    age = F.col(ingest_us) - F.col(event_us)
    r = F.array(F.when(F.col(event_us).isNull() | F.col(ingest_us).isNull(), "NO_CLOCK"), F.when(age < -skew_us, "FUTURE"), F.when(age > most_age_us, "STALE"))
    return events.withColumn("reasons", F.array_sort(F.filter(r, lambda x: x.isNotNull())))
