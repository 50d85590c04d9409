"""Trades against quotes and event-by-event order flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.operators.folds import Step, ordered_fold


def _quote_before(max_age_us: int) -> Step:
    """Latest eligible quote of a trade: earlier in event time, received by the trade's receipt; two at that time are ambiguous."""
    quotes: deque[tuple] = deque()

    def step(kind: int, t: int, recv: int, a: float | None, b: float | None) -> tuple:
        if kind == 0:
            quotes.append((t, recv, a, b))
            return None, None, None, None
        while quotes and quotes[0][0] < t - max_age_us:
            quotes.popleft()
        best, n = None, 0
        for q in reversed(quotes):
            if best is not None and q[0] != best[0]:
                break
            if q[0] < t and q[1] <= recv:
                best, n = q, n + 1
        if best is None:
            return "NO_QUOTE", None, None, None
        if n > 1:
            return "AMBIGUOUS", None, None, best[0]
        price = a
        side = "BUY" if price >= best[3] else "SELL" if price <= best[2] else "INSIDE"
        return side, best[2], best[3], best[0]

    return step


def classify_trades(trades: DataFrame, quotes: DataFrame, by: str, max_age_us: int, bucket_us: int | None = None) -> DataFrame:
    """(trade_id, side, bid, ask, quote_us): BUY at or above the ask, SELL at or below the bid, else INSIDE.

    trades: by, trade_id, event_us, receive_us, price; quotes: by, event_us, receive_us, bid, ask. The quote is the
    latest strictly earlier one that had been received when the trade was, no older than the limit; two at that
    event time are AMBIGUOUS, none is NO_QUOTE. Time buckets with a halo of the age limit split a hot instrument.
    """
    width = bucket_us or max(max_age_us * 50, 1)
    floor = lambda c: F.floor(c / F.lit(width))
    t = trades.select(F.col(by).alias("k"), "trade_id", F.lit(1).alias("kind"), "event_us", "receive_us", F.col("price").alias("a"), F.lit(None).cast("double").alias("b")).withColumn("block", floor(F.col("event_us")))
    q = quotes.select(F.col(by).alias("k"), F.lit(None).cast("bigint").alias("trade_id"), F.lit(0).alias("kind"), "event_us", "receive_us", F.col("bid").alias("a"), F.col("ask").alias("b"))
    q = q.withColumn("block", F.explode(F.array_distinct(F.array(floor(F.col("event_us")), floor(F.col("event_us") + max_age_us)))))
    both = t.unionByName(q).where("k is not null and event_us is not null and receive_us is not null")
    out = ordered_fold(both, ["k", "block"], ["event_us", "kind", "trade_id"], ["kind", "event_us", "receive_us", "a", "b"], ["trade_id", "kind"], lambda: _quote_before(max_age_us), [("side", T.StringType()), ("bid", T.DoubleType()), ("ask", T.DoubleType()), ("quote_us", T.LongType())])
    return out.where("kind = 1").drop("kind")


def flow_windows(classified: DataFrame, by: Sequence[str], ts: str, width: str) -> DataFrame:
    """Half-open time windows of signed flow: buy, sell and unsigned quantity in exact decimals, delta and the signed share."""
    q = F.col("quantity").cast("decimal(38,8)")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, q)), F.lit(0)).cast("decimal(38,8)")
    g = classified.groupBy(*by, F.window(ts, width).alias("w")).agg(of("BUY").alias("buy"), of("SELL").alias("sell"), F.sum(q).cast("decimal(38,8)").alias("total"), F.count("*").alias("trades"))
    return g.select(*by, F.col("w.start").alias("start"), "buy", "sell", "total", "trades", (F.col("buy") - F.col("sell")).cast("decimal(38,8)").alias("delta"), F.try_divide((F.col("buy") + F.col("sell")).cast("double"), F.col("total").cast("double")).alias("signed_share"))


def cumulative_delta(windows: DataFrame, by: Sequence[str], order: str, session: str) -> DataFrame:
    """`windows` plus cvd: the running delta, starting again whenever the session changes."""
    w = Window.partitionBy(*by).orderBy(order)
    x = windows.withColumn("_new", F.when(F.col(session) == F.lag(session).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("cvd", F.sum("delta").over(run)).drop("_new", "_run")


def _clusters(width_us: int, least: int, volume: float) -> Step:
    """Anchored windows: a window opens at a print and holds those before t0 + width; enough prints and volume make a cluster."""
    held: list[tuple[int, float]] = []
    n = 0

    def close(until: int | None) -> list[tuple]:
        nonlocal n
        found = []
        while held and (until is None or held[0][0] + width_us <= until):
            t0 = held[0][0]
            inside = [x for x in held if x[0] < t0 + width_us]
            if len(inside) >= least and sum(v for _, v in inside) >= volume:
                n += 1
                found.append((n, t0, inside[-1][0], len(inside), sum(v for _, v in inside)))
                del held[: len(inside)]
            else:
                held.pop(0)
        return found

    def step(t: int | None, v: float | None) -> tuple:
        if t is None:
            f = close(None)
        else:
            f = close(t)
            held.append((t, v))
        return (";".join(",".join(map(str, x)) for x in f) or None,)

    return step


def anchored_clusters(prints: DataFrame, by: str, t_us: str, volume: str, width_us: int, least: int, least_volume: float) -> DataFrame:
    """(by, cluster, from_us, to_us, prints, volume): non-overlapping windows anchored at a print.

    If the window from a print doesn't qualify, the anchor moves on one print, else beyond the window. The state is
    the prints of one window.
    """
    p = prints.where(F.col(t_us).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("k"), F.col(t_us).alias("t"), F.col(volume).cast("double").alias("v"))
    last = p.select("k").distinct().select("k", F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("v"))
    rows = p.union(last).withColumn("o", F.coalesce(F.col("t"), F.lit((1 << 62))))
    out = ordered_fold(rows, ["k"], ["o", "v"], ["t", "v"], ["k"], lambda: _clusters(width_us, least, least_volume), [("c", T.StringType())])
    c = out.where("c is not null").select("k", F.explode(F.split("c", ";")).alias("c")).select("k", F.split("c", ",").alias("c"))
    at = lambda i: F.col("c")[i]
    return c.select(F.col("k").alias(by), at(0).cast("int").alias("cluster"), at(1).cast("bigint").alias("from_us"), at(2).cast("bigint").alias("to_us"), at(3).cast("int").alias("prints"), at(4).cast("double").alias("volume"))


def sequence_faults(events: DataFrame, by: str, order: Sequence[str], seq: str) -> DataFrame:
    """(by, seq, fault): what breaks the strict +1 order of arrival: MISSING, DUPLICATE, REGRESSION or GAP.

    A missing number doesn't count as the last one. `order` starts with a timestamp; blocks with a halo row split a hot stream.
    """
    known = events.where(F.col(seq).isNotNull())
    f = Frames(keys=(by, "block"))
    d = with_halo(numbered(known.select(by, *order, seq) if seq not in order else known.select(by, *order), [by], order[0], list(order[1:]) or [seq]), before=1)
    last = f.lag(seq)
    fault = F.when(F.col(seq) == last, "DUPLICATE").when(F.col(seq) < last, "REGRESSION").when(F.col(seq) > last + 1, "GAP")
    d = d.withColumn("fault", fault).where("not halo and fault is not null").select(by, seq, "fault")
    return d.union(events.where(F.col(seq).isNull()).select(by, seq, F.lit("MISSING").alias("fault")))


def _ledger() -> Step:
    """One trade's revisions: NEW, then CORRECT or CANCEL of the next revision; exact repeats are idempotent."""
    revision, dead, seen, clock = 0, False, set(), None

    def step(action: str, rev: int, recv: int, digest: str) -> tuple:
        nonlocal revision, dead, clock
        if digest in seen:
            return "DUPLICATE", revision
        if clock is not None and recv < clock:
            return "REJECT_CLOCK", revision
        if action == "NEW":
            if revision:
                return "REJECT_EXISTS", revision
            if rev != 1:
                return "REJECT_REVISION", revision
        elif not revision:
            return "REJECT_UNKNOWN", revision
        elif dead:
            return "REJECT_CANCELLED", revision
        elif rev != revision + 1:
            return "REJECT_REVISION", revision
        seen.add(digest)
        revision, dead, clock = rev, action == "CANCEL", recv
        return "APPLIED", revision

    return step


def replay_ledger(mutations: DataFrame, trade: str = "trade_id") -> DataFrame:
    """`trade`, revision, action, outcome, active_revision: each mutation applied, repeated or rejected with its reason.

    mutations: trade, action (NEW, CORRECT, CANCEL), revision, receive_us, digest. State is one trade's.
    """
    return ordered_fold(mutations, [trade], ["receive_us", "revision", "digest"], ["action", "revision", "receive_us", "digest"], [trade, "revision", "action"], _ledger, [("outcome", T.StringType()), ("active_revision", T.IntegerType())])
