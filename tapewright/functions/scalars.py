"""Scalar functions of bars, quotes, macro points, bonds, text and time as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the headline sentiment score (fixed values).
POSITIVE = ("beat", "surge", "gain", "growth", "improve", "strong", "rise", "up", "positive", "exceeds", "record", "boost", "rally")
NEGATIVE = ("miss", "fall", "drop", "decline", "weak", "slow", "downgrade", "loss", "cut", "negative", "below", "fear", "plunge", "slump")
#: Seconds of a timeframe name; a month counts as 30 days (fixed values).
TIMEFRAMES = {"S10": 10, "1S": 1, "M1": 60, "1M": 60, "M5": 300, "5M": 300, "M15": 900, "15M": 900, "M30": 1800, "30M": 1800, "H1": 3600, "1H": 3600, "H4": 14400, "4H": 14400, "D1": 86400, "1D": 86400, "W1": 604800, "1W": 604800, "MN": 2592000, "1MO": 2592000}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def typical_price(h: str = "high", lo: str = "low", c: str = "close") -> Column:
    return (F.col(h) + F.col(lo) + F.col(c)) / 3


def upper_wick() -> Column:
    return F.col("high") - F.greatest("open", "close")


def lower_wick() -> Column:
    return F.least("open", "close") - F.col("low")


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def spread_bps(bid: Column | str, ask: Column | str) -> Column:
    """Spread in basis points of the mid; null for a zero mid."""
    mid = (_c(bid) + _c(ask)) / 2
    return F.when(mid != 0, (_c(ask) - _c(bid)) / F.when(mid != 0, mid) * 10_000)


def book_mid(bids: Column | str, asks: Column | str) -> Column:
    """(best bid + best ask) / 2 of ARRAY<STRUCT<price, size>> sides; null if a side is empty."""
    return (F.array_max(F.transform(_c(bids), lambda x: x["price"])) + F.array_min(F.transform(_c(asks), lambda x: x["price"]))) / 2


def book_size(side: Column | str) -> Column:
    return F.aggregate(_c(side), F.lit(0.0), lambda s, x: s + x["size"])


def timeframe_seconds(tf: Column | str) -> Column:
    """Seconds of a timeframe in any usual spelling, else null."""
    t = F.upper(F.trim(_c(tf)))
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in TIMEFRAMES.items()])


def floor_time(ts: Column | str, seconds: int) -> Column:
    """The period's start, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(_c(ts)) / F.lit(seconds * 1_000_000)) * seconds)


def session(ts: Column | str) -> Column:
    """Trading session by UTC hour: ASIA to 7, LONDON to 13, NEW_YORK_OVERLAP to 22, else ROLLOVER."""
    h = F.hour(_c(ts))
    return F.when(h < 7, "ASIA").when(h < 13, "LONDON").when(h < 22, "NEW_YORK_OVERLAP").otherwise("ROLLOVER")


def gap_class(start: Column | str, end: Column | str) -> Column:
    """weekend if the gap spans a Saturday, else gap."""
    days = F.sequence(F.to_date(_c(start)), F.to_date(_c(end)))
    return F.when(F.exists(days, lambda d: F.dayofweek(d) == 7), "weekend").otherwise("gap")


def to_utc(ts: Column | str, zone: str = "UTC") -> Column:
    return F.to_utc_timestamp(_c(ts), zone)


def in_zone(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(_c(ts), zone)


def iso(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(text: Column | str) -> Column:
    return _c(text).try_cast("timestamp")


# macro

def surprise(actual: Column | str, forecast: Column | str) -> Column:
    """(actual - forecast) / |forecast|, 0 for a zero forecast."""
    a, f = _c(actual), _c(forecast)
    return F.when(f == 0, 0.0).otherwise((a - f) / F.abs(F.when(f != 0, f)))


def surprise_class(s: Column | str, band: float = 0.01) -> Column:
    return F.when(_c(s) > band, "positive").when(_c(s) < -band, "negative").when(_c(s).isNotNull(), "neutral")


def policy_action(before: Column | str, after: Column | str) -> Column:
    return F.when(_c(after) > _c(before), "hike").when(_c(after) < _c(before), "cut").when(_c(after) == _c(before), "hold")


def real_yield(nominal: Column | str, inflation: Column | str, exact: bool = False) -> Column:
    """nominal - inflation, or exactly (1 + n) / (1 + i) - 1; absolute values above 1 are percent."""
    n, i = _c(nominal), _c(inflation)
    if not exact:
        return n - i
    n, i = (F.when(F.abs(x) > 1, x / 100).otherwise(x) for x in (n, i))
    return (1 + n) / F.when(i != -1, 1 + i) - 1


def macaulay_duration(coupon: Column | str, ytm: Column | str, periods: Column | str) -> Column:
    """Macaulay duration of a bond of face 1 in periods."""
    c, y, n = _c(coupon), _c(ytm), _c(periods)
    flows = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.cast("double").alias("k"), ((c + F.when(k == n, 1.0).otherwise(0.0)) / F.pow(1 + y, k)).alias("v")))
    price = F.aggregate(flows, F.lit(0.0), lambda s, x: s + x["v"])
    return F.aggregate(flows, F.lit(0.0), lambda s, x: s + x["k"] * x["v"]) / price


def bond_price_change(price: Column | str, duration: Column | str, dy: Column | str, convexity: Column | str) -> Column:
    return _c(price) * (-_c(duration) * _c(dy) + 0.5 * _c(convexity) * _c(dy) * _c(dy))


# text

def clean_headline(text: Column | str) -> Column:
    """Lower case, only letters, digits, blanks and a few signs, white space squeezed."""
    t = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s%.\-]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def news_text(text: Column | str) -> Column:
    """Lower-case text of letters, digits, `%`, `$`, `.` and `-`, single blanks between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9\s%$.-]", " "), r"\s+", " "))


def keyword_sentiment(text: Column | str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive - negative) / hits over the distinct words of `news_text`, 0 without hits. A word keeps the points and signs at its ends."""
    words = F.array_distinct(F.split(news_text(text), " "))
    p, n = (F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in (positive, negative))
    return (p - n) / F.greatest(p + n, F.lit(1))


# geometry, scaling and money

def menger_curvature(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Signed curvature through three points: four times the triangle's signed area over the product of its sides."""
    cross = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    side = lambda x1, y1, x2, y2: F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    prod = side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(cx, cy, ax, ay)
    return F.when(prod > 0, 2 * cross / F.when(prod > 0, prod)).otherwise(0.0)


def z_class(z: Column | str) -> Column:
    a = F.abs(_c(z))
    return F.when(a < 0.5, "normal").when(a < 1, "mild").when(a < 2, "moderate").when(a < 3, "strong").when(a.isNotNull(), "extreme")


def kelly(p: Column | str, odds: Column | str) -> Column:
    """(b p - q) / b; may be negative."""
    return (_c(odds) * _c(p) - (1 - _c(p))) / F.when(_c(odds) != 0, _c(odds))


def position_size(p: Column | str, odds: Column | str, fraction: float = 0.5, cap: float = 0.2) -> Column:
    """Kelly clipped at 0, scaled and capped."""
    return F.least(F.greatest(kelly(p, odds), F.lit(0.0)) * fraction, F.lit(cap))


def volatility_target(vol: Column | str, target: float = 0.15, most: float = 3.0) -> Column:
    return F.when(_c(vol) > 0, F.least(F.lit(target) / F.when(_c(vol) > 0, _c(vol)), F.lit(most)))


def normal_pdf(x: Column | str, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (_c(x) - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * (2 * 3.141592653589793) ** 0.5)


# hashes

def row_hash(*cols: str) -> Column:
    """SHA-256 of the row's values as JSON."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def set_hash(h: Column | str) -> Column:
    """Order-free hash of a group: SHA-256 of the sum and the exclusive-or of 64-bit row hashes, so it combines map-side."""
    x = F.xxhash64(_c(h))
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(x).cast("string"), F.sum(x.cast("decimal(38,0)")).cast("string")), 256)
