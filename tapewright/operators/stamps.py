"""Mixed timestamp formats and time zones: expectation-maximisation over format mixtures per source.

Every text is parsed once, under each layout that admits it, and what was parsed is cut. The layouts a text admits are
its signature; per source a mixture over layouts is fitted to the signature counts (a small table: sources times
signatures), each text giving likelihood to all of its valid parses. The conventions of the data are prior counts, which a
source's own texts can outweigh. The posterior picks the parse; what stays below CERTAIN is marked ambiguous. Parsing is
built-in expressions without lambdas, one per text's own layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.runtime import cut

_TIME = r"(?:(?:T|t|,?\s+)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?)?"
_ZONE = r"\s*([A-Za-z+\-\[][^|]*)?$"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Layout: pattern, and its groups as year|month|day|hour|minute|second|fraction|am or pm|zone. The first whose guard admits a text is tried.
LAYOUTS = {
    "iso": (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_TIME}{_ZONE}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "point_dmy": (rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){_TIME}{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "slash_mdy": (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){_TIME}{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "point_ymd": (rf"^([0-9]{{4}})\.([0-9]{{1,2}})\.([0-9]{{1,2}}){_TIME}{_ZONE}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "slash_ymd": (rf"^([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}){_TIME}{_ZONE}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "day_month_name": (rf"(?i)^(?:[a-z]{{3,9}},?\s+)?([0-9]{{1,2}})[ -]+{_MONTH}[ -]+([0-9]{{4}}){_TIME}{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "month_name_day": (rf"(?i)^(?:[a-z]{{3,9}},?\s+)?{_MONTH}\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}){_TIME}{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "compact": (rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:[Tt ]?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?(?:[.,]([0-9]+))?)?(?:\s*([AaPp])[Mm])?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
}
#: A cheap test that a layout's texts pass, so that one pattern is tried on a text: the character at a place, or a class at the start.
_GUARD = {"iso": (5, "-"), "point_ymd": (5, "."), "slash_ymd": (5, "/"), "point_dmy": (".", 3), "slash_mdy": ("/", 3)}


def _may_be(clean: Column, layout: str) -> Column:
    g = _GUARD.get(layout)
    if g is None:
        return F.substring(clean, 5, 1).between("0", "9") if layout == "compact" else F.substring(clean, 1, 8).rlike("[A-Za-z]{3}")
    return F.substring(clean, *([g[0], 1] if isinstance(g[0], int) else [1, g[1]])).contains(g[1] if isinstance(g[0], int) else g[0])


#: Units of a bare number: digits before the point that are whole seconds are what is left of these.
UNITS = {"number_s": 0, "number_ms": 3, "number_us": 6, "number_ns": 9}
#: Layouts whose texts another one may admit: with month and day exchanged.
EXCHANGED = {"slash_mdy": "slash_dmy"}
#: Texts that the conventions of the data count for, beside a source's own (slashes: the month first); others have 1.
PRIOR = {"slash_mdy": 200.0}
FROM_S, TO_S = 946_684_800, 2_208_988_800
CERTAIN = 0.9
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$"
_ROUNDS = 30


def _local_us(year: Column, month: Column, day: Column, rest: list[Column]) -> Column:
    """Microseconds of the wall-clock fields as if in UTC; null for impossible dates and times."""
    hour, minute, second, fraction, half = rest
    number = F.when(month.between("0", "99"), month).otherwise(_month_number(F.lower(F.substring(month, 1, 3)), month))
    h = F.coalesce(hour.try_cast("int"), F.lit(0))
    h = F.when(half == "", h).when((h < 1) | (h > 12), F.lit(99)).otherwise(h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    two = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    text = F.concat(year, F.lit("-"), two(number), F.lit("-"), two(day), F.lit(" "), F.lpad(h.cast("string"), 2, "0"), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), F.rpad(fraction, 6, "0"), F.lit("Z"))
    return F.unix_micros(text.try_cast("timestamp"))


def _month_number(month: Column, raw: Column) -> Column:
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    return F.coalesce(*[F.when(month == m, F.lit(str(i + 1))) for i, m in enumerate(names)], raw)


def _utc_us(local: Column, zone: Column, source_zone: Column, abbrevs: Column, zones: Column) -> Column:
    """UTC microseconds: by the text's offset, zone or abbreviation, else by the source's zone.

    A wall-clock time that occurs twice means its first occurrence; a skipped one takes the offset before the change.
    """
    z = F.regexp_replace(F.trim(zone), r"^(?i)(?:utc|gmt)(?=[+-][0-9])", "")
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    off = r"^([+-])([0-9]{1,2}):?([0-9]{2})?(?:\s*[\[(].*[\])])?$"
    minutes = F.regexp_extract(z, off, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(z, off, 3).try_cast("int"), F.lit(0))
    offset = F.when(z.rlike(off) & (minutes <= 18 * 60) & (F.coalesce(F.regexp_extract(z, off, 3).try_cast("int"), F.lit(0)) < 60), sign * minutes).when(F.lower(z) == "z", 0)
    offset = F.coalesce(offset, F.element_at(abbrevs, F.upper(z)))
    named = F.element_at(zones, F.lower(F.btrim(z, F.lit("[]"))))
    shifted = lambda name: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), name))
    return F.when(z == "", shifted(source_zone)).when(offset.isNotNull(), local - offset.cast("bigint") * 60_000_000).when(named.isNotNull(), shifted(named))


def _number_us(text: Column, digits: int) -> Column:
    """Microseconds of a bare number in a unit of 10^-digits seconds, if it falls between 2000 and 2040."""
    whole, frac = F.regexp_extract(text, r"^([0-9]+)(?:\.([0-9]+))?$", 1), F.regexp_extract(text, r"^([0-9]+)(?:\.([0-9]+))?$", 2)
    more = max(6 - digits, 0)
    cut_off = F.concat(whole, F.rpad(frac, more, "0")) if more else F.substr(whole, F.lit(1), F.length(whole) - (digits - 6))
    us = cut_off.try_cast("bigint")
    return F.when((us >= FROM_S * 1_000_000) & (us < TO_S * 1_000_000), us)


def _known_zones(df: DataFrame) -> list[str]:
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def parses(rows: DataFrame, text: str, sources: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """`rows` (with a column source) plus utc_us, exchanged_us (month and day exchanged, where a layout of that kind admits it), signature and canonical.

    Zone abbreviations and IANA names are literals in the plan: both are fixed lists (13 and about 600 entries;
    more than 1,000 abbreviations raise). Sources are joined by size.
    """
    known = _known_zones(rows)
    ab = [(r.abbrev.strip().upper(), int(r.offset_minutes)) for r in abbrevs.where("abbrev is not null and offset_minutes is not null").limit(1001).collect()]
    if len(ab) > 1000:
        raise ValueError("zone abbreviations are a short fixed list; this table has more than 1,000")
    abbrev_map = F.create_map(*[F.lit(x) for kv in ab for x in kv]) if ab else F.create_map(F.lit(""), F.lit(0))
    zone_map = F.map_from_arrays(F.array(*[F.lit(x.lower()) for x in known]), F.array(*[F.lit(x) for x in known]))
    src = sources.groupBy("source").agg(F.max("zone_name").alias("_zone"))
    src = src.select("source", F.coalesce(F.when(F.trim("_zone").isin(known), F.trim("_zone")), F.when(F.col("_zone").isNull(), F.lit("UTC")), F.lit("")).alias("_home"))
    clean = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r\ufeff"))
    r = rows.join(src, "source", "left").withColumns({"_clean": clean, "_home": F.nullif(F.coalesce("_home", F.lit("UTC")), F.lit(""))})
    c = F.col("_clean")
    # the most frequent form admits one layout only; every other text is held against the one pattern that its guard admits
    plain = c.endswith("Z") & (F.substring(c, 11, 1) == "T") & c.rlike(CANONICAL)
    # a number between 2000 and 2040 has nine digits or more before the point
    digit = lambda i: F.substring(c, i, 1).between("0", "9")
    number = digit(3) & digit(5) & (F.length(c) <= 38) & c.rlike(r"^[0-9]{1,25}(\.[0-9]{1,12})?$")
    bare = {unit: _number_us(c, digits) for unit, digits in UNITS.items()}
    r = r.withColumn("_number", F.when(number, F.coalesce(*[F.when(us.isNotNull(), F.struct(F.lit(unit).alias("unit"), us.alias("us"))) for unit, us in bare.items()])))
    mark = "\x01"
    shape = F.when(c.contains(mark), F.lit(None)).when(plain, F.lit(f"{mark}plain")).when(F.col("_number").isNotNull(), F.lit(f"{mark}number"))
    tried: dict = {}
    for name, (p, order) in LAYOUTS.items():
        # layouts of one guard follow each other: once one has matched, the next finds the mark
        guard = _GUARD.get(name, "compact" if name == "compact" else "name")
        tried[guard] = (name, F.regexp_replace(tried[guard][1] if guard in tried else c, p, f"{mark}{name}|{order}"))
    for name, replaced in tried.values():
        shape = shape.when(_may_be(c, name), replaced)
    shape = F.when(shape.startswith(mark), F.split(F.substring(shape, 2, 1 << 20), r"\|", -1))
    r = r.withColumn("_f", shape)
    at = lambda i: F.get("_f", F.lit(i))
    dated, rest = F.size("_f") == 10, [at(i) for i in range(4, 9)]
    r = r.withColumns({
        "_kind": at(0),
        "_zone": at(9),
        "_local": F.when(dated, _local_us(at(1), at(2), at(3), rest)),
        "_other": F.when(at(0).isin(*EXCHANGED), _local_us(at(1), at(3), at(2), rest)),
    })
    utc = lambda local: _utc_us(F.col(local), F.col("_zone"), F.col("_home"), abbrev_map, zone_map)
    kind = F.col("_kind")
    r = r.withColumns({
        "utc_us": F.when(kind == "plain", F.unix_micros(c.try_cast("timestamp"))).when(kind == "number", F.col("_number.us")).when(F.col("_local").isNotNull(), utc("_local")),
        "exchanged_us": F.when(F.col("_other").isNotNull(), utc("_other")),
        "layout": F.when(kind == "plain", F.lit("iso")).when(kind == "number", F.col("_number.unit")).otherwise(kind),
    })
    other = F.coalesce(*[F.when(F.col("layout") == a, F.lit(b)) for a, b in EXCHANGED.items()])
    signature = F.concat_ws("|", F.when(F.col("utc_us").isNotNull(), F.col("layout")), F.when(F.col("exchanged_us").isNotNull(), other))
    return r.withColumn("signature", signature).select(*rows.columns, "utc_us", "exchanged_us", "signature", F.coalesce((kind == "plain") & (c == F.col(text)), F.lit(False)).alias("canonical"))


def _mixture(signatures: list[str], count: list[int]) -> tuple[list[str], list[float], list[bool]]:
    """EM of one source's layout mixture over its signature counts: (layout, posterior, contrary) of each signature.

    The most probable mixture under PRIOR: conventions decide where a source's texts say nothing, and lose to them where
    they say otherwise. contrary tells that a text's only layout is less probable at this source than the one it excludes.
    """
    sets = [s.split("|") for s in signatures]
    rival = EXCHANGED | {b: a for a, b in EXCHANGED.items()}
    names = sorted({y for s in sets for x in s for y in (x, rival.get(x, x))})
    prior = {x: PRIOR.get(x, 1.0) for x in names}
    share = {x: v / sum(prior.values()) for x, v in prior.items()}
    post: list[dict[str, float]] = []
    for _ in range(_ROUNDS):
        post = []
        for s in sets:
            total = sum(share[x] for x in s)
            post.append({x: share[x] / total for x in s})
        mass = dict(prior)
        for p, n in zip(post, count):
            for x, v in p.items():
                mass[x] += v * n
        total = sum(mass.values())
        new = {x: v / total for x, v in mass.items()}
        moved = max((abs(new[x] - share[x]) for x in names), default=0)
        share = new
        if moved < 1e-9:
            break
    best = [max(p, key=lambda x: (p[x], x)) for p in post]
    contrary = [len(p) == 1 and b in rival and share[rival[b]] > share[b] for p, b in zip(post, best)]
    return best, [p[b] for p, b in zip(post, best)], contrary


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (source, signature, layout, posterior, contrary) of one source's signature counts."""
    layout, posterior, contrary = _mixture(pdf["signature"].tolist(), pdf["n"].tolist())
    return pd.DataFrame({"source": pdf["source"], "signature": pdf["signature"], "layout": layout, "posterior": posterior, "contrary": contrary})


def _fit_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`_mixture` of every source, over rows sorted by source; holds one source's signatures, which are as few as the layouts' combinations."""
    names = ["source", "signature", "layout", "posterior", "contrary"]

    def rows_of(group: list[tuple]) -> list[tuple]:
        sig = [g[1] for g in group]
        return list(zip([g[0] for g in group], sig, *_mixture(sig, [g[2] for g in group])))

    group: list[tuple] = []
    for b in batches:
        out: list[tuple] = []
        for row in zip(b["source"].tolist(), b["signature"].tolist(), b["n"].tolist()):
            if group and row[0] != group[0][0]:
                out += rows_of(group)
                group = []
            group.append(row)
        if out:
            yield pd.DataFrame(out, columns=names)
    if group:
        yield pd.DataFrame(rows_of(group), columns=names)


def normalise_stamps(rows: DataFrame, key: str, text: str, sources: DataFrame, abbrevs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, record_key, source, text, utc_us, layout, posterior, status, canonical) of each row of `rows`.

    status is read, ambiguous (the posterior stays below CERTAIN), contrary (only readable by a layout that the source's
    mixture holds for the less probable one, such as a day before the month between slashes) or unreadable (null, blank,
    placeholder, impossible; utc_us null). Digits finer than microseconds are cut off. A null source or zone means UTC, an
    unknown zone name makes the source's zoneless texts unreadable.
    """
    r = rows.select(*keep, F.coalesce("source", F.lit("")).alias("source"), F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))
    p = cut(parses(r, "text", sources, abbrevs))
    counts = p.where("signature <> ''").groupBy("source", "signature").agg(F.count("*").alias("n"))
    fit = counts.repartition("source").sortWithinPartitions("source").mapInPandas(_fit_sources, "source string, signature string, layout string, posterior double, contrary boolean")
    out = p.join(fit, ["source", "signature"], "left")
    chosen = F.when(F.col("layout").isin(*EXCHANGED.values()), F.col("exchanged_us")).otherwise(F.col("utc_us"))
    status = F.when(F.col("layout").isNull(), "unreadable").when(F.col("posterior") < CERTAIN, "ambiguous").when(F.col("contrary"), "contrary").otherwise("read")
    return out.select(*keep, "record_key", "source", "text", chosen.alias("utc_us"), "layout", "posterior", status.alias("status"), "canonical")
