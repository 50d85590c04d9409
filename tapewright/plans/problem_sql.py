"""DuckDB SQL that states the general problems' results independently of their operators."""

_HASH = r"regexp_replace(lower(regexp_replace({c}, '\s+', '', 'g')), '^sha256:', '')"
_EDGES = f"""e AS (SELECT DISTINCT {_HASH.format(c='parent_hash')} AS p, {_HASH.format(c='child_hash')} AS c FROM lineage
  WHERE lower(trim(relation, E' \\t\\n\\r')) IN ('feeds', 'derives', 'produces') AND parent_hash IS NOT NULL AND child_hash IS NOT NULL)"""
_SYMBOL = "upper(trim(symbol, E' \\t\\n\\r'))"

_DAILY = f"""r AS (SELECT {_SYMBOL} AS symbol, timestamp AS ts, CAST(timestamp AT TIME ZONE 'UTC' AS DATE) AS day, received_at, daily_id,
    CASE WHEN isfinite(volume) THEN CAST(volume AS DECIMAL(28,8)) END AS volume, CASE WHEN isfinite(close) THEN CAST(close AS DECIMAL(28,8)) END AS close,
    coalesce(volume > 0 AND NOT isnan(volume), false) AS active FROM daily_bars WHERE symbol IS NOT NULL AND timestamp IS NOT NULL),
  rec AS (SELECT symbol, day, ts, arg_max(volume, (received_at, daily_id)) FILTER (volume IS NOT NULL) AS volume,
    arg_max(close, (received_at, daily_id)) FILTER (close IS NOT NULL) AS close, bool_or(active) AS active FROM r GROUP BY ALL),
  dd AS (SELECT symbol, day, coalesce(sum(volume), 0) AS volume, arg_max(close, ts) FILTER (close IS NOT NULL) AS close, bool_or(active) AS active FROM rec GROUP BY ALL),
  spine AS (SELECT symbol, CAST(unnest(generate_series(min(day) FILTER (active), max(day) FILTER (active), INTERVAL 1 DAY)) AS DATE) AS day FROM dd GROUP BY symbol),
  pp AS (SELECT unnest([7, 30]) AS n),
  t AS (SELECT s.symbol, s.day, pp.n, coalesce(sum(dd.volume), 0) AS v, coalesce(sum(dd.close), 0) AS c, count(dd.close) AS nc, coalesce(sum(CAST(dd.active AS INT)), 0) AS na
    FROM spine s CROSS JOIN pp LEFT JOIN dd ON dd.symbol = s.symbol AND dd.day BETWEEN s.day - (pp.n - 1) AND s.day GROUP BY ALL)"""

_IN_TIME = _DAILY.split("\n  spine")[0].replace("r AS (", "ri AS (", 1).replace("FROM r GROUP", "FROM ri GROUP").replace("rec AS", "reci AS").replace("FROM rec ", "FROM reci ").replace("dd AS", "ddi AS").replace("WHERE symbol IS NOT NULL", "WHERE NOT coalesce(received_at > timestamp + INTERVAL 1 DAY, false) AND symbol IS NOT NULL")

_FIELD = r"""'("(?:[^"]|"")*"|[^",]*)'"""
_NUM = r"""'^[ \t]*[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?[ \t]*$'"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p AS a, c AS d FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.d = e.p)
SELECT x.a AS artifact_hash, min(x.d) AS cycle_hash FROM r x JOIN r y ON y.a = x.d AND y.d = x.a GROUP BY x.a""",
    "p1_descendants": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p AS a, c AS d, 1 AS n FROM e UNION SELECT r.a, e.c, r.n + 1 FROM r JOIN e ON r.d = e.p WHERE r.n < 200)
SELECT a AS artifact_hash, d AS descendant_hash, CAST(min(n) AS INTEGER) AS distance FROM r GROUP BY ALL""",
    "p2_found": f"WITH {_DAILY} SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CAST(n AS INTEGER) AS period_days FROM t WHERE na = 0",
    "p2_totals": f"""WITH {_DAILY} SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CAST(n AS INTEGER) AS period_days, round(CAST(v AS DOUBLE), 6) AS total_volume,
  round(CAST(v AS DOUBLE) / n, 6) AS avg_volume, round(CAST(c AS DOUBLE), 6) AS total_close, CASE WHEN nc > 0 THEN round(CAST(c AS DOUBLE) / nc, 6) END AS avg_close, na = 0 AS idle FROM t""",
    "p2_versions": f"""WITH {_DAILY}, {_IN_TIME.rstrip(',')},
  ends AS (SELECT symbol, min(day) AS a, max(day) AS b, min(day) FILTER (active) AS fa, max(day) FILTER (active) AS fb FROM ddi GROUP BY symbol),
  changed AS (SELECT symbol, n.day FROM dd n LEFT JOIN ddi o USING (symbol, day) WHERE n.volume IS DISTINCT FROM coalesce(o.volume, 0) OR n.close IS DISTINCT FROM o.close OR n.active IS DISTINCT FROM coalesce(o.active, false)),
  hit AS (SELECT DISTINCT symbol, CAST(day + k AS DATE) AS day FROM changed, (SELECT CAST(unnest(range(30)) AS INTEGER) AS k))
SELECT t.symbol, strftime(t.day, '%Y-%m-%d') AS day, CAST(CASE WHEN e.a IS NULL OR t.day < e.a OR t.day > e.b THEN 1 WHEN h.day IS NOT NULL OR NOT coalesce(t.day BETWEEN e.fa AND e.fb, false) THEN 2 ELSE 1 END AS INTEGER) AS version, round(CAST(t.v AS DOUBLE), 6) AS volume_30
FROM t LEFT JOIN ends e USING (symbol) LEFT JOIN hit h ON h.symbol = t.symbol AND h.day = t.day WHERE t.n = 30""",
    "p3_found": """WITH m AS (SELECT b.bar_id, q.dxy_id, row_number() OVER (PARTITION BY b.bar_id ORDER BY abs(epoch_us(b.timestamp) - epoch_us(q.timestamp)), q.timestamp, q.dxy_id) AS k
  FROM bars b JOIN dxy_quotes q ON q.source = b.source AND q.timestamp BETWEEN b.timestamp - INTERVAL 120 SECONDS AND b.timestamp + INTERVAL 120 SECONDS
  WHERE b.close IS NOT NULL AND q.dxy_close IS NOT NULL) SELECT bar_id, dxy_id FROM m WHERE k = 1""",
    "p4_found": f"""WITH one AS (SELECT coalesce(source, '') AS s, coalesce({_SYMBOL}, '') AS y, timestamp AS ts, min(bar_id) AS bar_id FROM bars WHERE timestamp IS NOT NULL GROUP BY ALL),
  b AS (SELECT one.*, open AS o, high AS h, low AS l, close AS c, spread, tick_volume FROM one JOIN bars USING (bar_id)),
  f AS (SELECT s, y, ts, bar_id, 'high' AS field, h AS v, CASE WHEN o IS NULL THEN h - c WHEN c IS NULL THEN h - o WHEN isnan(o) THEN h - c WHEN isnan(c) THEN h - o ELSE h - greatest(o, c) END AS m,
      NOT isfinite(h) OR h <= 0 OR coalesce(NOT isnan(o) AND h < o, false) OR coalesce(NOT isnan(c) AND h < c, false) AS bad FROM b
    UNION ALL SELECT s, y, ts, bar_id, 'low', l, CASE WHEN o IS NULL THEN c - l WHEN c IS NULL THEN o - l WHEN isnan(o) THEN c - l WHEN isnan(c) THEN o - l ELSE least(o, c) - l END,
      NOT isfinite(l) OR l <= 0 OR coalesce(NOT isnan(o) AND l > o, false) OR coalesce(NOT isnan(c) AND l > c, false) FROM b
    UNION ALL SELECT s, y, ts, bar_id, 'spread', spread, spread, NOT isfinite(spread) OR spread < 0 FROM b
    UNION ALL SELECT s, y, ts, bar_id, 'tick_volume', tick_volume, tick_volume, NOT isfinite(tick_volume) OR tick_volume < 0 FROM b),
  g AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w OR isnan(v) AS fresh FROM f WHERE v IS NOT NULL WINDOW w AS (PARTITION BY s, y, field ORDER BY ts)),
  i AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY s, y, field ORDER BY ts) AS run FROM g),
  n AS (SELECT *, count(*) OVER (PARTITION BY s, y, field, run) AS len FROM i),
  u AS (SELECT s, y, field, median(m) FILTER (isfinite(m)) AS usual FROM f WHERE v IS NOT NULL GROUP BY ALL),
  x AS (SELECT s, y, max(k) * 2 > sum(k) AS fixed FROM (SELECT s, y, v, count(*) AS k FROM f WHERE field = 'spread' AND v IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT bar_id, field FROM n LEFT JOIN u USING (s, y, field) LEFT JOIN x USING (s, y)
WHERE bad OR (len >= 8 AND NOT (field = 'spread' AND coalesce(fixed, false))) OR (isfinite(m) AND usual > 0 AND m > 22 * usual)""",
    "p5_found": rf"""WITH q AS (SELECT raw_id, coalesce(line, '') AS line FROM raw_bars WHERE line IS DISTINCT FROM 'symbol,timestamp,open,high,low,close,volume,note'),
  s AS (SELECT raw_id, line, regexp_full_match(line, {_FIELD} || '(,' || {_FIELD} || ')*', 's') AS sound, regexp_extract_all(',' || line, ',' || {_FIELD}, 1, 's') AS f FROM q),
  v AS (SELECT raw_id, sound, len(f) AS n, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f FROM s),
  w AS (SELECT raw_id, sound, n, f[2] AS ts, f[3] AS o, f[7] AS vol, CASE WHEN regexp_matches(f[3], {_NUM}) THEN TRY_CAST(trim(f[3], E' \t') AS DOUBLE) END AS no,
      CASE WHEN regexp_matches(f[7], {_NUM}) THEN TRY_CAST(trim(f[7], E' \t') AS DOUBLE) END AS nv FROM v),
  y AS (SELECT raw_id, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 8 THEN 'columns'
    WHEN coalesce(CASE WHEN regexp_matches(ts, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN regexp_matches(ts, '^[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(ts, '%Y.%m.%d %H:%M')
      WHEN regexp_matches(ts, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$') THEN try_strptime(ts, '%Y-%m-%dT%H:%M:%SZ') END, NULL) IS NULL OR ts[1:4] = '0000' THEN 'timestamp'
    WHEN coalesce(NOT isfinite(no) OR no <= 0, true) THEN 'open' WHEN vol <> '' AND coalesce(NOT isfinite(nv) OR nv < 0, true) THEN 'volume' END AS reason FROM w)
SELECT raw_id, reason FROM y WHERE reason IS NOT NULL""",
    "p6_found": f"""WITH r AS (SELECT source, {_SYMBOL} AS symbol, p.n AS n, epoch_us(timestamp) // (p.n * 1000000) AS slot FROM readings
    JOIN (VALUES ('S10', CAST(10 AS BIGINT)), ('M1', 60), ('M5', 300), ('M15', 900), ('H1', 3600)) AS p(tf, n) ON p.tf = trim(timeframe) WHERE close IS NOT NULL AND NOT isnan(close) AND timestamp IS NOT NULL),
  d AS (SELECT DISTINCT * FROM r), g AS (SELECT source, symbol, n, slot, lead(slot) OVER (PARTITION BY source, symbol, n ORDER BY slot) AS nxt FROM d)
SELECT DISTINCT source, symbol, CAST(unnest(range(slot + 1, nxt)) * n AS BIGINT) AS slot_epoch FROM g WHERE nxt > slot + 1""",
}

_SLOPE = "CASE WHEN {d0} * {d1} <= 0 THEN 0.0 ELSE ((2 * {h1} + {h0}) + ({h1} + 2 * {h0})) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) END"
_LAST = """CASE WHEN ((2 * {h} + {h2}) * {d} - {h} * {d2}) / ({h} + {h2}) * {d} <= 0 THEN 0.0
      WHEN {d} * {d2} <= 0 AND abs(((2 * {h} + {h2}) * {d} - {h} * {d2}) / ({h} + {h2})) > 3 * abs({d}) THEN 3 * {d} ELSE ((2 * {h} + {h2}) * {d} - {h} * {d2}) / ({h} + {h2}) END"""
SQL["p6_grid"] = f"""WITH r AS (SELECT source, {_SYMBOL} AS symbol, trim(timeframe) AS timeframe, p.n AS n, epoch_us(timestamp) AS t, received_at, reading_id, close FROM readings
    JOIN (VALUES ('S10', CAST(10 AS BIGINT)), ('M1', 60), ('M5', 300), ('M15', 900), ('H1', 3600)) AS p(tf, n) ON p.tf = trim(timeframe) WHERE close IS NOT NULL AND NOT isnan(close) AND timestamp IS NOT NULL),
  k AS (SELECT source, symbol, timeframe, n, t // (n * 1000000) AS slot, t / 1e6 AS t, arg_max(close, (received_at, reading_id)) AS v, count(*) AS c FROM r GROUP BY source, symbol, timeframe, n, r.t),
  w AS (SELECT *, sum(c) OVER (PARTITION BY source, symbol, timeframe, slot) AS cs, lag(slot) OVER o AS ps, lag(t) OVER o AS pt, lag(v) OVER o AS pv, lead(slot) OVER o AS qs, lead(t) OVER o AS qt, lead(v) OVER o AS qv,
    lead(slot, 2) OVER o AS rs, lead(t, 2) OVER o AS rt, lead(v, 2) OVER o AS rv FROM k WINDOW o AS (PARTITION BY source, symbol, timeframe ORDER BY t)),
  x AS (SELECT *, t - pt AS h0, qt - t AS h1, rt - qt AS h2, (v - pv) / (t - pt) AS d0, (qv - v) / (qt - t) AS d1, (rv - qv) / (rt - qt) AS d2,
    coalesce(slot - ps - 1 <= 12, false) AS fp, coalesce(qs - slot - 1 <= 12, false) AS tq, coalesce(rs - qs - 1 <= 12, false) AS tr FROM w WHERE qs IS NULL OR qs > slot),
  y AS (SELECT *, CASE WHEN fp THEN {_SLOPE.format(h0='h0', d0='d0', h1='h1', d1='d1')} WHEN tr THEN {_LAST.format(h='h1', d='d1', h2='h2', d2='d2')} ELSE d1 END AS ml,
    CASE WHEN tr THEN {_SLOPE.format(h0='h1', d0='d1', h1='h2', d1='d2')} WHEN fp THEN {_LAST.format(h='h1', d='d1', h2='h0', d2='d0')} ELSE d1 END AS mr FROM x),
  g AS (SELECT *, unnest(range(slot, coalesce(qs, slot + 1))) AS s FROM y),
  z AS (SELECT *, (s * n - t) / h1 AS u FROM g)
SELECT source, symbol, timeframe, CAST(s * n AS BIGINT) AS slot_epoch, CASE WHEN s = slot THEN 'observed' WHEN tq THEN 'filled' ELSE 'gap' END AS status, CAST(CASE WHEN s = slot THEN cs ELSE 0 END AS BIGINT) AS n_readings,
  round(CASE WHEN s = slot THEN v WHEN tq THEN (1 + 2 * u) * (1 - u) * (1 - u) * v + u * (1 - u) * (1 - u) * h1 * ml + u * u * (3 - 2 * u) * qv + u * u * (u - 1) * h1 * mr END, 6) AS close FROM z"""
SQL["p4_flags"] = (
    SQL["p4_found"]
    .replace("median(m) FILTER", "quantile_disc(m, 0.5) FILTER")
    .replace("SELECT bar_id, field FROM n", """SELECT bar_id, field, CASE WHEN bad THEN 'impossible' WHEN isfinite(m) AND usual > 0 AND m > 22 * usual THEN 'spike' ELSE 'stuck' END AS kind,
  CASE WHEN usual > 0 AND isfinite(m / usual) THEN round(m / usual, 8) END AS times FROM n""")
)

_CLOCK = r"(?:(?:T|t|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?)?\s*([A-Za-z+\[-][^|]*)?$"
_TAIL = ("h", "mi", "s", "f", "half", "z")
_MONTH_NAME = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?)"
#: Pattern and its groups, in the order in which they exclude each other.
_STAMPS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK, ("y", "mo", "d", *_TAIL)),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})" + _CLOCK, ("d", "mo", "y", *_TAIL)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK, ("mo", "d", "y", *_TAIL)),
    (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})" + _CLOCK, ("y", "mo", "d", *_TAIL)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK, ("y", "mo", "d", *_TAIL)),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[ -]+" + _MONTH_NAME + r"[ -]+(\d{4})" + _CLOCK, ("d", "mo", "y", *_TAIL)),
    (r"^(?:[A-Za-z]{3,9},?\s+)?" + _MONTH_NAME + r"\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK, ("mo", "d", "y", *_TAIL)),
    (r"^(\d{4})(\d{2})(\d{2})(?:[Tt ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?)?(?:\s*([AaPp])[Mm])?\s*([A-Za-z+\[-][^|]*)?$", ("y", "mo", "d", *_TAIL)),
]
_PARTS = " ".join(
    f"WHEN regexp_matches(x, '{p}') THEN (SELECT struct_pack({', '.join(f'{n} := g.{n}' for n in ('y', 'mo', 'd', *_TAIL))}) FROM (SELECT regexp_extract(x, '{p}', [{', '.join(repr(n) for n in names)}]) AS g))" for p, names in _STAMPS
)
_HOUR = "CASE WHEN q.half = '' THEN coalesce(TRY_CAST(q.h AS INT), 0) WHEN coalesce(TRY_CAST(q.h AS INT), 0) NOT BETWEEN 1 AND 12 THEN 99 ELSE TRY_CAST(q.h AS INT) % 12 + CASE WHEN lower(q.half) = 'p' THEN 12 ELSE 0 END END"
_OFFSET = r"^(?i:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?(?:\s*[\[(].*[\])])?$"


def _instant(zone: str) -> str:
    """A local time of a zone: the first of two occurrences; where it is skipped, by the offset before."""
    t = f"timezone({zone}, local)"
    return f"epoch_us(CASE WHEN timezone({zone}, {t} - INTERVAL 1 HOUR) = local THEN {t} - INTERVAL 1 HOUR WHEN timezone({zone}, {t} - INTERVAL 30 MINUTES) = local THEN {t} - INTERVAL 30 MINUTES ELSE {t} END)"


SQL["p7_found"] = f"""WITH names AS (SELECT lower(name) AS k, any_value(name) AS name FROM pg_timezone_names() GROUP BY 1), src AS (SELECT source, max(zone_name) AS zone FROM sources GROUP BY source), ab AS (SELECT upper(trim(abbrev)) AS k, any_value(offset_minutes) AS m FROM zone_abbrevs GROUP BY 1),
 t AS (SELECT 'feed_records' AS origin, CAST(record_id AS VARCHAR) AS record_key, source, timestamp AS text FROM feed_records UNION ALL SELECT 'datasets', id, source, start_time FROM datasets),
 c AS (SELECT t.*, CASE WHEN src.source IS NULL OR zone IS NULL THEN 'UTC' ELSE zone END AS home, trim(text, E' \\t\\n\\x0b\\f\\r' || chr(65279)) AS x FROM t LEFT JOIN src ON src.source = t.source WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?Z')),
 n AS (SELECT *, CASE WHEN regexp_full_match(x, '\\d{{1,25}}(\\.\\d{{1,12}})?') THEN (SELECT u FROM (SELECT unnest([TRY_CAST(a || rpad(b[1:6], 6, '0') AS BIGINT), TRY_CAST(a || rpad(b[1:3], 3, '0') AS BIGINT), TRY_CAST(a AS BIGINT), TRY_CAST(a[1:len(a) - 3] AS BIGINT)]) AS u FROM (SELECT regexp_extract(x, '^(\\d+)', 1) AS a, regexp_extract(x, '\\.(\\d+)$', 1) AS b)) WHERE u >= 946684800000000 AND u < 2208988800000000) END AS number FROM c),
 p AS (SELECT *, CASE WHEN number IS NULL THEN CASE {_PARTS} END END AS q FROM n),
 l AS (SELECT *, trim(q.z) AS z, TRY_CAST(q.y || '-' || lpad(CASE WHEN regexp_matches(q.mo, '^\\d') THEN q.mo ELSE CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(q.mo[1:3])) AS VARCHAR) END, 2, '0') || '-' || lpad(q.d, 2, '0') || ' ' || lpad(CAST({_HOUR} AS VARCHAR), 2, '0') || ':' || CASE WHEN q.mi = '' THEN '00' ELSE q.mi END || ':' || CASE WHEN q.s = '' THEN '00' ELSE q.s END || '.' || rpad(q.f[1:6], 6, '0') AS TIMESTAMP) AS local FROM p),
 o AS (SELECT l.*, regexp_extract(z, '{_OFFSET}', ['sign', 'hh', 'mm']) AS off, ab.m AS minutes, w.name AS named, hn.name AS own FROM l LEFT JOIN ab ON ab.k = upper(l.z) LEFT JOIN names w ON w.k = lower(trim(l.z, '[]')) LEFT JOIN names hn ON hn.name = trim(l.home)),
 u AS (SELECT origin, record_key, CASE WHEN number IS NOT NULL THEN number WHEN local IS NULL THEN NULL WHEN z = '' THEN CASE WHEN own IS NOT NULL THEN {_instant('own')} END WHEN lower(z) = 'z' THEN epoch_us(local)
   WHEN off.hh <> '' AND CAST(off.hh AS INT) * 60 + coalesce(TRY_CAST(off.mm AS INT), 0) <= 1080 AND coalesce(TRY_CAST(off.mm AS INT), 0) < 60 THEN epoch_us(local) - CASE off.sign WHEN '-' THEN -1 ELSE 1 END * (CAST(off.hh AS INT) * 60 + coalesce(TRY_CAST(off.mm AS INT), 0)) * 60000000::BIGINT
   WHEN minutes IS NOT NULL THEN epoch_us(local) - minutes * 60000000::BIGINT WHEN named IS NOT NULL THEN {_instant('named')} END AS utc_us FROM o)
SELECT origin, record_key, utc_us FROM u WHERE utc_us IS NOT NULL"""
