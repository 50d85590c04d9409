"""DuckDB SQL of queries whose results take recursion, closed forms or self-joins to state."""

from __future__ import annotations

from tapewright.plans.base import BARS, W
from tapewright.plans.problem_sql import _EDGES, _FIELD, _NUM

_R = f"{BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM x), v AS (SELECT * FROM r WHERE ret IS NOT NULL)"
_U = f"({W} ROWS UNBOUNDED PRECEDING)"
_TR = f"CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END"

SQL: dict[str, str] = {}

SQL["p1_paths"] = f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT p AS a, c AS d FROM e UNION SELECT reach.a, e.c FROM reach JOIN e ON reach.d = e.p),
 cyc AS (SELECT x.a AS n, min(x.d) AS rep FROM reach x JOIN reach y ON y.a = x.d AND y.d = x.a GROUP BY x.a),
 ends AS (SELECT coalesce(a.rep, e.p) AS p, coalesce(b.rep, e.c) AS c FROM e LEFT JOIN cyc a ON a.n = e.p LEFT JOIN cyc b ON b.n = e.c), dag AS (SELECT DISTINCT p, c FROM ends WHERE p <> c),
 roots AS (SELECT DISTINCT n FROM (SELECT p AS n FROM ends UNION SELECT c FROM ends) WHERE n NOT IN (SELECT c FROM dag)),
 w AS (SELECT n AS root, n AS node, 0 AS depth, n AS path FROM roots UNION ALL SELECT w.root, dag.c, w.depth + 1, w.path || '>' || dag.c FROM w JOIN dag ON dag.p = w.node)
SELECT node AS artifact_hash, root AS root_hash, CAST(depth AS INTEGER) AS depth, CAST(max(depth) OVER (PARTITION BY root, node) AS INTEGER) AS max_depth, CAST(count(*) OVER (PARTITION BY root, node) AS DOUBLE) AS n_paths, path FROM w"""

_BAR_NUM = r"CASE WHEN regexp_matches(f[{i}], {num}) AND isfinite(TRY_CAST(trim(f[{i}], E' \t') AS DOUBLE)) THEN TRY_CAST(trim(f[{i}], E' \t') AS DOUBLE) END".replace("{num}", _NUM)
SQL["p5_loaded"] = rf"""WITH q AS (SELECT raw_id, file_name, line_no, line FROM raw_bars WHERE line IS NOT NULL AND line <> 'symbol,timestamp,open,high,low,close,volume,note'),
 s AS (SELECT * FROM (SELECT raw_id, file_name, line_no, regexp_extract_all(',' || line, ',' || {_FIELD}, 1, 's') AS f FROM q WHERE regexp_full_match(line, {_FIELD} || '(,' || {_FIELD} || ')*', 's')) WHERE len(f) = 8),
 v AS (SELECT raw_id, file_name, line_no, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f FROM s),
 w AS (SELECT raw_id, file_name, line_no, f[1] AS symbol, CASE WHEN f[2][1:4] <> '0000' THEN CASE WHEN regexp_matches(f[2], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(f[2], '%Y-%m-%d %H:%M:%S')
   WHEN regexp_matches(f[2], '^[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(f[2], '%Y.%m.%d %H:%M') WHEN regexp_matches(f[2], '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$') THEN try_strptime(f[2], '%Y-%m-%dT%H:%M:%SZ') END END AS ts,
   {_BAR_NUM.format(i=3)} AS open, {_BAR_NUM.format(i=4)} AS high, {_BAR_NUM.format(i=5)} AS low, {_BAR_NUM.format(i=6)} AS close, {_BAR_NUM.format(i=7)} AS volume, f[7] = '' AS no_volume, f[8] AS note FROM v)
SELECT raw_id, file_name, line_no, symbol, epoch_us(ts) AS at_us, open, high, low, close, volume, note FROM w WHERE ts IS NOT NULL AND open > 0 AND (no_volume OR volume >= 0)"""


def _barriers(atr_from: int, direction: str, entry: str, take: str, stop: str, both: str) -> str:
    """Codes of the bars ahead, the first that is not open, else the end of the holding time."""
    return f"""{BARS}, t AS (SELECT *, {_TR} AS tr FROM x), a AS (SELECT *, CASE WHEN rn >= {atr_from} THEN avg(tr) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr, {direction} AS dir, {entry} AS entry, max(rn) OVER (PARTITION BY series) - rn AS left_ FROM t),
 bb AS (SELECT *, entry + dir * {take} * atr AS tp, entry - dir * {stop} * atr AS sl FROM a),
 k AS (SELECT bb.bar_id, n.rn - bb.rn AS k, n.close, CASE WHEN bb.dir * (n.open - tp) >= 0 THEN n.open WHEN bb.dir * (n.open - sl) <= 0 THEN n.open END AS at_open, tp, sl, CASE WHEN bb.dir * (n.open - sl) <= 0 THEN 'OPEN_STOP' WHEN bb.dir * (n.open - tp) >= 0 THEN 'OPEN_TARGET'
   WHEN (CASE WHEN bb.dir > 0 THEN n.high >= tp ELSE n.low <= tp END) AND (CASE WHEN bb.dir > 0 THEN n.low <= sl ELSE n.high >= sl END) THEN '{both}' WHEN CASE WHEN bb.dir > 0 THEN n.high >= tp ELSE n.low <= tp END THEN 'TARGET' WHEN CASE WHEN bb.dir > 0 THEN n.low <= sl ELSE n.high >= sl END THEN 'STOP' END AS code
  FROM bb JOIN x n ON n.series = bb.series AND n.rn BETWEEN bb.rn + 1 AND bb.rn + 16 WHERE bb.atr IS NOT NULL),
 h AS (SELECT bar_id, min(k) FILTER (code IS NOT NULL) AS first, max(k) AS last FROM k GROUP BY bar_id),
 o AS (SELECT h.bar_id, k.k, coalesce(k.code, 'TIMEOUT') AS reason, CASE k.code WHEN 'OPEN_STOP' THEN at_open WHEN 'OPEN_TARGET' THEN at_open WHEN 'TARGET' THEN tp WHEN 'STOP' THEN sl ELSE close END AS exit FROM h JOIN k ON k.bar_id = h.bar_id AND k.k = coalesce(first, last) WHERE first IS NOT NULL OR last = 16)"""


_LABEL = "CAST(CASE WHEN reason IN ('OPEN_TARGET', 'TARGET') THEN 1 WHEN reason IN ('OPEN_STOP', 'STOP') THEN -1 WHEN reason = 'TIMEOUT' THEN 0 END AS INTEGER) AS label, coalesce(reason, 'UNAVAILABLE') AS reason, CAST(k AS INTEGER) AS bars, round(exit, 6) AS exit"
SQL["w_barriers"] = f"WITH {_barriers(15, 'CASE WHEN close >= open THEN 1 ELSE -1 END', f'lead(open) OVER ({W})', '1.5', '1.0', 'AMBIGUOUS')} SELECT bb.bar_id, CAST(bb.dir AS INTEGER) AS dir, {_LABEL} FROM bb LEFT JOIN o USING (bar_id)"
SQL["w_barrier_variants"] = f"WITH {_barriers(14, '1', 'close', '1.0', '1.0', 'STOP')} SELECT bb.bar_id, {_LABEL} FROM bb LEFT JOIN o USING (bar_id)"


def _mean_seeded(c: str, n: int, at: int = 1) -> str:
    """Exponential average whose first value is the mean of n values from row `at`."""
    e = at + n - 1
    return f"CASE WHEN rn >= {e} THEN list_reduce(list_prepend(list_avg((list({c}) OVER u)[{at}:{e}]), (list({c}) OVER u)[{e + 1}:]), lambda a, v: a + (2.0::DOUBLE/{n + 1}) * (v - a)) END"


SQL["f_macd_mean_seed"] = f"""WITH {BARS}, m AS (SELECT *, {_mean_seeded('close', 12)} - {_mean_seeded('close', 26)} AS line FROM x WINDOW u AS {_U}), z AS (SELECT *, {_mean_seeded('coalesce(line, 0)', 9, 26)} AS signal FROM m WINDOW u AS {_U})
SELECT bar_id, round(line, 6) AS line, round(signal, 6) AS signal, round(line - signal, 6) AS histogram FROM z"""

SQL["f_volatility"] = f"""WITH RECURSIVE {BARS}, d AS (SELECT series, bar_id, rn, close / lag(close) OVER ({W}) - 1 AS r FROM x),
 s AS (SELECT series, bar_id, rn, -1.5::DOUBLE / (1 - 0.85::DOUBLE) AS e, 1e-5 / greatest(1e-12, 1 - 0.1::DOUBLE - 0.85::DOUBLE - 0.04::DOUBLE / 2) AS t, NULL::DOUBLE AS l FROM d WHERE rn = 1
  UNION ALL SELECT d.series, d.bar_id, d.rn, CASE WHEN s.l IS NULL THEN s.e ELSE -1.5::DOUBLE + 0.1::DOUBLE * (abs(s.l / exp(s.e / 2)) - sqrt(2 / pi())) - 0.05::DOUBLE * (s.l / exp(s.e / 2)) + 0.85::DOUBLE * s.e END,
   CASE WHEN s.l IS NULL THEN s.t ELSE 1e-5 + (0.1::DOUBLE + CASE WHEN s.l < 0 THEN 0.04::DOUBLE ELSE 0 END) * s.l * s.l + 0.85::DOUBLE * s.t END, coalesce(d.r, s.l) FROM s JOIN d ON d.series = s.series AND d.rn = s.rn + 1)
SELECT bar_id, round(exp(e), 9) AS egarch, round(t, 9) AS tgarch FROM s"""

SQL["j_clusters"] = """WITH RECURSIVE p AS (SELECT user_id % 10 AS k, epoch_us(ts) AS t, round(value, 2)::DOUBLE AS v FROM events WHERE round(value, 2) >= 50), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, v) AS i FROM p),
 m AS (SELECT a.k, a.i, a.t, count(*) AS c, max(b.t) AS z, round(sum(b.v), 6) AS v FROM n a JOIN n b ON b.k = a.k AND b.i >= a.i AND b.t < a.t + 21600000000 GROUP BY ALL),
 s AS (SELECT k, i, t, z, c, v, (c >= 5 AND v >= 500) AS ok FROM m WHERE i = 1 UNION ALL SELECT m.k, m.i, m.t, m.z, m.c, m.v, (m.c >= 5 AND m.v >= 500) FROM s JOIN m ON m.k = s.k AND m.i = s.i + CASE WHEN s.ok THEN s.c ELSE 1 END)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INTEGER) AS cluster, t AS from_us, z AS to_us, CAST(c AS INTEGER) AS prints, v AS volume FROM s WHERE ok"""

SQL["j_ledger"] = """WITH RECURSIVE n AS (SELECT user_id AS k, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 m AS (SELECT k, t, CASE WHEN rn = 1 THEN 'NEW' WHEN rn % 5 = 0 THEN 'CANCEL' ELSE 'CORRECT' END AS action, CASE WHEN event_id % 11 = 0 THEN rn + 1 ELSE rn END AS rev, md5((event_id - (event_id % 13 = 0)::INT)::VARCHAR) AS g FROM n),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, rev, g) AS i FROM m),
 s AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS cur, false AS dead, []::VARCHAR[] AS seen, NULL::BIGINT AS clock, NULL::VARCHAR AS outcome, NULL::VARCHAR AS action FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT k, i, CASE WHEN outcome = 'APPLIED' THEN rev ELSE cur END, CASE WHEN outcome = 'APPLIED' THEN action = 'CANCEL' ELSE dead END, CASE WHEN outcome = 'APPLIED' THEN list_append(seen, g) ELSE seen END, CASE WHEN outcome = 'APPLIED' THEN t ELSE clock END, outcome, action
  FROM (SELECT o.*, s.cur, s.dead, s.seen, s.clock, CASE WHEN list_contains(s.seen, o.g) THEN 'DUPLICATE' WHEN s.clock IS NOT NULL AND o.t < s.clock THEN 'REJECT_CLOCK' WHEN o.action = 'NEW' THEN CASE WHEN s.cur > 0 THEN 'REJECT_EXISTS' WHEN o.rev <> 1 THEN 'REJECT_REVISION' ELSE 'APPLIED' END
    WHEN s.cur = 0 THEN 'REJECT_UNKNOWN' WHEN s.dead THEN 'REJECT_CANCELLED' WHEN o.rev <> s.cur + 1 THEN 'REJECT_REVISION' ELSE 'APPLIED' END AS outcome FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1))
SELECT outcome, action, count(*) AS n FROM s WHERE i > 0 GROUP BY ALL"""

SQL["m_state_edges"] = f"""WITH {_R}, n AS (SELECT series, sign(ret)::INT AS state, lead(ret) OVER (PARTITION BY series ORDER BY rn) AS nxt FROM v), g AS (SELECT series, state, count(*) AS trials, count(*) FILTER (nxt > 0) AS wins FROM n WHERE nxt IS NOT NULL GROUP BY ALL),
 w AS (SELECT *, wins / trials AS rate, 1.959963984540054::DOUBLE AS z, series || '|' || state AS state_key FROM g),
 i AS (SELECT *, (rate + z * z / (2 * trials)) / (1 + z * z / trials) AS mid, z * sqrt(rate * (1 - rate) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials) AS half FROM w),
 t AS (SELECT series, state, least(1.0, sum(exp(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) - trials * ln(2.0)))) AS p FROM (SELECT series, state, trials, unnest(range(wins, trials + 1)) AS k FROM g WHERE trials >= 30) GROUP BY ALL),
 a AS (SELECT *, row_number() OVER (ORDER BY p, series || '|' || state) AS k, count(*) OVER () AS m FROM t), adj AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS adjusted FROM a)
SELECT series, state, trials, wins, round(rate, 8) AS rate, round(greatest(0, mid - half), 8) AS low, round(least(1, mid + half), 8) AS high, state_key, round(p, 8) AS p, round(adjusted, 8) AS adjusted, coalesce(adjusted <= 0.05, false) AS edge FROM i LEFT JOIN adj USING (series, state)"""


def _two(source: str, key: str, y: str, a: str, b: str) -> str:
    """Closed form of y on a, b and a constant per key: coefficients c0 c1 c2, errors s0 s1 s2, r2, n."""
    return f"""(SELECT {key}, n, r2, my - b1 * ma - b2 * mb AS c0, b1 AS c1, b2 AS c2, sqrt(q * (1 / n + (ma * ma * vb - 2 * ma * mb * cab + mb * mb * va) / (n * d))) AS s0, sqrt(q * vb / (n * d)) AS s1, sqrt(q * va / (n * d)) AS s2
  FROM (SELECT *, greatest(n * (vy - b1 * cay - b2 * cby), 0) / (n - 3) AS q, 1 - (vy - b1 * cay - b2 * cby) / vy AS r2
   FROM (SELECT *, (cay * vb - cby * cab) / d AS b1, (cby * va - cay * cab) / d AS b2 FROM (SELECT *, va * vb - cab * cab AS d
    FROM (SELECT {key}, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({y}) AS vy, var_pop({a}) AS va, var_pop({b}) AS vb, covar_pop({a}, {b}) AS cab, covar_pop({a}, {y}) AS cay, covar_pop({b}, {y}) AS cby FROM {source} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {key})))))"""


def _terms(fit: str, key: str, names: tuple[str, str], digits: int, more: str = "") -> str:
    term = lambda i, t: f"SELECT {key}{more}, '{t}' AS term, round(c{i}, {digits}) AS coefficient, round(s{i}, {digits}) AS se, round(c{i} / s{i}, {digits}) AS t, round(r2, {digits}) AS r2, n AS rows FROM {fit}"
    return " UNION ALL ".join(term(i, t) for i, t in enumerate(("intercept", *names)))


_LAGS = f"{_R}, l AS (SELECT series, ret, volume, close, lag(ret) OVER (PARTITION BY series ORDER BY rn) AS r1, lag(ret, 2) OVER (PARTITION BY series ORDER BY rn) AS r2_, lag(volume) OVER (PARTITION BY series ORDER BY rn) AS v1, rn FROM v)"
SQL["x_autoregression"] = f"WITH {_LAGS}, fa AS {_two('l', 'series', 'ret', 'r1', 'r2_')}, fb AS {_two('l', 'series', 'ret', 'r1', 'v1')}, fc AS {_two('l', 'series', 'volume', 'r1', 'v1')} {_terms('fa', 'series', ('lag1', 'lag2'), 5, chr(44) + ' ' + repr('ar:ret') + ' AS target')} UNION ALL {_terms('fb', 'series', ('ret_lag1', 'volume_lag1'), 5, chr(44) + ' ' + repr('ret') + ' AS target')} UNION ALL {_terms('fc', 'series', ('ret_lag1', 'volume_lag1'), 5, chr(44) + ' ' + repr('volume') + ' AS target')}"
SQL["r_polynomial"] = f"WITH {_R}, q AS (SELECT series, ret, ln(1 + volume) / 10 AS a, power(ln(1 + volume) / 10, 2) AS b FROM v), f AS {_two('q', 'series', 'ret', 'a', 'b')} {_terms('f', 'series', ('v1', 'v2'), 5)}"


def _dickey(source: str, key: str, value: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY rn)"
    return f"(SELECT {key}, {value} - lag({value}) OVER {w} AS dy, lag({value}) OVER {w} AS level, lag({value}) OVER {w} - lag({value}, 2) OVER {w} AS l1 FROM {source})"


SQL["x_unit_root"] = f"""WITH {_R}, dc AS {_dickey('v', 'series', 'close')}, dr AS {_dickey('v', 'series', 'ret')}, fc AS {_two('dc', 'series', 'dy', 'level', 'l1')}, fr AS {_two('dr', 'series', 'dy', 'level', 'l1')}
SELECT series, round(c1 / s1, 4) AS statistic, CAST(1 AS INTEGER) AS lags, n AS rows, c1 / s1 < -2.86 AS stationary, 'close' AS of FROM fc UNION ALL SELECT series, round(c1 / s1, 4), 1, n, c1 / s1 < -2.86, 'ret' FROM fr"""
SQL["r_cointegration"] = f"""WITH {BARS}, f AS (SELECT series, regr_slope(close, high) AS b, regr_intercept(close, high) AS a FROM x GROUP BY series), e AS (SELECT x.series, rn, close - a - b * high AS res FROM x JOIN f USING (series)), d AS {_dickey('e', 'series', 'res')}, g AS {_two('d', 'series', 'dy', 'level', 'l1')}
SELECT series, round(b, 5) AS slope, round(c1 / s1, 4) AS statistic, c1 / s1 < -3.34 AS cointegrated FROM f JOIN g USING (series)"""
SQL["x_autocorrelations"] = f"""WITH {_R}, e AS (SELECT series, rn, ret - avg(ret) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM v), c AS (SELECT series, sum(e * e) AS c0 FROM e GROUP BY series),
 k AS (SELECT a.series, b.rn - a.rn AS lag, sum(a.e * b.e) AS s, any_value(a.n) AS n FROM e a JOIN e b ON b.series = a.series AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 GROUP BY ALL)
SELECT series, CAST(lag AS INTEGER) AS lag, round(s / c0, 6) AS acf, round(sum(n * (n + 2) * power(s / c0, 2) / (n - lag)) OVER (PARTITION BY series ORDER BY lag), 5) AS ljung_box FROM k JOIN c USING (series)"""

SQL["b_volume_profile"] = f"""WITH RECURSIVE {BARS}, q AS (SELECT series, floor(close / power(10.0::DOUBLE, floor(log10(close))) / 0.005 + 1e-9)::BIGINT AS b, sum(volume) AS v FROM x WHERE volume > 0 GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b) AS i, count(*) OVER (PARTITION BY series) AS m, sum(v) OVER (PARTITION BY series) AS total FROM q),
 s AS (SELECT series, i AS a, i AS z, v AS have, total, m, i AS poc FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY v DESC, b) AS k FROM n) WHERE k = 1
  UNION ALL SELECT series, CASE WHEN lo >= hi THEN a - 1 ELSE a END, CASE WHEN lo >= hi THEN z ELSE z + 1 END, have + greatest(lo, hi), total, m, poc FROM (SELECT s.*, coalesce(l.v, -1.0) AS lo, coalesce(h.v, -1.0) AS hi FROM s LEFT JOIN n l ON l.series = s.series AND l.i = s.a - 1 LEFT JOIN n h ON h.series = s.series AND h.i = s.z + 1 WHERE s.have < 0.7 * s.total AND (s.a > 1 OR s.z < s.m))),
 f AS (SELECT series, min(a) AS a, max(z) AS z, any_value(poc) AS p, any_value(total) AS total FROM s GROUP BY series)
SELECT f.series, round(p.b * 0.005, 4) AS poc, round(a.b * 0.005, 4) AS low, round((z.b + 1) * 0.005, 4) AS high, round(f.total, 4) AS total FROM f JOIN n p ON p.series = f.series AND p.i = f.p JOIN n a ON a.series = f.series AND a.i = f.a JOIN n z ON z.series = f.series AND z.i = f.z"""

SQL["b_footprint"] = f"""WITH RECURSIVE {BARS}, w AS (SELECT series, bar_id, rn, sum(CASE WHEN close >= open THEN volume ELSE -volume END) OVER k AS up, sum(volume) OVER k AS al, (close - lag(close, 12) OVER ({W})) / nullif(stddev_samp(close) OVER k, 0) AS prog FROM x WINDOW k AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 q AS (SELECT series, bar_id, CASE WHEN abs(up / al) >= 0.2 AND abs(prog) >= 1 THEN 'INITIATIVE' WHEN abs(up / al) >= 0.2 THEN 'ABSORPTION' WHEN abs(prog) >= 1 THEN 'VACUUM' ELSE 'BALANCE' END AS state, sign(up)::INT AS side, row_number() OVER (PARTITION BY series ORDER BY rn) AS i FROM w WHERE rn % 12 = 0 AND al > 0 AND prog IS NOT NULL),
 s AS (SELECT series, bar_id, state, i, CASE WHEN state = 'ABSORPTION' THEN 1 ELSE 0 END AS tests, CASE WHEN state = 'ABSORPTION' THEN side END AS held FROM q WHERE i = 1
  UNION ALL SELECT q.series, q.bar_id, q.state, q.i, CASE WHEN q.state = 'ABSORPTION' THEN CASE WHEN q.side = s.held THEN s.tests + 1 ELSE 1 END WHEN q.state = 'INITIATIVE' THEN 0 ELSE s.tests END, CASE WHEN q.state = 'ABSORPTION' THEN q.side WHEN q.state = 'INITIATIVE' THEN NULL ELSE s.held END FROM s JOIN q ON q.series = s.series AND q.i = s.i + 1)
SELECT series, bar_id, state, CAST(tests AS INTEGER) AS tests, tests >= 3 AS candidate FROM s"""

SQL["b_flow_imbalance"] = f"""WITH {BARS}, p AS (SELECT *, lag(low) OVER ({W}) AS pb, lag(high) OVER ({W}) AS pa, lag(volume) OVER ({W}) AS pv FROM x)
SELECT bar_id, round(CASE WHEN pb IS NULL THEN 0 ELSE CASE WHEN low > pb THEN volume WHEN low = pb THEN volume - pv ELSE -pv END - CASE WHEN high < pa THEN volume WHEN high = pa THEN volume - pv ELSE -pv END END, 4) AS ofi FROM p"""

SQL["b_student"] = f"""WITH {_R}, m AS (SELECT series, avg(ret) AS m, stddev_pop(ret) AS s FROM v GROUP BY series), g AS (SELECT unnest([3, 4, 5, 6, 8, 10, 15, 20, 30]::DOUBLE[]) AS f),
 l AS (SELECT v.series, f, s * sqrt((f - 2) / f) AS scale, sum(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) - ln(s * sqrt((f - 2) / f)) - (f + 1) / 2 * ln(1 + power((ret - m) / (s * sqrt((f - 2) / f)), 2) / f)) AS ll FROM v JOIN m USING (series) CROSS JOIN g WHERE s > 0 GROUP BY v.series, f, s)
SELECT series, f AS df, round(scale, 6) AS scale, round(ll, 5) AS log_likelihood FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ll DESC, f) AS k FROM l) WHERE k = 1"""

SQL["b_density"] = f"""WITH {_R}, m AS (SELECT series, 1.06 * stddev_pop(ret) * power(count(*)::DOUBLE, -0.2) AS h FROM v GROUP BY series), g AS (SELECT unnest([-0.002, -0.001, 0.0, 0.001, 0.002]::DOUBLE[]) AS p)
SELECT v.series, p AS x, round(avg(exp(-power((p - ret) / h, 2) / 2) / (h * sqrt(2 * pi()))), 5) AS density FROM v JOIN m USING (series) CROSS JOIN g WHERE h > 0 GROUP BY v.series, p"""

SQL["b_hidden_states"] = f"""WITH RECURSIVE {_R}, o AS (SELECT series, bar_id, CASE WHEN abs(ret) > 0.001 THEN 1 ELSE 0 END AS o, row_number() OVER (PARTITION BY series ORDER BY rn) AS i FROM v), em AS (SELECT *, CASE o WHEN 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS e0, CASE o WHEN 0 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS e1 FROM o),
 s AS (SELECT series, bar_id, i, 0.5 * e0 / (0.5 * e0 + 0.5 * e1) AS p0, 0.5 * e1 / (0.5 * e0 + 0.5 * e1) AS p1, ln(0.5 * e0 + 0.5 * e1) AS ll FROM em WHERE i = 1
  UNION ALL SELECT series, bar_id, i, q0 / (q0 + q1), q1 / (q0 + q1), ll + ln(q0 + q1) FROM (SELECT em.series, em.bar_id, em.i, s.ll, (s.p0 * 0.95::DOUBLE + s.p1 * 0.1::DOUBLE) * em.e0 AS q0, (s.p0 * 0.05::DOUBLE + s.p1 * 0.9::DOUBLE) * em.e1 AS q1 FROM s JOIN em ON em.series = s.series AND em.i = s.i + 1))
SELECT bar_id, CAST(CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS INTEGER) AS state, round(greatest(p0, p1), 8) AS probability, round(ll, 8) AS log_likelihood FROM s"""

SQL["r_batches_tolerant"] = """WITH RECURSIVE o AS (SELECT epoch_us(o_orderdate) AS day_us, o_totalprice AS a, o_custkey AS c, dense_rank() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice) AS i FROM orders),
 d AS (SELECT DISTINCT day_us, a, i FROM o), m AS (SELECT x.day_us, x.a, x.i, max(y.i) AS z, max(y.a) AS high FROM d x JOIN d y ON y.day_us = x.day_us AND y.i >= x.i AND y.a <= x.a + 5000.0::DOUBLE GROUP BY ALL),
 s AS (SELECT * FROM m WHERE i = 1 UNION ALL SELECT m.* FROM s JOIN m ON m.day_us = s.day_us AND m.i = s.z + 1)
SELECT s.day_us, s.a AS low, s.high, CAST(count(DISTINCT c) AS INTEGER) AS people, count(*) AS rows FROM s JOIN o ON o.day_us = s.day_us AND o.i BETWEEN s.i AND s.z GROUP BY ALL HAVING count(DISTINCT c) >= 3"""

_SEGMENTS = f"""{_R}, n AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY rn) AS k FROM v), m AS (SELECT series, k, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM n WINDOW w AS (PARTITION BY series ORDER BY k ROWS 19 PRECEDING)),
 l AS (SELECT *, avg(s) OVER (PARTITION BY series) AS level FROM m WHERE k > 20), t AS (SELECT series, k, CASE WHEN s > level THEN 'storm' ELSE 'calm' END || '_' || CASE WHEN m >= 0 THEN 'up' ELSE 'down' END AS state FROM l),
 i AS (SELECT *, k - row_number() OVER (PARTITION BY series, state ORDER BY k) AS g FROM t), seg AS (SELECT series, state, min(k) AS start, max(k) AS "end", count(*) AS rows FROM i GROUP BY series, state, g)"""
SQL["r_segments"] = f"WITH {_SEGMENTS} SELECT * FROM seg"
SQL["r_segment_transitions"] = f"""WITH {_SEGMENTS}, a AS (SELECT series, state, lead(state) OVER (PARTITION BY series ORDER BY start) AS after FROM seg), c AS (SELECT series, state, after, count(*) AS n FROM a WHERE after IS NOT NULL GROUP BY ALL)
SELECT series, state, after, n, round(n / sum(n) OVER (PARTITION BY series, state), 8) AS p FROM c"""
SQL["r_reaction"] = f"""WITH {_R}, z AS (SELECT series, rn, (ret - avg(ret) OVER (PARTITION BY series)) / nullif(stddev_samp(ret) OVER (PARTITION BY series), 0) AS e, (volume - avg(volume) OVER (PARTITION BY series)) / nullif(stddev_samp(volume) OVER (PARTITION BY series), 0) AS q FROM v), k AS (SELECT unnest(range(21)) AS lag)
SELECT a.series, CAST(k.lag AS INTEGER) AS lag, round(avg(abs(b.q)), 6) AS mean_abs_z FROM z a CROSS JOIN k LEFT JOIN z b ON b.series = a.series AND b.rn = a.rn + k.lag WHERE abs(a.e) > 2 GROUP BY ALL"""
SQL["r_correlation_breaks"] = f"""WITH {_R}, n AS (SELECT series, ret AS x, volume AS y, row_number() OVER (PARTITION BY series ORDER BY rn) AS k, count(*) OVER (PARTITION BY series) AS t FROM v),
 c AS (SELECT series, k, t, corr(x, y) OVER (PARTITION BY series ORDER BY k) AS before, corr(x, y) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM n),
 br AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(before - after) DESC, k) AS i FROM c WHERE k >= 10 AND t - k >= 10 AND before IS NOT NULL AND after IS NOT NULL)
SELECT series, k AS at, round(before, 6) AS before, round(after, 6) AS after FROM br WHERE i = 1 AND abs(before - after) > 0.3"""


def _residuals(name: str, source: str, key: str, keep: str, xs: list[str], y: str) -> str:
    """CTEs that take columns out of each other one by one, in order (Gram-Schmidt): the last is `name`, with y and the last x as what is left of them."""
    cols, out, at = [*xs, y], [], source
    sel = ", ".join(f"{c}::DOUBLE AS q{i}" for i, c in enumerate(cols))
    out.append(f"{name}_0 AS (SELECT {key}, {keep}, {sel}, count(*) OVER (PARTITION BY {key}) AS n FROM {at} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})")
    for i in range(len(xs)):
        later = ", ".join(f"q{j} - q{i} * sum(q{i} * q{j}) OVER (PARTITION BY {key}) / nullif(sum(q{i} * q{i}) OVER (PARTITION BY {key}), 0) AS q{j}" for j in range(i + 1, len(cols)))
        # what was left of the last column before it was taken out of y, for its slope
        held = f", q{len(cols) - 1} AS before" if i == len(xs) - 1 else ""
        stay = f", q{i}" if i == len(xs) - 1 else ""
        step = name if i == len(xs) - 1 else f"{name}_{i + 1}"
        out.append(f"{step} AS (SELECT {key}, {keep}, n, {later}{stay}{held} FROM {name}_{i})")
    return ", ".join(out)


def _last_term(name: str, key: str, k: int) -> str:
    """Slope of the last x, its error, and the fit, from `_residuals` of k columns."""
    return f"(SELECT {key}, any_value(n) AS n, sum(q{k - 1} * before) / sum(q{k - 1} * q{k - 1}) AS b, sum(q{k - 1} * q{k - 1}) AS sxx, sum(q{k} * q{k}) AS rss FROM {name} GROUP BY {key})"


_GRANGER = f"{_R}, l AS (SELECT series, rn, ret, 1.0 AS one, lag(ret) OVER w AS y1, lag(ret, 2) OVER w AS y2, lag(volume) OVER w AS x1, lag(volume, 2) OVER w AS x2 FROM v WINDOW w AS (PARTITION BY series ORDER BY rn)), lf AS (SELECT * FROM l WHERE y2 IS NOT NULL AND x2 IS NOT NULL)"
SQL["x_granger"] = f"""WITH {_GRANGER}, {_residuals('full_', 'lf', 'series', 'rn', ['one', 'y1', 'y2', 'x1', 'x2'], 'ret')}, {_residuals('less_', 'lf', 'series', 'rn', ['one', 'y1', 'y2'], 'ret')},
 a AS {_last_term('full_', 'series', 5)}, c AS {_last_term('less_', 'series', 3)} SELECT a.series, round((c.rss - a.rss) / 2 / (a.rss / (a.n - 5)), 5) AS f, a.n AS rows FROM a JOIN c ON c.series = a.series"""

_MULTI = f"{_R}, q AS (SELECT series, rn, ret, 1.0 AS one, ln(1 + volume) AS a, (high - low) / close AS b, power((high - low) / close, 2) AS b2 FROM v)"
_MULTI_ORDERS = {"intercept": ["a", "b", "b2", "one"], "a": ["one", "b", "b2", "a"], "b": ["one", "a", "b2", "b"], "b2": ["one", "a", "b", "b2"]}
SQL["x_multiple_regression"] = f"WITH {_MULTI}, tot AS (SELECT series, var_pop(ret) * count(*) AS yy, var_pop(a) * count(*) AS va, var_pop(b) * count(*) AS vb, var_pop(b2) * count(*) AS vb2 FROM q GROUP BY series), " + ", ".join(f"{_residuals(f'm_{t}', 'q', 'series', 'rn', xs, 'ret')}, f_{t} AS {_last_term(f'm_{t}', 'series', 4)}" for t, xs in _MULTI_ORDERS.items()) + " " + " UNION ALL ".join(
    f"SELECT f.series, '{t}' AS term, round(f.b, 5) AS coefficient, round(sqrt(rss / (n - 4) / sxx), 5) AS se, round(f.b / sqrt(rss / (n - 4) / sxx), 4) AS t, round(1 - rss / yy, 5) AS r2, n AS rows, round({'NULL' if t == 'intercept' else f'v{t} / sxx'}, 3) AS vif FROM f_{t} f JOIN tot ON tot.series = f.series" for t in _MULTI_ORDERS
)

SQL["x_unit_root_trend"] = f"""WITH {_R}, d AS (SELECT series, rn, 1.0 AS one, rn::DOUBLE - avg(rn) OVER (PARTITION BY series) AS trend, close - lag(close) OVER w AS dy, lag(close) OVER w AS level, lag(close) OVER w - lag(close, 2) OVER w AS l1 FROM v WINDOW w AS (PARTITION BY series ORDER BY rn)), df AS (SELECT * FROM d WHERE l1 IS NOT NULL),
 {_residuals('z', 'df', 'series', 'rn', ['one', 'trend', 'l1', 'level'], 'dy')}, f AS {_last_term('z', 'series', 4)} SELECT series, round(b / sqrt(rss / (n - 4) / sxx), 4) AS statistic, CAST(1 AS INTEGER) AS lags, n AS rows, b / sqrt(rss / (n - 4) / sxx) < -3.41 AS stationary FROM f"""


def _arma(tag: str, value: str, model: str) -> str:
    lag = lambda n: f"lag(y, {n}) OVER w AS l{n}"
    ctes = f"""{tag}y AS (SELECT series, rn, {value} AS y FROM v), {tag}l AS (SELECT series, rn, y, 1.0 AS one, {', '.join(map(lag, range(1, 5)))} FROM {tag}y WINDOW w AS (PARTITION BY series ORDER BY rn)), {_residuals(f'{tag}e', f'{tag}l', 'series', 'rn', ['one', 'l1', 'l2', 'l3', 'l4'], 'y')},
 {tag}j AS (SELECT a.series, a.rn, a.y, 1.0 AS one, lag(a.y) OVER w AS ar1, lag(b.q5) OVER w AS ma1 FROM {tag}y a LEFT JOIN {tag}e b ON b.series = a.series AND b.rn = a.rn WINDOW w AS (PARTITION BY a.series ORDER BY a.rn)), {tag}f AS {_two(f'{tag}j', 'series', 'y', 'ar1', 'ma1')}"""
    return ctes, _terms(f"{tag}f", "series", ("ar1", "ma1"), 4, f", '{model}' AS model")


_ARMA = [_arma("ra", "ret", "arma(1,1)"), _arma("ci", "close - lag(close) OVER (PARTITION BY series ORDER BY rn)", "arima(1,1,1)")]
SQL["r_arma"] = f"WITH {_R}, " + ", ".join(c for c, _ in _ARMA) + " " + " UNION ALL ".join(s for _, s in _ARMA)

SQL["x_all_shortest_paths"] = f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT p AS n FROM e WHERE p NOT IN (SELECT c FROM e)), r AS (SELECT n AS start, n AS node, 0 AS distance FROM s UNION SELECT r.start, e.c, r.distance + 1 FROM r JOIN e ON e.p = r.node WHERE r.distance < 400)
SELECT start, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY ALL"""
