"""SQL that says the same as the registered queries, over the raw tables."""

from __future__ import annotations

from tickloom.functions import dims
from tickloom.plans import oracle_chain as C
from tickloom.sources.fixtures import BARS_SQL, DAILY_SQL, DAMAGED_SQL, EVENTS_SQL, events_sql, trades_sql

BOARD = """CASE WHEN left(symbol, 3) IN ('688', '689') THEN 'star' WHEN left(symbol, 3) IN ('300', '301') THEN 'gem' WHEN left(symbol, 2) = '60' THEN 'sh_main'
  WHEN left(symbol, 3) IN ('000', '001', '002', '003') THEN 'sz_main' WHEN left(symbol, 1) IN ('4', '8', '9') THEN 'bse' WHEN left(symbol, 1) = '6' THEN 'sh_main' ELSE 'other' END"""
EXCHANGE = """CASE WHEN left(symbol, 2) IN ('92', '93', '83', '43') THEN 'bj' WHEN symbol IN ('000001', '000016', '000300', '000688', '000852', '000905') OR left(symbol, 1) IN ('6', '9') THEN 'sh'
  WHEN left(symbol, 1) IN ('0', '3') THEN 'sz' WHEN left(symbol, 1) IN ('4', '8') THEN 'bj' ELSE 'sz' END"""
NAMES = """names AS (SELECT ['600', '000', '300', '688', '830'][s_suppkey % 5 + 1] || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INTEGER, '0') AS symbol, arg_min(s_name, s_suppkey) AS name,
  regexp_replace(lower(arg_min(s_name, s_suppkey)), '[^a-z0-9]', '', 'g') AS abbreviation FROM supplier GROUP BY s_suppkey)"""
LISTED = "(SELECT symbol FROM names WHERE symbol LIKE '600%' OR symbol LIKE '%1')"
DAY = "symbol, tf, ts, open, high, low, close, vol"


def bars(select: str, *more: str) -> str:
    return f"WITH {', '.join([BARS_SQL.strip(), *more])} {select}"


def daily(select: str, *more: str) -> str:
    return f"WITH {', '.join([DAILY_SQL.strip(), *more])} {select}"


def damaged(select: str, *more: str) -> str:
    return f"WITH {', '.join([DAMAGED_SQL.strip(), *more])} {select}"


ISSUES = """
n AS (SELECT *, lag(ts) OVER f AS before, row_number() OVER (PARTITION BY symbol, tf, ts ORDER BY seq) AS again FROM damaged WINDOW f AS (PARTITION BY symbol, tf ORDER BY seq)),
issues AS (
  SELECT symbol, tf, seq, ts, 'error' AS severity, 'ohlc_high' AS category FROM n WHERE high < greatest(open, close, low) - 0.001
  UNION ALL SELECT symbol, tf, seq, ts, 'error', 'ohlc_low' FROM n WHERE low > least(open, close, high) + 0.001
  UNION ALL SELECT symbol, tf, seq, ts, 'error', 'negative_price' FROM n WHERE least(open, high, low, close) < 0
  UNION ALL SELECT symbol, tf, seq, ts, 'error', 'negative_volume' FROM n WHERE vol < 0
  UNION ALL SELECT symbol, tf, seq, ts, 'warning', 'all_zero' FROM n WHERE open = 0 AND high = 0 AND low = 0 AND close = 0
  UNION ALL SELECT symbol, tf, seq, ts, 'warning', 'idle_volume' FROM n WHERE vol = 0 AND abs(close - open) > 0.01 AND open > 0
  UNION ALL SELECT symbol, tf, seq, ts, 'warning', 'gap' FROM n WHERE date_diff('day', before::DATE, ts::DATE) > 5 * CASE WHEN regexp_matches(before::DATE::VARCHAR, '-01-0|-05-0|-10-0') THEN 2 ELSE 1 END
  UNION ALL SELECT symbol, tf, seq, ts, 'error', 'order' FROM n WHERE before >= ts
  UNION ALL SELECT symbol, tf, seq, ts, 'error', 'duplicate' FROM n WHERE again > 1
  UNION ALL SELECT symbol, tf, NULL, hi, CASE WHEN r < 200 THEN 'warning' ELSE 'info' END, CASE WHEN r < 200 THEN 'few_bars' ELSE 'many_bars' END FROM (
    SELECT symbol, tf, max(ts) AS hi, date_diff('day', min(ts)::DATE, max(ts)::DATE) / 365.0::DOUBLE AS years, count(*) / (date_diff('day', min(ts)::DATE, max(ts)::DATE) / 365.0::DOUBLE) AS r
    FROM damaged GROUP BY symbol, tf) WHERE years > 0.5 AND (r < 200 OR r > 270))"""
SCORES = """scores AS (SELECT symbol, tf, rows, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, round(greatest(0, 1 - 0.1::DOUBLE * coalesce(errors, 0) - 0.02::DOUBLE * coalesce(warnings, 0)), 6) AS score
  FROM (SELECT symbol, tf, count(*) AS rows FROM damaged GROUP BY ALL) LEFT JOIN
  (SELECT symbol, tf, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM issues GROUP BY ALL) USING (symbol, tf))"""
RECURSION = """
c AS MATERIALIZED (SELECT symbol, tf, idx, close, count(*) OVER (PARTITION BY symbol, tf) AS n FROM bars),
e AS (WITH RECURSIVE r AS (
  SELECT symbol, tf, 0 AS idx, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, close AS sa, close AS sb, 0.0::DOUBLE AS dea, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS dif FROM c WHERE idx = 0
  UNION ALL
  SELECT symbol, tf, i, a, b, sa, sb, CASE WHEN i < 8 THEN 0 WHEN i = 8 THEN (sd0 + d) / 9 ELSE dea0 + (d - dea0) * 2.0::DOUBLE / 10 END, sd0 + CASE WHEN i <= 8 THEN d ELSE 0 END, d FROM (
    SELECT *, a - b AS d FROM (
      SELECT r.symbol, r.tf, c.idx AS i, CASE WHEN c.idx < 11 THEN 0 WHEN c.idx = 11 THEN (sa + close) / 12 ELSE a + (close - a) * 2.0::DOUBLE / 13 END AS a,
        CASE WHEN c.idx < 25 THEN 0 WHEN c.idx = 25 THEN (sb + close) / 26 ELSE b + (close - b) * 2.0::DOUBLE / 27 END AS b,
        sa + CASE WHEN c.idx <= 11 THEN close ELSE 0 END AS sa, sb + CASE WHEN c.idx <= 25 THEN close ELSE 0 END AS sb, r.dea AS dea0, r.sd AS sd0
      FROM r JOIN c ON r.symbol = c.symbol AND r.tf = c.tf AND c.idx = r.idx + 1)))
  SELECT * FROM r)"""
MERGED = """
r AS (WITH RECURSIVE x AS (
  SELECT symbol, tf, 0 AS step, 0 AS pos, NULL::DOUBLE AS before, high AS h, low AS l, 0 AS idx, 0 AS extreme, 1 AS members, vol, amount FROM bars WHERE idx = 0
  UNION ALL
  SELECT symbol, tf, step + 1, CASE WHEN inc THEN pos ELSE pos + 1 END, CASE WHEN inc THEN before ELSE h END,
    CASE WHEN NOT inc THEN high WHEN up THEN greatest(h, high) ELSE least(h, high) END, CASE WHEN NOT inc THEN low WHEN up THEN greatest(l, low) ELSE least(l, low) END,
    CASE WHEN inc THEN idx ELSE step + 1 END, CASE WHEN inc AND CASE WHEN up THEN h > high ELSE l < low END THEN extreme ELSE step + 1 END, CASE WHEN inc THEN members + 1 ELSE 1 END,
    CASE WHEN inc THEN vol + bvol ELSE bvol END, CASE WHEN inc THEN amount + bamount ELSE bamount END
  FROM (SELECT x.*, b.high, b.low, b.vol AS bvol, b.amount AS bamount, x.before < x.h AS up,
      x.pos >= 1 AND x.before <> x.h AND ((x.h <= b.high AND x.l >= b.low) OR (x.h >= b.high AND x.l <= b.low)) AS inc
    FROM x JOIN bars b ON b.symbol = x.symbol AND b.tf = x.tf AND b.idx = x.step + 1))
  SELECT * FROM x),
merged AS (SELECT symbol, tf, pos, max(idx) AS idx, arg_max(extreme, step) AS extreme, arg_max(h, step) AS high, arg_max(l, step) AS low, max(members) AS members, arg_max(vol, step) AS vol, arg_max(amount, step) AS amount FROM r GROUP BY symbol, tf, pos),
merged_ts AS (SELECT m.symbol, m.tf, pos, m.idx, b.ts, m.high, m.low, members, m.vol, round(m.amount, 6) AS amount FROM merged m JOIN bars b ON m.symbol = b.symbol AND m.tf = b.tf AND m.extreme = b.idx)"""
FRACTALS = """
f0 AS (SELECT *, CASE WHEN high > lag(high) OVER w AND high > lead(high) OVER w AND low > lag(low) OVER w AND low > lead(low) OVER w THEN 'top'
    WHEN high < lag(high) OVER w AND high < lead(high) OVER w AND low < lag(low) OVER w AND low < lead(low) OVER w THEN 'bottom' END AS fx_type FROM merged_ts WINDOW w AS (PARTITION BY symbol, tf ORDER BY pos)),
f1 AS (SELECT *, CASE WHEN fx_type = 'top' THEN high ELSE low END AS price, row_number() OVER (PARTITION BY symbol, tf ORDER BY pos) - row_number() OVER (PARTITION BY symbol, tf, fx_type ORDER BY pos) AS island FROM f0 WHERE fx_type IS NOT NULL)"""
WYCKOFF = """
w0 AS (SELECT *, avg(vol) OVER s AS mv, avg(high - low) OVER s AS ms, count(*) OVER s AS n, lag(close, CASE WHEN idx < 10 THEN idx ELSE 10 END) OVER w AS far, lag(abs(close - open)) OVER w AS body0,
    max(high) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS top5, max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS top10, min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS low10
  FROM bars WINDOW s AS (PARTITION BY symbol, tf), w AS (PARTITION BY symbol, tf ORDER BY idx)),
w1 AS (SELECT *, close < far AND vol > 1.5 * mv AND (abs(close - open) < body0 OR close >= open) AS ps,
    close < far AND high - low > 2 * ms AND vol > 2 * mv AND close > low + 0.2::DOUBLE * (high - low) AS sc, close > far AND vol > 1.5 * mv AND (abs(close - open) < body0 OR close <= open) AS psy,
    close > far AND high - low > 2 * ms AND vol > 2 * mv AND high - greatest(open, close) > 0.3::DOUBLE * (high - low) AS bc,
    close < open AND vol > 1.5 * mv AND close < low10 AS sow, close > open AND vol > 1.3::DOUBLE * mv AND close > top10 AS joc FROM w0 WHERE n >= 10 AND idx >= 5 AND idx < n - 3),
near AS (SELECT i.symbol, i.tf, i.idx, arg_max(s, s.idx) FILTER (WHERE s.sc AND i.idx - s.idx <= 10) AS sc10, arg_max(s, s.idx) FILTER (WHERE s.sc AND i.idx - s.idx <= 20) AS sc20, arg_max(s, s.idx) FILTER (WHERE s.sc) AS sc30,
    arg_max(s, s.idx) FILTER (WHERE s.bc) AS bc30, arg_max(s, s.idx) FILTER (WHERE s.sow AND i.idx - s.idx <= 15) AS sow15
  FROM w1 i JOIN w1 s ON i.symbol = s.symbol AND i.tf = s.tf AND s.idx BETWEEN i.idx - 30 AND i.idx - 1 AND (s.sc OR s.bc OR s.sow) GROUP BY ALL),
w2 AS (SELECT w1.*, close > open AND sc10 IS NOT NULL AND vol > 0.8::DOUBLE * mv AND high > top5 AS ar,
    abs(low - sc20.low) / sc20.low < 0.03 AND vol < 0.8::DOUBLE * sc20.vol AND high - low < 0.7::DOUBLE * (sc20.high - sc20.low) AS st, low < sc30.low AND close > 0.99::DOUBLE * sc30.low AS spring,
    high > bc30.high AND close < bc30.high AS utad, close > open AND sow15 IS NOT NULL AND (sow15.vol <= 0 OR vol < 0.7::DOUBLE * sow15.vol) AS lpsy FROM w1 LEFT JOIN near USING (symbol, tf, idx)),
w3 AS (SELECT i.*, i.close > i.open AND i.vol > 1.2::DOUBLE * i.mv AND i.high > (SELECT arg_max(s.high, s.idx) FROM w2 s WHERE s.ar AND s.symbol = i.symbol AND s.tf = i.tf AND s.idx BETWEEN i.idx - 30 AND i.idx - 1) AS sos FROM w2 i),
w4 AS (SELECT i.*, s.high AS sos_high, s.vol AS sos_vol FROM w3 i LEFT JOIN (SELECT i.symbol, i.tf, i.idx, arg_max(s.high, s.idx) AS high, arg_max(s.vol, s.idx) AS vol FROM w3 i JOIN w3 s
    ON s.sos AND s.symbol = i.symbol AND s.tf = i.tf AND s.idx BETWEEN i.idx - 15 AND i.idx - 1 GROUP BY ALL) s USING (symbol, tf, idx)),
events_found AS (
  SELECT symbol, tf, idx, ts, unnest([{'seq': 0, 'e': 'PS', 'f': ps, 'p': low}, {'seq': 1, 'e': 'SC', 'f': sc, 'p': low}, {'seq': 2, 'e': 'AR', 'f': ar, 'p': high}, {'seq': 3, 'e': 'ST', 'f': st, 'p': low},
    {'seq': 4, 'e': 'Spring', 'f': spring, 'p': low}, {'seq': 5, 'e': 'SOS', 'f': sos, 'p': high}, {'seq': 6, 'e': 'LPS', 'f': abs(low - sos_high) / sos_high < 0.03 AND vol < 0.7::DOUBLE * sos_vol, 'p': low},
    {'seq': 7, 'e': 'PSY', 'f': psy, 'p': high}, {'seq': 8, 'e': 'BC', 'f': bc, 'p': high}, {'seq': 9, 'e': 'UTAD', 'f': utad, 'p': high}, {'seq': 10, 'e': 'SOW', 'f': sow, 'p': low},
    {'seq': 11, 'e': 'LPSY', 'f': lpsy, 'p': high}, {'seq': 12, 'e': 'JOC', 'f': joc, 'p': high}]) AS x FROM w4),
found AS (SELECT symbol, tf, idx, ts, x.seq AS seq, x.e AS event_type, x.p AS price FROM events_found WHERE x.f)"""
MERGE = """
o AS (SELECT *, 0 AS batch FROM daily WHERE ts < TIMESTAMP '1996-01-01'), nw AS (SELECT * REPLACE (close + 1 AS close), 1 AS batch FROM daily WHERE ts >= TIMESTAMP '1995-01-01')"""


def merge_sql(order: str) -> str:
    return daily(f"SELECT {DAY} FROM (SELECT * FROM o UNION ALL SELECT * FROM nw) QUALIFY row_number() OVER (PARTITION BY symbol, tf, ts ORDER BY batch {order}) = 1", MERGE)


def swing_sql(high: str, low: str) -> str:
    return bars(f"""SELECT symbol, tf, idx, ts, 'high' AS kind, high AS price FROM s WHERE {high} UNION ALL SELECT symbol, tf, idx, ts, 'low', low FROM s WHERE {low}""",
        """s AS (SELECT * FROM (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom, count(*) OVER (PARTITION BY symbol, tf) AS n FROM bars
        WINDOW w AS (PARTITION BY symbol, tf ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE idx >= 5 AND idx < n - 5)""")  # fmt: skip


TREND_LINES = """
  SELECT symbol, tf, CASE kind WHEN 'high' THEN 'resistance' ELSE 'support' END AS line_type, min(idx) AS start_idx, max(idx) AS end_idx, arg_min(price, idx) AS start_price, arg_max(price, idx) AS end_price,
    round((arg_max(price, idx) - arg_min(price, idx)) / (max(idx) - min(idx)), 6) AS slope
  FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol, tf, kind ORDER BY idx DESC) <= 2) GROUP BY symbol, tf, kind HAVING count(*) = 2"""


def calendar_sql(unit: str, tf: str) -> str:
    return daily(f"SELECT symbol, '{tf}' AS tf, date_trunc('{unit}', ts)::TIMESTAMP AS period, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(vol) AS vol FROM daily GROUP BY symbol, date_trunc('{unit}', ts)")


PAYLOAD = daily(f"SELECT {DAY} FROM daily")
ORACLE: dict[str, str] = {
    "bars_walk": bars("SELECT * FROM bars"),
    "bars_daily": daily("SELECT * FROM daily"),
    "bars_half_hour": f"WITH {EVENTS_SQL.strip()} SELECT * FROM events_bars",
    "bars_resolved": daily("SELECT symbol, tf, ts::DATE::TIMESTAMP AS ts, false AS has_time, open, high, low, close, CASE WHEN idx % 7 = 0 THEN 0 ELSE vol END AS vol, 0.0::DOUBLE AS amount FROM daily"),
    "bars_between": daily("SELECT * FROM daily WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-07-01'"),
    "bars_tail": bars("SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY idx DESC) <= 50"),
    "payload_objects": PAYLOAD, "payload_keyed_rows": PAYLOAD, "payload_lines": PAYLOAD, "payload_table": PAYLOAD,
    "best_source": daily(f"SELECT {DAY}, CASE WHEN substr(symbol, 6, 1)::INT % 4 = 3 THEN 'tushare' WHEN substr(symbol, 6, 1)::INT % 4 >= 2 THEN 'sina' WHEN substr(symbol, 6, 1)::INT % 4 >= 1 THEN 'tencent' ELSE 'eastmoney' END AS source FROM daily"),
    "merge_newest": merge_sql("DESC"), "merge_oldest": merge_sql("ASC"),
    "patch_today": PAYLOAD,
    "since": daily("SELECT * FROM daily WHERE ts >= TIMESTAMP '1997-01-01'"),
    "next_starts": daily("SELECT symbol, tf, (max(ts)::DATE - 1)::VARCHAR AS start_date FROM daily GROUP BY ALL"),
    "sync_status": daily("""SELECT w.symbol, w.tf, CASE WHEN n.new_ts IS NULL THEN 'fail' WHEN old_ts >= new_ts THEN 'skip' ELSE 'ok' END AS status, coalesce(rows, 0) AS rows, old_ts, new_ts
      FROM (SELECT DISTINCT symbol, unnest(['d', 'w']) AS tf FROM o) w LEFT JOIN (SELECT symbol, tf, count(*) AS rows, max(ts) AS new_ts FROM nw WHERE substr(symbol, 6, 1) <> '3' GROUP BY ALL) n USING (symbol, tf)
      LEFT JOIN (SELECT symbol, tf, max(ts) AS old_ts FROM o GROUP BY ALL) x USING (symbol, tf)""", MERGE),
    "trim_report": daily("""SELECT tf, sum(b)::BIGINT AS rows_before, sum(a)::BIGINT AS rows_after, count(*) FILTER (WHERE a < b AND a > 0) AS trimmed, count(*) FILTER (WHERE a = 0) AS removed
      FROM (SELECT symbol, tf, count(*) AS b, count(*) FILTER (WHERE ts::DATE >= DATE '1998-12-01' - 720) AS a FROM daily GROUP BY ALL) GROUP BY tf"""),
    "trimmed": daily("SELECT * FROM daily WHERE ts::DATE >= DATE '1998-12-01' - 720"),
    "delisted": bars(f"SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN {LISTED}", NAMES),
    "without_delisted": bars(f"SELECT * FROM bars WHERE symbol IN {LISTED}", NAMES),
    "candle_features": bars("""SELECT symbol, tf, idx, close >= open AS is_up, abs(close - open) AS body, high - greatest(open, close) AS upper_shadow, least(open, close) - low AS lower_shadow,
      round(CASE WHEN open = 0 THEN 0 ELSE (close - open) / open * 100 END, 6) AS change_pct, close - p AS change, round((close - p) * 100 / p, 6) AS change_vs_previous_pct
      FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, tf ORDER BY idx) AS p FROM bars)"""),
    "symbol_classes": bars(f"""SELECT symbol, {BOARD} AS board, CASE WHEN left(symbol, 2) IN ('BK', '88') THEN 'BK' WHEN left(symbol, 1) IN ('6', '9') THEN 'SH' ELSE 'SZ' END AS market, ({EXCHANGE}) || symbol AS prefixed,
      CASE WHEN ({EXCHANGE}) = 'sh' THEN '1.' ELSE '0.' END || symbol AS numeric, symbol || '.' || upper({EXCHANGE}) AS suffixed, symbol IN ('000001', '000016', '000300', '000688', '000852', '000905') AS is_index,
      left(symbol, 2) IN ('BK', '88') AS is_concept, left(symbol, 2) = '60' AS on_sh_main, left(symbol, 2) = '00' AS on_sz_main, left(symbol, 2) = '30' AS on_gem, left(symbol, 2) = '68' AS on_star,
      left(symbol, 1) IN ('8', '4', '9') AS on_bse FROM (SELECT DISTINCT symbol FROM bars)"""),
    "symbol_search": f"""WITH {NAMES}, words AS (SELECT left(symbol, 3) AS keyword FROM names UNION SELECT right(name, 2) FROM names)
      SELECT keyword, symbol, (row_number() OVER (PARTITION BY keyword ORDER BY starts_with(symbol, keyword) DESC, starts_with(abbreviation, lower(keyword)) DESC, symbol))::INTEGER AS rank
      FROM names JOIN words ON contains(symbol, keyword) OR contains(name, keyword) OR contains(abbreviation, lower(keyword))""",
    "symbol_list": bars("SELECT DISTINCT symbol FROM bars"),
    "resample_chunks": f"""WITH {EVENTS_SQL.strip()} SELECT symbol, 'f60' AS tf, (idx // 2)::INTEGER AS idx, arg_min(ts, idx) AS ts, arg_min(open, idx) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, idx) AS close, sum(vol) AS vol, round(sum(amount), 2) AS amount FROM events_bars GROUP BY symbol, idx // 2""",
    "resample_weekly": calendar_sql("week", "w"), "resample_monthly": calendar_sql("month", "m"),
    "board_stats": bars("SELECT board, count(*) AS symbols FROM b GROUP BY board UNION ALL SELECT 'all_a', count(*) FROM b", f"b AS (SELECT DISTINCT symbol, {BOARD} AS board FROM bars)"),
    "data_status": bars("""SELECT tf, count(*) AS series, arg_min(symbol, symbol) AS sample, arg_min(rows, symbol) AS rows, arg_min(first_ts, symbol) AS first_ts, arg_min(last_ts, symbol) AS last_ts
      FROM (SELECT symbol, tf, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ALL) GROUP BY tf"""),
    "series_ranges": bars("SELECT symbol, tf, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ALL"),
    "board_coverage": bars("SELECT * FROM g UNION ALL SELECT 'all_a', sum(symbols)::BIGINT, sum(series)::BIGINT, max(latest_date), sum(at_latest)::BIGINT FROM g WHERE board <> 'other'",
      f"p AS (SELECT symbol, tf, {BOARD} AS board, max(ts)::DATE AS d FROM bars GROUP BY ALL)", "q AS (SELECT *, max(d) OVER (PARTITION BY board) AS latest FROM p)",
      "g AS (SELECT board, count(DISTINCT symbol) AS symbols, count(*) AS series, max(d)::VARCHAR AS latest_date, count(DISTINCT symbol) FILTER (WHERE d = latest) AS at_latest FROM q GROUP BY board)"),
    "fresh_series": bars("SELECT symbol, tf, max(ts) AS last_ts, max(ts)::DATE >= DATE '1998-12-01' AS fresh FROM bars GROUP BY symbol, tf"),
    "board_freshness": bars(f"""SELECT board, count(*) AS symbols, count(*) FILTER (WHERE d >= DATE '1998-12-01') AS fresh, bool_and(d >= DATE '1998-12-01') AS all_fresh, max(t) AS latest_ts
      FROM (SELECT symbol, {BOARD} AS board, max(ts) AS t, max(ts)::DATE AS d FROM bars GROUP BY symbol) GROUP BY board"""),
    "dq_issues": damaged("SELECT * FROM issues", ISSUES), "dq_series_scores": damaged("SELECT * FROM scores", ISSUES, SCORES),
    "dq_symbol_scores": damaged("SELECT symbol, round(avg(score), 6) AS score FROM scores GROUP BY symbol", ISSUES, SCORES),
    "cross_source": daily("""SELECT symbol, tf, count(ca) AS rows_a, count(cb) AS rows_b, count(*) FILTER (WHERE both_in) AS common, count(*) FILTER (WHERE bad) AS mismatches, count(*) FILTER (WHERE NOT both_in) AS one_sided,
      coalesce(array_to_string(list(ts::VARCHAR ORDER BY ts) FILTER (WHERE bad)[1:10], '/'), '') AS first_mismatches,
      round(CASE WHEN count(ca) = 0 OR count(cb) = 0 THEN 0.5 ELSE 1 - least(1, 0.5::DOUBLE * count(*) FILTER (WHERE bad) / greatest(count(ca), count(cb))) END, 6) AS score FROM j GROUP BY symbol, tf""",
      "x AS (SELECT * REPLACE (CASE WHEN idx % 50 = 0 THEN close * 1.01::DOUBLE ELSE close END AS close) FROM daily WHERE idx % 97 <> 0 AND symbol <> '600005')",
      """j AS (SELECT symbol, tf, ts, a.close AS ca, x.close AS cb, a.close IS NOT NULL AND x.close IS NOT NULL AS both_in,
        coalesce(greatest(abs(a.close - x.close), abs(a.high - x.high), abs(a.low - x.low)) > 0.005::DOUBLE * abs(a.close), false) AND a.close IS NOT NULL AND x.close IS NOT NULL AS bad FROM daily a FULL JOIN x USING (symbol, tf, ts))"""),
    "macd": bars("""SELECT symbol, tf, idx, CASE WHEN n >= 26 THEN round(dif, 6) END AS dif, CASE WHEN n >= 26 THEN round(dea, 6) END AS dea, CASE WHEN n >= 26 THEN round(2 * (dif - dea), 6) END AS macd_hist
      FROM e JOIN c USING (symbol, tf, idx)""", RECURSION),
    "volume_scores": bars("""SELECT symbol, tf, idx, round(coalesce(CASE WHEN close > open THEN vol ELSE -vol END / mv, 0), 6) AS vp_score, sum(CASE WHEN close > p THEN vol WHEN close < p THEN -vol ELSE 0 END) OVER (PARTITION BY symbol, tf ORDER BY idx) AS obv
      FROM (SELECT *, nullif(avg(vol) OVER (PARTITION BY symbol, tf), 0) AS mv, lag(close) OVER (PARTITION BY symbol, tf ORDER BY idx) AS p FROM bars)"""),
    "merged_bars": bars("SELECT * FROM merged_ts", MERGED),
    "fractals": bars("""SELECT symbol, tf, pos, idx, ts, fx_type, price FROM f1
      QUALIFY row_number() OVER (PARTITION BY symbol, tf, fx_type, island ORDER BY CASE WHEN fx_type = 'top' THEN -price ELSE price END, pos) = 1""", MERGED, FRACTALS),
    "wyckoff_events": bars("SELECT * FROM found", WYCKOFF),
    "event_feed": bars("SELECT symbol, tf, idx, event_type, price, CASE WHEN event_type IN ('PS', 'SC', 'AR', 'ST', 'Spring', 'SOS', 'LPS', 'JOC') THEN 'bullish' ELSE 'bearish' END AS bias FROM found", WYCKOFF),
    "effort_result": bars("""SELECT symbol, tf, idx, round(effort, 6) AS effort, round(result, 6) AS result, up, CASE WHEN effort > 1.3 AND result > 0.015 THEN 'harmonious' WHEN effort > 1.3 OR result > 0.015 THEN 'divergent' ELSE 'neutral' END AS harmony,
      CASE WHEN result > 0.015 THEN CASE WHEN up THEN 'demand' ELSE 'supply' END || '_dominant' WHEN effort > 1.3 THEN CASE WHEN up THEN 'supply' ELSE 'demand' END || '_appearing' ELSE 'neutral' END AS reading
      FROM (SELECT *, coalesce(vol / nullif(avg(vol) OVER s, 0), 0) AS effort, coalesce(abs(close - open) / nullif(open, 0), 0) AS result, close >= open AS up, count(*) OVER s AS n FROM bars WINDOW s AS (PARTITION BY symbol, tf)) WHERE n >= 5"""),
    "volume_trend": bars("""SELECT symbol, tf, round(CASE WHEN max(n) < 6 THEN 0 ELSE coalesce((avg(vol) FILTER (WHERE idx >= n // 2) - avg(vol) FILTER (WHERE idx < n // 2)) / nullif(avg(vol) FILTER (WHERE idx < n // 2), 0), 0) END, 6) AS volume_trend
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol, tf) AS n FROM bars) GROUP BY symbol, tf"""),
    "appearances": bars("""SELECT symbol, tf, idx, heavy AND (close >= open OR move > -0.01) AS demand, heavy AND (close <= open OR move < 0.01) AS supply FROM (SELECT *, coalesce((close - open) / nullif(open, 0), 0) AS move,
      idx >= 5 AND vol > 1.5 * avg(vol) OVER (PARTITION BY symbol, tf ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS heavy FROM bars)"""),
    "trend_lines": f"WITH p AS ({swing_sql('abs(high - top) < 0.01 AND n >= 20', 'abs(low - bottom) < 0.01 AND n >= 20')}) {TREND_LINES}",
    "swings": swing_sql("high >= top", "low <= bottom"),
    "significant_points": swing_sql("abs(high - top) < 0.01", "abs(low - bottom) < 0.01"),
}


STRUCTURE = (MERGED, FRACTALS, C.STROKES, C.SEGMENTS, C.ZONES)
POINTS = (*STRUCTURE, RECURSION, C.POWER, C.DIVERGENCES, C.POINTS)
PHASED = (WYCKOFF, C.RANGES, C.PHASES)
BAR = "symbol, tf, idx, ts, open, high, low, close, vol, amount"
#: Daily bars and, as hourly bars, the single trades of the same walk.
BOTH = BARS_SQL.strip().replace("bars AS (", "two_a_bar AS (") + f""", one_a_bar AS (
  SELECT symbol, 'f60' AS tf, n::INTEGER AS idx, ts, price - move AS open, greatest(price, price - move) AS high, least(price, price - move) AS low, price AS close, vol, amount FROM trades),
bars AS MATERIALIZED (SELECT {BAR} FROM two_a_bar UNION ALL SELECT {BAR} FROM one_a_bar)"""
#: A bar a trade of eight suppliers: series long enough for walks.
FINE = trades_sql(8).strip() + f""", bars AS MATERIALIZED (SELECT symbol, tf, n::INTEGER AS idx, ts, price - move AS open, greatest(price, price - move) AS high, least(price, price - move) AS low, price AS close, vol, round(amount, 2) AS amount FROM trades)"""
#: The half-hour bars inside each stroke of hourly bars.
SLICES = f"""spans AS MATERIALIZED (WITH {events_sql(60, "bars").strip()}, {", ".join(STRUCTURE)}
  SELECT b.symbol, b.no AS leg, s.ts AS start_ts, e.ts AS end_ts FROM bi b JOIN bars s ON s.symbol = b.symbol AND s.idx = b.start_idx JOIN bars e ON e.symbol = b.symbol AND e.idx = b.end_idx), {EVENTS_SQL.strip()},
bars AS MATERIALIZED (SELECT * FROM (SELECT symbol, tf || '/' || leg AS tf, (row_number() OVER (PARTITION BY symbol, leg ORDER BY ts) - 1)::INTEGER AS idx, ts, open, high, low, close, vol, amount
  FROM events_bars JOIN spans USING (symbol) WHERE ts >= start_ts AND ts <= end_ts) QUALIFY count(*) OVER (PARTITION BY symbol, tf) >= 5)"""
MACD_ROWS = """SELECT symbol, tf, idx, CASE WHEN n >= 26 THEN round(dif, 6) END AS dif, CASE WHEN n >= 26 THEN round(dea, 6) END AS dea, CASE WHEN n >= 26 THEN round(2 * (dif - dea), 6) END AS macd_hist
      FROM e JOIN c USING (symbol, tf, idx)"""
TIMEFRAME_ASKED = [n for found in dims.TIMEFRAME_NAMES.values() for n in found] + ["F30", "Day", "f7", ""]
TIMEFRAME_CASES = " ".join(f"WHEN lower(name) IN {found} THEN '{tf}'" for tf, found in dims.TIMEFRAME_NAMES.items())
STORAGE_CASES = " ".join(f"WHEN tf = '{tf}' THEN '{name}'" for tf, _, name, _, _ in dims.TIMEFRAMES)

ORACLE |= {
    "structures": bars("SELECT * FROM structures", *STRUCTURE),
    "walks": f"WITH {', '.join([FINE, *STRUCTURE, C.WALKS])} SELECT * REPLACE (walk::BIGINT AS walk, zones::INTEGER AS zones) FROM walks",
    "leg_power": bars("SELECT * REPLACE (round(area, 6) AS area, round(peak, 6) AS peak, round(dif_peak, 6) AS dif_peak) FROM powered", *STRUCTURE, RECURSION, C.POWER),
    "divergences": bars("SELECT * EXCLUDE (scope) FROM d_divergences", *STRUCTURE, RECURSION, C.POWER, C.DIVERGENCES),
    "walk_divergences": f"""WITH {', '.join([FINE, *STRUCTURE, RECURSION, C.POWER, C.WALKS, C.WALK_DIVERGENCES])}
      SELECT * EXCLUDE (grp) FROM w_divergences QUALIFY row_number() OVER (PARTITION BY symbol, tf, idx ORDER BY scope, zone) = 1""",
    "points": bars("SELECT * FROM points", *POINTS),
    "nested_signals": f"WITH {', '.join([BOTH, *POINTS, C.NESTED])} SELECT * FROM nested",
    "drill_down": f"WITH {', '.join([SLICES, *POINTS, C.MARKS])} SELECT * FROM marks",
    "drill_down_macd": f"WITH {', '.join([SLICES, RECURSION])} {MACD_ROWS}",
    "trading_ranges": bars("SELECT * REPLACE (no::BIGINT AS no, round(upper, 6) AS upper, round(lower, 6) AS lower, round(ice, 6) AS ice) FROM ranges", WYCKOFF, C.RANGES),
    "phases": bars("SELECT * FROM phases", *PHASED),
    "current_phase": bars(C.CURRENT, *PHASED),
    "supply_demand_lines": bars("SELECT * REPLACE (round(start_price, 6) AS start_price, round(end_price, 6) AS end_price, round(slope, 6) AS slope) FROM lines", WYCKOFF, C.RANGES, C.LINES),
    "line_breaks": bars("SELECT * FROM breaks", WYCKOFF, C.RANGES, C.LINES),
    "fusion_signals": bars("SELECT *, repeat('★', strength) AS stars FROM fused", *POINTS, *PHASED, C.FUSION),
    "structure_feed": bars("SELECT * FROM feed", *POINTS, C.FEED),
    "analysis_report": bars(C.REPORT, *POINTS),
    "analysis_listing": bars("SELECT * FROM listing", *POINTS, C.LISTING),
    "chart": bars("""SELECT b.*, round(m.dif, 6) AS dif, round(m.dea, 6) AS dea, round(m.macd_hist, 6) AS macd_hist, phase, sub_phase FROM bars b JOIN m USING (symbol, tf, idx) LEFT JOIN phases USING (symbol, tf, idx)""", *POINTS, *PHASED),
    "chart_marks": bars("SELECT * FROM marks UNION ALL SELECT symbol, tf, 'signal', level, bs_type, idx, idx, price, price, strength FROM fused", *POINTS, *PHASED, C.FUSION, C.MARKS),
    "volume_bundle": bars("""SELECT symbol, tf, part, idx, end_idx, label, round(value, 6) AS value FROM (
        SELECT symbol, tf, 'event' AS part, idx, idx AS end_idx, event_type AS label, price AS value FROM found UNION ALL SELECT symbol, tf, 'range', start_idx, end_idx, 'range', ice FROM ranges
        UNION ALL SELECT symbol, tf, 'line', start_idx, end_idx, line_type, slope FROM lines UNION ALL SELECT symbol, tf, 'phase', idx, idx, phase || ' ' || sub_phase, NULL FROM phases
        UNION ALL SELECT symbol, tf, 'effort', idx, idx, reading, effort FROM effort WHERE reading <> 'neutral') WHERE (symbol, tf) IN (SELECT symbol, tf FROM bars GROUP BY ALL HAVING count(*) >= 20)""",
      *PHASED, C.LINES, f"effort AS ({ORACLE['effort_result'].split(BARS_SQL.strip(), 1)[1].strip().replace('round(effort, 6) AS effort', 'effort')})"),
    "creeks": bars("""SELECT f.symbol, f.tf, f.idx, f.price, w.creek_width FROM found f JOIN (SELECT symbol, tf, idx, max(high) OVER v - min(low) OVER v AS creek_width FROM bars
      WINDOW v AS (PARTITION BY symbol, tf ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) w USING (symbol, tf, idx) WHERE f.event_type = 'JOC'""", WYCKOFF),
    "asked_timeframes": f"""WITH a AS (SELECT {TIMEFRAME_ASKED}[l_orderkey % {len(TIMEFRAME_ASKED)} + 1] AS name FROM lineitem), p AS (SELECT name, CASE {TIMEFRAME_CASES} END AS tf FROM a)
      SELECT name, tf, CASE {STORAGE_CASES} END AS dir_name, count(*) AS n FROM p GROUP BY ALL""",
    "index_series": bars(f"SELECT symbol, tf, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, name, abbreviation FROM bars JOIN (VALUES {', '.join(map(str, dims.INDEXES))}) x(symbol, name, abbreviation) USING (symbol) GROUP BY ALL"),
    "parsed_dates": """SELECT DISTINCT CASE l_orderkey % 4 WHEN 0 THEN strftime(l_shipdate::DATE, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate::DATE, '%Y/%m/%d') WHEN 2 THEN strftime(l_shipdate::DATE, '%Y-%m-%d') || ' 09:30:00'
      ELSE strftime(l_shipdate::DATE, '%d.%m.%Y') END AS text, CASE WHEN l_orderkey % 4 < 3 THEN l_shipdate::DATE::VARCHAR END AS day FROM lineitem""",
    "abbreviations": """WITH n AS (SELECT s_suppkey, translate(s_name, '0123456789', '零一二三四五六七八九') AS name FROM supplier)
      SELECT s_suppkey, name, regexp_replace(translate(lower(name), '一二三四五六七八九', 'yesswlqbj'), '[^a-z0-9]', '', 'g') AS initials, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS ascii_only FROM n""",
    "stored_bars": daily("SELECT symbol, tf, ts, true AS has_time, open, high, low, close, vol, 0.0::DOUBLE AS amount FROM daily"),
    "screener": bars("SELECT * FROM screened", *POINTS, *PHASED, C.FUSION),
}

LATE = """
slices AS (SELECT *, CASE WHEN ts < TIMESTAMP '1996-06-01' THEN 3 WHEN ts < TIMESTAMP '1997-06-01' THEN 1 ELSE 2 END AS k, ts::DATE AS day FROM nw),
l0 AS (SELECT symbol, tf, max(ts)::DATE AS last FROM o GROUP BY symbol, tf),
p1 AS (SELECT slices.* FROM slices LEFT JOIN l0 USING (symbol, tf) WHERE k = 1 AND coalesce(day >= last - 1, true)),
l1 AS (SELECT symbol, tf, max(last) AS last FROM (SELECT symbol, tf, last FROM l0 UNION ALL SELECT symbol, tf, day FROM p1) GROUP BY symbol, tf),
p2 AS (SELECT slices.* FROM slices LEFT JOIN l1 USING (symbol, tf) WHERE k = 2 AND coalesce(day >= last - 1, true)),
l2 AS (SELECT symbol, tf, max(last) AS last FROM (SELECT symbol, tf, last FROM l1 UNION ALL SELECT symbol, tf, day FROM p2) GROUP BY symbol, tf),
p3 AS (SELECT slices.* FROM slices LEFT JOIN l2 USING (symbol, tf) WHERE k = 3 AND coalesce(day >= last - 1, true))"""
DAMAGED_DAY = "SELECT symbol, tf, ts, " + ", ".join(f"CASE WHEN {c} = 2000 OR day(ts) = 13 THEN 0 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close", "vol"))
KEPT_SERIES = "right(symbol, 1) NOT IN ('3', '4')"
#: A point of the finer bars may be ten days away at most.
NESTED_WITHIN = C.NESTED.replace("FROM points)", "FROM points JOIN (SELECT symbol, tf, idx, ts FROM bars) USING (symbol, tf, idx))").replace(
    "AND l.tf = 'f60'", "AND l.tf = 'f60' AND abs(epoch(h.ts) - epoch(l.ts)) <= 864000"
)
ORACLE |= {
    "missing_bars": daily("SELECT symbol, tf, count(*) AS n FROM daily GROUP BY symbol, tf"),
    "payload_damaged": daily(
        " UNION ALL ".join(
            f"SELECT *, '{layout}' AS layout FROM ({DAMAGED_DAY} FROM daily WHERE {KEPT_SERIES}" + ("" if layout == "objects" else " AND day(ts) <> 13") + ")" + (" WHERE open <> 0 OR close <> 0" if layout == "table" else "")
            for layout in ("objects", "keyed_rows", "lines", "table")
        )
    ),
    "bars_between_minutes": f"WITH {events_sql(30).strip()} SELECT * FROM events_bars WHERE ts >= TIMESTAMP '2024-01-03 10:00:00' AND ts < TIMESTAMP '2024-01-07' AND (hour(ts) > 0 OR minute(ts) > 0)",
    "segment_extremes": bars("""SELECT x.symbol, x.tf, x.no, x.direction, x.end_idx, x.end_price, CASE WHEN b.direction = x.direction THEN x.end_idx ELSE b.start_idx END AS extreme_idx
      FROM structures x JOIN structures b ON x.symbol = b.symbol AND x.tf = b.tf AND x.end_idx = b.end_idx AND x.kind = 'leg' AND b.kind = 'leg' AND x.level = 'xd' AND b.level = 'bi'""", *STRUCTURE),
    "nested_within": f"WITH {', '.join([BOTH, *POINTS, NESTED_WITHIN])} SELECT * FROM nested",
}
ORACLE["macd_by_blocks"] = f"WITH {', '.join([FINE, RECURSION.strip()])} " + ORACLE["macd"][ORACLE["macd"].rindex("SELECT symbol, tf, idx, CASE WHEN n >= 26") :]
#: A stream gives what the batch gives.
ORACLE |= {
    "stream_live_bars": f"WITH {events_sql(30).strip()} SELECT symbol, tf, ts, open, high, low, close, vol FROM events_bars",
    "stream_upsert": ORACLE["merge_newest"],
    "stream_late_rows": daily(f"SELECT {DAY} FROM p1 UNION ALL SELECT {DAY} FROM p2 UNION ALL SELECT {DAY} FROM p3", MERGE, LATE),
    "stream_merged_bars": ORACLE["merged_bars"],
    "stream_indicators": f"SELECT m.*, v.obv FROM ({ORACLE['macd']}) m JOIN ({ORACLE['volume_scores']}) v USING (symbol, tf, idx)",
    "stream_alerts": ORACLE["fusion_signals"],
}
