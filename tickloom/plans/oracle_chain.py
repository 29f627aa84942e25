"""SQL for structure, signals and what is built on them: the folds as recursive queries, one step a row.

Each text is a list of common table expressions over a table ``bars``; ``oracle`` puts them together.
"""

from __future__ import annotations


def pairing(name: str, marks: str) -> str:
    """One pass over alternating marks: ``s`` is the start after step k, ``a`` the start of a pair that ends at k, ``seg`` counts pairs."""
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE r AS (
  SELECT symbol, tf, k, 0 AS seg, k AS s, pos AS spos, kind AS skind, price AS sprice, NULL::BIGINT AS a FROM {marks} WHERE k = 0
  UNION ALL
  SELECT symbol, tf, mk, CASE WHEN pairs THEN seg + 1 ELSE seg END, CASE WHEN pairs OR moves THEN mk ELSE s END, CASE WHEN pairs OR moves THEN mpos ELSE spos END,
    CASE WHEN pairs THEN mkind ELSE skind END, CASE WHEN pairs OR moves THEN mprice ELSE sprice END, CASE WHEN pairs THEN s END
  FROM (SELECT r.*, m.k AS mk, m.pos AS mpos, m.kind AS mkind, m.price AS mprice, m.kind = skind AND (m.price - sprice) * m.kind > 0 AS moves,
      m.kind <> skind AND m.pos - spos >= 4 AND (m.price - sprice) * m.kind > 0 AS pairs FROM r JOIN {marks} m ON m.symbol = r.symbol AND m.tf = r.tf AND m.k = r.k + 1))
  SELECT * FROM r)"""


STROKES = f"""
mk AS MATERIALIZED (SELECT symbol, tf, row_number() OVER (PARTITION BY symbol, tf ORDER BY pos) - 1 AS k, pos, idx, CASE fx_type WHEN 'top' THEN 1 ELSE -1 END AS kind, price FROM (
  SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY symbol, tf, fx_type, island ORDER BY CASE WHEN fx_type = 'top' THEN -price ELSE price END, pos) = 1)),
{pairing("pass1", "mk")},
dead AS (SELECT p.symbol, p.tf, unnest([p.a, p.k]) AS k FROM pass1 p JOIN mk a ON a.symbol = p.symbol AND a.tf = p.tf AND a.k = p.a JOIN mk b ON b.symbol = p.symbol AND b.tf = p.tf AND b.k = p.k
  WHERE EXISTS (SELECT 1 FROM merged m WHERE m.symbol = p.symbol AND m.tf = p.tf AND m.pos > a.pos AND m.pos < b.pos AND CASE WHEN a.kind = 1 THEN m.high > a.price ELSE m.low < a.price END)),
mk2 AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY symbol, tf ORDER BY pos) - 1 AS k) FROM mk WHERE (symbol, tf, k) NOT IN (SELECT symbol, tf, k FROM dead)),
{pairing("pass2", "mk2")},
anchors AS (SELECT symbol, tf, seg, arg_max(s, k) AS s FROM pass2 GROUP BY ALL),
bi AS MATERIALIZED (SELECT symbol, tf, x.seg::INTEGER AS no, -a.kind AS way, a.idx AS start_idx, b.idx AS end_idx, a.price AS start_price, b.price AS end_price, greatest(a.price, b.price) AS hi, least(a.price, b.price) AS lo
  FROM anchors x JOIN anchors y USING (symbol, tf) JOIN mk2 a USING (symbol, tf) JOIN mk2 b USING (symbol, tf) WHERE y.seg = x.seg + 1 AND a.k = x.s AND b.k = y.s)"""

FRESH = "{'up': way > 0, 'first': no, 'last': no, 'n': 1, 'h': hi, 'l': lo, 'flo': lo, 'fhi': hi, 'fh': []::DOUBLE[], 'fl': []::DOUBLE[]}"
SEGMENTS = f"""
sg AS MATERIALIZED (WITH RECURSIVE r AS (
  SELECT symbol, tf, no AS k, {FRESH} AS now, CASE WHEN false THEN {FRESH} END AS pend, CASE WHEN false THEN {FRESH} END AS out FROM bi WHERE no = 0
  UNION ALL
  SELECT symbol, tf, no, CASE WHEN pend IS NOT NULL THEN CASE WHEN turns THEN t2 ELSE now END WHEN NOT turns OR gap THEN t2 ELSE fresh END,
    CASE WHEN pend IS NOT NULL THEN CASE WHEN NOT turns AND NOT CASE WHEN now.up THEN hi > now.h ELSE lo < now.l END THEN t2 END WHEN turns AND gap THEN fresh END,
    CASE WHEN pend IS NOT NULL AND turns THEN now WHEN pend IS NULL AND turns AND NOT gap AND t2.n >= 3 THEN t2 END
  FROM (SELECT *, len(list_filter(range(2, len(t2.fh)), lambda i: CASE WHEN t2.up THEN t2.fh[i] > t2.fh[i - 1] AND t2.fh[i] > t2.fh[i + 1] ELSE t2.fl[i] < t2.fl[i - 1] AND t2.fl[i] < t2.fl[i + 1] END)) > 0 AS turns,
      coalesce(len(t2.fh) >= 2 AND CASE WHEN t2.up THEN t2.fl[len(t2.fl) - 1] > t2.fh[len(t2.fh)] ELSE t2.fh[len(t2.fh) - 1] < t2.fl[len(t2.fl)] END, false) AS gap
    FROM (SELECT *, {{'up': t.up, 'first': t.first, 'last': no, 'n': t.n + 1, 'h': hi, 'l': lo, 'flo': CASE WHEN t.n < 3 THEN greatest(t.flo, lo) ELSE t.flo END, 'fhi': CASE WHEN t.n < 3 THEN least(t.fhi, hi) ELSE t.fhi END,
        'fh': CASE WHEN (way > 0) = t.up THEN t.fh WHEN inc THEN list_append(t.fh[1:len(t.fh) - 1], CASE WHEN t.up THEN least(t.fh[len(t.fh)], hi) ELSE greatest(t.fh[len(t.fh)], hi) END) ELSE list_append(t.fh, hi) END,
        'fl': CASE WHEN (way > 0) = t.up THEN t.fl WHEN inc THEN list_append(t.fl[1:len(t.fl) - 1], CASE WHEN t.up THEN least(t.fl[len(t.fl)], lo) ELSE greatest(t.fl[len(t.fl)], lo) END) ELSE list_append(t.fl, lo) END}} AS t2
      FROM (SELECT *, len(t.fh) > 0 AND ((t.fh[len(t.fh)] >= hi AND t.fl[len(t.fl)] <= lo) OR (hi >= t.fh[len(t.fh)] AND lo <= t.fl[len(t.fl)])) AS inc, {FRESH} AS fresh
        FROM (SELECT r.now, r.pend, coalesce(r.pend, r.now) AS t, b.* FROM r JOIN bi b ON b.symbol = r.symbol AND b.tf = r.tf AND b.no = r.k + 1)))))
  SELECT * FROM r),
sg_out AS (SELECT symbol, tf, k, out AS s, true AS finished FROM sg WHERE out IS NOT NULL
  UNION ALL SELECT symbol, tf, k + 1, now, false FROM (SELECT * FROM sg QUALIFY k = max(k) OVER (PARTITION BY symbol, tf)) WHERE now.n >= 3 AND now.flo <= now.fhi),
xd AS (SELECT o.symbol, o.tf, (row_number() OVER (PARTITION BY o.symbol, o.tf ORDER BY o.k) - 1)::INTEGER AS no, CASE WHEN o.s.up THEN 1 ELSE -1 END AS way, f.start_idx, l.end_idx,
    CASE WHEN (f.way > 0) = o.s.up THEN f.start_price ELSE f.end_price END AS start_price, CASE WHEN (l.way > 0) = o.s.up THEN l.end_price ELSE l.start_price END AS end_price, o.finished
  FROM sg_out o JOIN bi f ON f.symbol = o.symbol AND f.tf = o.tf AND f.no = o.s.first JOIN bi l ON l.symbol = o.symbol AND l.tf = o.tf AND l.no = o.s.last),
legs AS MATERIALIZED (SELECT symbol, tf, 'bi' AS level, no, way, start_idx, end_idx, start_price, end_price, true AS finished, hi, lo FROM bi
  UNION ALL SELECT symbol, tf, 'xd', no, way, start_idx, end_idx, start_price, end_price, finished, greatest(start_price, end_price), least(start_price, end_price) FROM xd)"""

ZONES = """
zr AS (WITH RECURSIVE r AS (
  SELECT symbol, tf, level, no AS k, 0 AS z, no AS first, hi AS top, lo AS bottom FROM legs WHERE no = 0
  UNION ALL
  SELECT symbol, tf, level, no, CASE WHEN j THEN z ELSE z + 1 END, CASE WHEN j THEN first ELSE no END, CASE WHEN j THEN least(top, hi) ELSE hi END, CASE WHEN j THEN greatest(bottom, lo) ELSE lo END
  FROM (SELECT r.*, l.no, l.hi, l.lo, r.k - r.first + 1 < 3 OR (l.lo <= r.top AND l.hi >= r.bottom) AS j FROM r JOIN legs l ON l.symbol = r.symbol AND l.tf = r.tf AND l.level = r.level AND l.no = r.k + 1))
  SELECT * FROM r),
lists AS MATERIALIZED (SELECT symbol, tf, list(hi ORDER BY no) AS hs, list(lo ORDER BY no) AS ls FROM legs WHERE level = 'xd' GROUP BY ALL),
wr AS (WITH RECURSIVE r AS (
  SELECT symbol, tf, 0 AS k, NULL::INTEGER AS last, NULL::DOUBLE AS top, NULL::DOUBLE AS bottom, NULL::INTEGER AS of_first, NULL::INTEGER AS of_last, NULL::DOUBLE AS of_top, NULL::DOUBLE AS of_bottom FROM lists
  UNION ALL
  SELECT symbol, tf, CASE WHEN last IS NULL THEN CASE WHEN opens THEN k ELSE k + 1 END WHEN grows THEN k ELSE last + 1 END, CASE WHEN last IS NULL THEN CASE WHEN opens THEN k + 2 END WHEN grows THEN last + 1 END,
    CASE WHEN last IS NULL THEN CASE WHEN opens THEN t3 END WHEN grows THEN least(top, hs[last + 2]) END, CASE WHEN last IS NULL THEN CASE WHEN opens THEN b3 END WHEN grows THEN greatest(bottom, ls[last + 2]) END,
    CASE WHEN last IS NOT NULL AND NOT grows THEN k END, CASE WHEN last IS NOT NULL AND NOT grows THEN last END, CASE WHEN last IS NOT NULL AND NOT grows THEN top END, CASE WHEN last IS NOT NULL AND NOT grows THEN bottom END
  FROM (SELECT *, t3 >= b3 AS opens, coalesce(last + 1 < len(hs) AND ls[last + 2] <= top AND hs[last + 2] >= bottom, false) AS grows
    FROM (SELECT r.*, hs, ls, least(hs[k + 1], hs[k + 2], hs[k + 3]) AS t3, greatest(ls[k + 1], ls[k + 2], ls[k + 3]) AS b3 FROM r JOIN lists USING (symbol, tf) WHERE last IS NOT NULL OR k + 2 < len(hs))))
  SELECT * FROM r),
zz AS (SELECT symbol, tf, level, 'zone' AS kind, first, k AS last, top, bottom FROM (SELECT * FROM zr QUALIFY k = max(k) OVER (PARTITION BY symbol, tf, level, z)) WHERE k - first + 1 >= 3 AND top >= bottom
  UNION ALL SELECT symbol, tf, 'xd', 'walk_zone', of_first, of_last, of_top, of_bottom FROM wr WHERE of_first IS NOT NULL),
zones0 AS MATERIALIZED (SELECT z.symbol, z.tf, z.level, z.kind, (row_number() OVER (PARTITION BY z.symbol, z.tf, z.level, z.kind ORDER BY z.first) - 1)::INTEGER AS no, min(l.start_idx) AS start_idx, max(l.end_idx) AS end_idx,
    z.top AS zg, z.bottom AS zd, max(l.hi) AS gg, min(l.lo) AS dd FROM zz z JOIN legs l ON l.symbol = z.symbol AND l.tf = z.tf AND l.level = z.level AND l.no BETWEEN z.first AND z.last GROUP BY z.symbol, z.tf, z.level, z.kind, z.first, z.top, z.bottom),
zw AS MATERIALIZED (SELECT *, lag(way) OVER w AS way0 FROM (SELECT *, CASE WHEN zd > lag(zg) OVER w THEN 1 WHEN zg < lag(zd) OVER w THEN -1 WHEN zd > lag(zd) OVER w THEN 1 ELSE -1 END AS way,
    zd > lag(zg) OVER w OR zg < lag(zd) OVER w AS apart FROM zones0 WINDOW w AS (PARTITION BY symbol, tf, level, kind ORDER BY no)) WINDOW w AS (PARTITION BY symbol, tf, level, kind ORDER BY no)),
zg AS (WITH RECURSIVE r AS (
  SELECT symbol, tf, level, kind, no, 0 AS grp, false AS grown FROM zw WHERE no = 0
  UNION ALL
  SELECT z.symbol, z.tf, z.level, z.kind, z.no, CASE WHEN z.apart AND (NOT r.grown OR z.way = z.way0) THEN r.grp ELSE r.grp + 1 END, z.apart AND (NOT r.grown OR z.way = z.way0)
  FROM r JOIN zw z ON z.symbol = r.symbol AND z.tf = r.tf AND z.level = r.level AND z.kind = r.kind AND z.no = r.no + 1)
  SELECT * FROM r),
all_zones AS MATERIALIZED (SELECT z.symbol, z.tf, z.level, z.kind, z.no, g.grp::INTEGER AS grp, start_idx, end_idx, zg, zd, gg, dd FROM zones0 z JOIN zg g USING (symbol, tf, level, kind, no)),
zones AS (SELECT * EXCLUDE (kind) FROM all_zones WHERE kind = 'zone'),
structures AS (SELECT symbol, tf, level, 'leg' AS kind, no, NULL::INTEGER AS grp, CASE WHEN way > 0 THEN 'up' ELSE 'down' END AS direction, start_idx, end_idx, start_price, end_price, NULL::DOUBLE AS zg, NULL::DOUBLE AS zd, NULL::DOUBLE AS gg, NULL::DOUBLE AS dd, finished FROM legs
  UNION ALL SELECT symbol, tf, level, kind, no, grp, NULL, start_idx, end_idx, NULL, NULL, zg, zd, gg, dd, NULL FROM all_zones)"""

WALKS = """
wz AS (SELECT *, sum(new) OVER (PARTITION BY symbol, tf ORDER BY no) - 1 AS walk, count(*) OVER (PARTITION BY symbol, tf) AS total FROM (
  SELECT *, CASE WHEN coalesce(zd > lag(zd) OVER w OR zg < lag(zg) OVER w, false) THEN 0 ELSE 1 END AS new, coalesce(zd >= lag(zd) OVER w, true) AS rising FROM all_zones WHERE kind = 'walk_zone' WINDOW w AS (PARTITION BY symbol, tf ORDER BY no))),
wg AS (SELECT symbol, tf, walk, count(*) AS zones, max(total) AS total, arg_min(start_idx, no) AS first_start, arg_max(end_idx, no) AS last_end, bool_and(rising OR new = 1) AS rises FROM wz GROUP BY ALL),
wn AS (SELECT g.*, greatest(0, coalesce(min(l.no) FILTER (WHERE l.start_idx = first_start OR l.end_idx = first_start), 0) - 1) AS a,
    least(count(*) - 1, coalesce(min(l.no) FILTER (WHERE l.start_idx = last_end OR l.end_idx = last_end), count(*) - 1) + 1) AS b FROM wg g JOIN legs l ON l.symbol = g.symbol AND l.tf = g.tf AND l.level = 'xd' GROUP BY ALL),
walks AS (SELECT n.symbol, n.tf, n.walk, CASE WHEN CASE WHEN n.total = 1 THEN a.start_price < b.end_price ELSE n.rises END THEN 'up' ELSE 'down' END AS direction, CASE WHEN n.zones >= 2 THEN 'trend' ELSE 'panzheng' END AS walk_type,
    a.start_idx, b.end_idx, a.start_price, b.end_price, n.total > 1 AS finished, n.zones FROM wn n JOIN legs a ON a.symbol = n.symbol AND a.tf = n.tf AND a.level = 'xd' AND a.no = n.a JOIN legs b ON b.symbol = n.symbol AND b.tf = n.tf AND b.level = 'xd' AND b.no = n.b)"""

POWER = """
m AS MATERIALIZED (SELECT symbol, tf, idx, CASE WHEN n >= 26 THEN dif END AS dif, CASE WHEN n >= 26 THEN dea END AS dea, CASE WHEN n >= 26 THEN 2 * (dif - dea) END AS macd_hist FROM e JOIN c USING (symbol, tf, idx)),
powered AS MATERIALIZED (SELECT l.symbol, l.tf, l.level, l.no, CASE WHEN l.way > 0 THEN 'up' ELSE 'down' END AS direction, l.start_idx, l.end_idx, l.start_price, l.end_price, l.finished, l.hi AS high, l.lo AS low,
    coalesce(sum(CASE WHEN l.way > 0 AND macd_hist > 0 THEN macd_hist WHEN l.way < 0 AND macd_hist < 0 THEN -macd_hist ELSE 0 END), 0) AS area,
    coalesce(max(CASE WHEN l.way > 0 THEN greatest(macd_hist, 0) ELSE abs(macd_hist) END), 0) AS peak, CASE WHEN l.way > 0 THEN max(dif) ELSE min(dif) END AS dif_peak
  FROM legs l LEFT JOIN m ON m.symbol = l.symbol AND m.tf = l.tf AND m.idx BETWEEN l.start_idx AND l.end_idx GROUP BY l.symbol, l.tf, l.level, l.no, l.way, l.start_idx, l.end_idx, l.start_price, l.end_price, l.finished, l.hi, l.lo)"""


def diverging(prefix: str, zones: str, legs: str) -> str:
    """Divergences of the groups of ``zones`` (scope, grp, no, start_idx, ...) among ``legs`` of the same scope."""
    p, scope = prefix, "symbol, tf, level, scope"
    weaker = lambda way: f"coalesce(CASE WHEN {way} = 'up' THEN c.dif_peak < b.dif_peak ELSE c.dif_peak > b.dif_peak END, false)"
    return f"""
{p}l AS MATERIALIZED (SELECT * FROM {legs} QUALIFY count(*) OVER (PARTITION BY {scope}) >= 4),
{p}near AS MATERIALIZED (SELECT z.symbol, z.tf, z.start_idx, z.end_idx, coalesce(any_value(s.span) > 0 AND min(abs(m.dif)) < 0.15::DOUBLE * any_value(s.span), false) AS near
  FROM (SELECT DISTINCT symbol, tf, start_idx, end_idx FROM {zones}) z JOIN m ON m.symbol = z.symbol AND m.tf = z.tf AND m.idx BETWEEN z.start_idx AND z.end_idx
  JOIN (SELECT symbol, tf, max(dif) - min(dif) AS span FROM m GROUP BY ALL) s ON s.symbol = z.symbol AND s.tf = z.tf GROUP BY ALL),
{p}z AS MATERIALIZED (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY {scope}, grp) AS n, lag(zg) OVER w AS zg0, lag(zd) OVER w AS zd0, lag(start_idx) OVER w AS start0 FROM {zones} WINDOW w AS (PARTITION BY {scope}, grp ORDER BY no)),
{p}way AS (SELECT {scope}, grp, CASE WHEN zd > zg0 THEN 'up' WHEN zg < zd0 THEN 'down' WHEN zd > zd0 THEN 'up' ELSE 'down' END AS way FROM {p}z WHERE place = 2),
{p}steady AS (SELECT {scope}, grp, way FROM {p}z JOIN {p}way USING ({scope}, grp) WHERE place >= 2 GROUP BY {scope}, grp, way HAVING bool_and(CASE WHEN way = 'up' THEN zd > zg0 ELSE zg < zd0 END)),
{p}sides AS (SELECT z.symbol, z.tf, z.level, z.scope, z.grp, s.way, z.start_idx AS zs, z.end_idx AS ze,
    coalesce(arg_min(l, l.no) FILTER (WHERE l.start_idx >= z.start0 AND l.start_idx < z.start_idx AND l.area > 0 AND l.end_idx >= z.start_idx), arg_min(l, l.no) FILTER (WHERE l.start_idx >= z.start0 AND l.start_idx < z.start_idx AND l.area > 0)) AS b,
    arg_max(l, l.no) FILTER (WHERE l.start_idx >= z.start_idx AND l.start_idx <= z.end_idx + greatest(0, z.end_idx - z.start_idx) AND CASE WHEN s.way = 'up' THEN l.high > z.zg ELSE l.low < z.zd END) AS c
  FROM {p}z z JOIN {p}steady s USING ({scope}, grp) JOIN {p}l l ON l.symbol = z.symbol AND l.tf = z.tf AND l.level = z.level AND l.scope = z.scope AND l.direction = s.way
  WHERE z.place = z.n AND z.n >= 2 GROUP BY z.symbol, z.tf, z.level, z.scope, z.grp, s.way, z.start_idx, z.end_idx),
{p}trend AS MATERIALIZED (SELECT * FROM (SELECT x.symbol, x.tf, x.level, x.scope, x.grp, -1 AS zone, x.c.end_idx AS idx, x.way AS direction, 'trend' AS sub_type, x.c.area < x.b.area AS by_area,
    coalesce(n.near, false) AND {weaker("x.way").replace("c.", "x.c.").replace("b.", "x.b.")} AS by_dif, NULL::BOOLEAN AS broken
  FROM {p}sides x LEFT JOIN {p}near n ON n.symbol = x.symbol AND n.tf = x.tf AND n.start_idx = x.zs AND n.end_idx = x.ze WHERE x.b IS NOT NULL AND x.c IS NOT NULL AND CASE WHEN x.way = 'up' THEN x.c.high > x.b.high ELSE x.c.low < x.b.low END) WHERE by_area OR by_dif),
{p}rest AS (SELECT z.symbol, z.tf, z.level, z.scope, z.grp, z.no, z.start_idx AS zs, z.end_idx AS ze, arg_max(l, l.no) FILTER (WHERE l.end_idx <= z.start_idx) AS b, arg_min(l, l.no) FILTER (WHERE l.start_idx >= z.end_idx) AS c
  FROM {p}z z JOIN {p}l l ON l.symbol = z.symbol AND l.tf = z.tf AND l.level = z.level AND l.scope = z.scope
  WHERE NOT EXISTS (SELECT 1 FROM {p}trend t WHERE t.symbol = z.symbol AND t.tf = z.tf AND t.level = z.level AND t.scope = z.scope AND t.grp = z.grp) GROUP BY z.symbol, z.tf, z.level, z.scope, z.grp, z.no, z.start_idx, z.end_idx),
{p}divergences AS MATERIALIZED (SELECT * FROM {p}trend UNION ALL SELECT * FROM (SELECT x.symbol, x.tf, x.level, x.scope, x.grp, x.no, x.c.end_idx, x.c.direction, 'panzheng', x.c.area < x.b.area AS by_area,
    coalesce(n.near, false) AND {weaker("x.b.direction").replace("c.dif", "x.c.dif").replace("< b.", "< x.b.").replace("> b.", "> x.b.")} AS by_dif, CASE WHEN x.c.direction = 'up' THEN x.c.high > x.b.high ELSE x.c.low < x.b.low END
  FROM {p}rest x LEFT JOIN {p}near n ON n.symbol = x.symbol AND n.tf = x.tf AND n.start_idx = x.zs AND n.end_idx = x.ze WHERE x.b.direction = x.c.direction AND x.b.area > 0 AND x.b.peak > 0) WHERE by_area OR by_dif)"""


DIVERGENCES = """
scoped_z AS (SELECT *, 0 AS scope FROM zones), scoped_l AS (SELECT *, 0 AS scope FROM powered),""" + diverging("d_", "scoped_z", "scoped_l")

WALK_DIVERGENCES = """
walk_z AS (SELECT symbol, tf, 'walk' AS level, walk::INTEGER AS scope, 0 AS grp, no, start_idx, end_idx, zg, zd FROM wz),
walk_l AS (SELECT p.* REPLACE ('walk' AS level), w.walk::INTEGER AS scope FROM walks w JOIN powered p ON p.symbol = w.symbol AND p.tf = w.tf AND p.level = 'xd' AND p.start_idx >= w.start_idx AND p.end_idx <= w.end_idx),""" + diverging("w_", "walk_z", "walk_l")

POINTS = """
pz AS MATERIALIZED (SELECT *, first_value(nullif(way, 0) IGNORE NULLS) OVER (PARTITION BY symbol, tf, level ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS way1 FROM (
  SELECT *, CASE WHEN zd > lag(zg) OVER w THEN 1 WHEN zg < lag(zd) OVER w THEN -1 ELSE 0 END AS way FROM zones WINDOW w AS (PARTITION BY symbol, tf, level ORDER BY no))),
pg AS MATERIALIZED (WITH RECURSIVE r AS (
  SELECT symbol, tf, level, no, 0 AS g, coalesce(way1, 0) AS now FROM pz WHERE no = 0
  UNION ALL
  SELECT z.symbol, z.tf, z.level, z.no, CASE WHEN r.now <> 0 AND z.way = r.now THEN r.g ELSE r.g + 1 END, z.way FROM r JOIN pz z ON z.symbol = r.symbol AND z.tf = r.tf AND z.level = r.level AND z.no = r.no + 1)
  SELECT r.symbol, r.tf, r.level, r.g, z.start_idx, z.zg, z.zd, z.no FROM r JOIN pz z USING (symbol, tf, level, no)),
pl AS MATERIALIZED (SELECT * FROM powered QUALIFY count(*) OVER (PARTITION BY symbol, tf, level) >= 3),
first0 AS (SELECT d.symbol, d.tf, d.level, d.idx, d.direction FROM (SELECT *, row_number() OVER () AS dk FROM d_divergences WHERE sub_type = 'trend') d JOIN pg z ON z.symbol = d.symbol AND z.tf = d.tf AND z.level = d.level AND z.start_idx <= d.idx
  GROUP BY d.symbol, d.tf, d.level, d.idx, d.direction, d.dk, z.g HAVING count(*) >= 2 AND d.direction = CASE WHEN arg_max(z.zd, z.no) > arg_min(z.zg, z.no) THEN 'up' WHEN arg_max(z.zg, z.no) < arg_min(z.zd, z.no) THEN 'down' END),
point1 AS MATERIALIZED (SELECT DISTINCT f.symbol, f.tf, f.level, f.idx, CASE f.direction WHEN 'down' THEN '1buy' ELSE '1sell' END AS bs_type,
  coalesce((SELECT arg_min(l.end_price, l.no) FROM pl l WHERE l.symbol = f.symbol AND l.tf = f.tf AND l.level = f.level AND l.end_idx = f.idx), 0) AS price FROM first0 f),
outs AS (SELECT p.symbol, p.tf, p.level, p.idx, p.bs_type, p.price, min(l.no) AS out_no FROM point1 p JOIN pl l ON l.symbol = p.symbol AND l.tf = p.tf AND l.level = p.level AND l.start_idx >= p.idx AND l.direction = CASE p.bs_type WHEN '1buy' THEN 'up' ELSE 'down' END GROUP BY ALL),
point2 AS (SELECT o.symbol, o.tf, o.level, arg_min(l.end_idx, l.no) AS idx, CASE WHEN o.bs_type = '1buy' THEN '2buy' ELSE '2sell' END
    || CASE WHEN CASE WHEN o.bs_type = '1buy' THEN arg_min(l.end_price, l.no) >= o.price ELSE arg_min(l.end_price, l.no) <= o.price END THEN '' ELSE '_break' END AS bs_type, arg_min(l.end_price, l.no) AS price
  FROM outs o JOIN pl l ON l.symbol = o.symbol AND l.tf = o.tf AND l.level = o.level AND l.start_idx >= o.idx AND l.no > o.out_no AND l.direction <> CASE o.bs_type WHEN '1buy' THEN 'up' ELSE 'down' END
  GROUP BY o.symbol, o.tf, o.level, o.idx, o.bs_type, o.price, o.out_no),
point3 AS (SELECT z.symbol, z.tf, z.level, b.end_idx AS idx, CASE WHEN o.direction = 'up' THEN '3buy' ELSE '3sell' END AS bs_type, CASE WHEN o.direction = 'up' THEN b.low ELSE b.high END AS price
  FROM zones z JOIN pl o ON o.symbol = z.symbol AND o.tf = z.tf AND o.level = z.level AND o.start_idx >= z.end_idx JOIN pl b ON b.symbol = o.symbol AND b.tf = o.tf AND b.level = o.level AND b.no = o.no + 1
  WHERE (o.direction = 'up' AND b.direction = 'down' AND o.high > z.zg AND b.low >= z.zg OR o.direction = 'down' AND b.direction = 'up' AND o.low < z.zd AND b.high <= z.zd)
    AND NOT EXISTS (SELECT 1 FROM zones x WHERE x.symbol = z.symbol AND x.tf = z.tf AND x.level = z.level AND x.start_idx > z.end_idx AND x.start_idx <= o.start_idx)),
sided3 AS (SELECT *, contains(bs_type, 'buy') AS buy FROM point3), sided2 AS (SELECT *, contains(bs_type, 'buy') AS buy FROM point2),
every_point AS (SELECT symbol, tf, level, idx, bs_type, price FROM point1
  UNION ALL SELECT t.symbol, t.tf, t.level, t.idx, CASE WHEN EXISTS (SELECT 1 FROM sided3 x WHERE x.symbol = t.symbol AND x.tf = t.tf AND x.level = t.level AND x.idx = t.idx AND x.buy = t.buy) THEN '2+3' || t.bs_type[2:] ELSE t.bs_type END, t.price FROM sided2 t
  UNION ALL SELECT x.symbol, x.tf, x.level, x.idx, x.bs_type, x.price FROM sided3 x WHERE NOT EXISTS (SELECT 1 FROM sided2 t WHERE x.symbol = t.symbol AND x.tf = t.tf AND x.level = t.level AND x.idx = t.idx AND x.buy = t.buy)),
points AS MATERIALIZED (SELECT * FROM every_point QUALIFY row_number() OVER (PARTITION BY symbol, tf, idx, bs_type ORDER BY level, price) = 1)"""

NESTED = """
np AS (SELECT *, contains(bs_type, 'buy') AS buy, CASE WHEN bs_type[1] = '1' THEN 1 ELSE 2 END AS r FROM points),
nested AS (SELECT h.symbol, h.tf, l.tf AS low_tf, h.idx, h.price, h.bs_type AS high_type, l.bs_type AS low_type, l.idx AS low_idx, CASE WHEN h.buy THEN 'down' ELSE 'up' END AS direction,
    CASE WHEN h.r = 1 AND l.r = 1 THEN 'strong' WHEN h.r <> l.r THEN 'medium' ELSE 'weak' END AS strength FROM np h JOIN np l ON h.symbol = l.symbol AND h.buy = l.buy AND h.tf = 'd' AND l.tf = 'f60'
  QUALIFY row_number() OVER (PARTITION BY h.symbol, h.tf, h.idx, h.bs_type ORDER BY CASE WHEN h.r = 1 AND l.r = 1 THEN 3 WHEN h.r <> l.r THEN 2 ELSE 1 END DESC, l.idx, l.bs_type) = 1)"""

RANGES = """
climax AS (SELECT symbol, tf, idx AS start_idx, event_type AS of, price AS p FROM found WHERE event_type IN ('SC', 'BC')),
rally AS (SELECT c.symbol, c.tf, c.start_idx, min(a.idx) AS ar, CASE of WHEN 'SC' THEN arg_min(a.price, a.idx) ELSE p END AS upper, CASE of WHEN 'SC' THEN p ELSE arg_min(a.price, a.idx) END AS lower
  FROM climax c JOIN found a ON a.symbol = c.symbol AND a.tf = c.tf AND a.event_type = 'AR' AND a.idx > c.start_idx AND a.idx <= c.start_idx + 10 GROUP BY c.symbol, c.tf, c.start_idx, of, p),
closes AS MATERIALIZED (SELECT symbol, tf, idx, close, lead(close) OVER w AS c1, lead(close, 2) OVER w AS c2, max(idx) OVER (PARTITION BY symbol, tf) AS last FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY idx)),
of_events AS MATERIALIZED (SELECT r.symbol, r.tf, r.start_idx, coalesce((SELECT min(s.idx) FROM found s WHERE s.symbol = r.symbol AND s.tf = r.tf AND s.event_type IN ('SOS', 'SOW', 'UTAD') AND s.idx > r.ar),
    min(c.idx) FILTER (WHERE (c.close > 1.02::DOUBLE * upper OR c.close < 0.98::DOUBLE * lower) AND (c.c1 > 1.02::DOUBLE * upper OR c.c1 < 0.98::DOUBLE * lower) AND (c.c2 > 1.02::DOUBLE * upper OR c.c2 < 0.98::DOUBLE * lower)), any_value(c.last)) AS end_idx, upper, lower
  FROM rally r JOIN closes c ON c.symbol = r.symbol AND c.tf = r.tf AND c.idx >= r.ar WHERE upper > lower GROUP BY r.symbol, r.tf, r.start_idx, r.ar, upper, lower),
sw0 AS (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom, count(*) OVER (PARTITION BY symbol, tf) AS n FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
sw AS MATERIALIZED (SELECT symbol, tf, idx, 'high' AS kind, high AS price FROM sw0 WHERE idx >= 5 AND idx < n - 5 AND high >= top UNION ALL SELECT symbol, tf, idx, 'low', low FROM sw0 WHERE idx >= 5 AND idx < n - 5 AND low <= bottom),
sk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, tf, kind ORDER BY idx) AS k FROM sw WHERE (symbol, tf) NOT IN (SELECT symbol, tf FROM of_events)),
pgr AS (WITH RECURSIVE r AS (
  SELECT symbol, tf, kind, k, 0 AS g, price AS total, 1 AS n, idx FROM sk WHERE k = 1
  UNION ALL
  SELECT symbol, tf, kind, sk, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN total + price ELSE price END, CASE WHEN near THEN n + 1 ELSE 1 END, sidx
  FROM (SELECT r.*, s.k AS sk, s.price, s.idx AS sidx, r.total <> 0 AND abs(s.price - r.total / r.n) / (r.total / r.n) < 0.05 AS near FROM r JOIN sk s ON s.symbol = r.symbol AND s.tf = r.tf AND s.kind = r.kind AND s.k = r.k + 1))
  SELECT symbol, tf, kind, arg_max(total, k) / max(n) AS price, min(idx) AS f, max(idx) AS l FROM r GROUP BY symbol, tf, kind, g HAVING count(*) >= 2),
raw_ranges AS (SELECT symbol, tf, start_idx, end_idx, upper, lower FROM of_events
  UNION ALL SELECT h.symbol, h.tf, least(h.f, l.f), greatest(h.l, l.l), h.price, l.price FROM pgr h JOIN pgr l ON h.symbol = l.symbol AND h.tf = l.tf AND h.kind = 'high' AND l.kind = 'low' AND h.price > l.price AND (h.price - l.price) / l.price < 0.2),
ranges AS MATERIALIZED (SELECT symbol, tf, no, min(start_idx)::INTEGER AS start_idx, max(end_idx)::INTEGER AS end_idx, max(upper) AS upper, min(lower) AS lower, (max(upper) + min(lower)) / 2 AS ice FROM (
  SELECT *, sum(new) OVER (PARTITION BY symbol, tf ORDER BY start_idx, end_idx, upper, lower ROWS UNBOUNDED PRECEDING) - 1 AS no FROM (SELECT *, CASE WHEN coalesce(start_idx > max(end_idx) OVER w, true) THEN 1 ELSE 0 END AS new FROM raw_ranges
    WINDOW w AS (PARTITION BY symbol, tf ORDER BY start_idx, end_idx, upper, lower ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY symbol, tf, no)"""

PHASES = """
pb AS MATERIALIZED (SELECT symbol, tf, idx, close, vol, first_value(close) OVER (PARTITION BY symbol, tf ORDER BY idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS ago, avg(vol) OVER (PARTITION BY symbol, tf) AS mv FROM bars
  QUALIFY count(*) OVER (PARTITION BY symbol, tf) >= 20),
pr AS MATERIALIZED (SELECT r.symbol, r.tf, r.start_idx AS s, r.end_idx AS e, upper, lower, coalesce(b.close - b.ago, 0) < 0 AS fell FROM ranges r LEFT JOIN pb b ON b.symbol = r.symbol AND b.tf = r.tf AND b.idx = r.start_idx),
pj AS (SELECT b.*, r.s, r.e, r.upper, r.lower, r.fell, r.s IS NOT NULL AS begun, EXISTS (SELECT 1 FROM pr x WHERE x.symbol = b.symbol AND x.tf = b.tf) AS any_range FROM pb b ASOF LEFT JOIN pr r ON r.symbol = b.symbol AND r.tf = b.tf AND b.idx >= r.s),
pe AS MATERIALIZED (SELECT j.symbol, j.tf, j.idx, coalesce(bool_or(event_type IN ('LPS', 'LPSY', 'SOS', 'SOW')), false) AS d, coalesce(bool_or(event_type IN ('Spring', 'UTAD')), false) AS c, coalesce(bool_or(event_type = 'ST'), false) AS b,
    coalesce(bool_or(event_type IN ('AR', 'SC', 'BC')), false) AS a FROM pj j LEFT JOIN found f ON f.symbol = j.symbol AND f.tf = j.tf AND f.idx BETWEEN j.s AND j.idx GROUP BY ALL),
phases AS MATERIALIZED (SELECT symbol, tf, idx,
    CASE WHEN NOT any_range THEN CASE WHEN idx < 10 THEN 'Markdown' WHEN close > ago THEN CASE WHEN vol > 1.5 * mv THEN 'Markup' ELSE 'Distribution' END WHEN close < ago THEN CASE WHEN vol > 1.5 * mv THEN 'Markdown' ELSE 'Accumulation' END ELSE 'Accumulation' END
      WHEN NOT begun THEN CASE WHEN idx < 20 THEN 'Markdown' WHEN close > ago THEN 'Markup' ELSE 'Markdown' END WHEN idx <= e THEN CASE WHEN fell THEN 'Accumulation' ELSE 'Distribution' END
      WHEN fell THEN CASE WHEN close > upper THEN 'Markup' ELSE 'Accumulation' END ELSE CASE WHEN close < lower THEN 'Markdown' ELSE 'Distribution' END END AS phase,
    CASE WHEN NOT any_range OR NOT begun THEN '' WHEN idx <= e THEN CASE WHEN d THEN 'D' WHEN c THEN 'C' WHEN b THEN 'B' WHEN a THEN 'A' ELSE 'B' END
      WHEN CASE WHEN fell THEN close > upper ELSE close < lower END THEN 'E' ELSE 'D' END AS sub_phase FROM pj JOIN pe USING (symbol, tf, idx)),
current_phase AS (SELECT symbol, tf, max(idx) AS idx, arg_max(phase, idx) AS phase, arg_max(sub_phase, idx) AS sub_phase FROM phases GROUP BY symbol, tf)"""

LINES = """
two AS (SELECT symbol, tf, CASE kind WHEN 'high' THEN 'supply' ELSE 'demand' END AS line_type, min(idx) AS start_idx, max(idx) AS end_idx, arg_min(price, idx) AS start_price, arg_max(price, idx) AS end_price
  FROM (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY symbol, tf, kind ORDER BY idx DESC) <= 2) GROUP BY symbol, tf, kind HAVING count(*) = 2),
lines AS (SELECT *, (end_price - start_price) / (end_idx - start_idx) AS slope FROM two
  UNION ALL SELECT symbol, tf, x.t, start_idx, end_idx, x.p, x.p, 0 FROM (SELECT *, unnest([{'t': 'supply', 'p': upper}, {'t': 'demand', 'p': lower}, {'t': 'ice', 'p': ice}]) AS x FROM ranges)),
breaks AS (SELECT * FROM (SELECT b.symbol, b.tf, b.idx, l.line_type, l.start_idx, l.end_idx, round(l.start_price + l.slope * (b.idx - l.start_idx), 6) AS level,
    CASE WHEN l.line_type = 'supply' AND (b.close - (l.start_price + l.slope * (b.idx - l.start_idx))) / (l.start_price + l.slope * (b.idx - l.start_idx)) > 0.03 AND b.vol > 1.3::DOUBLE * b.mv THEN 'breakout'
      WHEN l.line_type = 'demand' AND (b.close - (l.start_price + l.slope * (b.idx - l.start_idx))) / (l.start_price + l.slope * (b.idx - l.start_idx)) < -0.03 AND b.vol > 1.3::DOUBLE * b.mv THEN 'breakdown' END AS break_type
  FROM (SELECT *, avg(vol) OVER (PARTITION BY symbol, tf) AS mv FROM bars) b JOIN lines l ON l.symbol = b.symbol AND l.tf = b.tf AND b.idx > l.end_idx) WHERE break_type IS NOT NULL)"""

FUSION = """
rule_table(rule, bs_type, event_type, s, d, reading) AS (VALUES
  (0, '1buy', 'Spring', 5, 'bullish', 'a failed break below the range where a trend of falling zones ends'),
  (1, '1buy', 'SC', 4, 'bullish', 'panic selling where a trend of falling zones ends'),
  (2, '1buy', 'ST', 4, 'bullish', 'the low holds on little volume where a trend of falling zones ends'),
  (3, '2buy', 'LPS', 4, 'bullish', 'the first pullback after the turn finds support on little volume'),
  (3, '2+3buy', 'LPS', 4, 'bullish', 'the first pullback after the turn finds support on little volume'),
  (4, '2buy', 'SOS', 4, 'bullish', 'strength shows while the first pullback after the turn holds'),
  (4, '2+3buy', 'SOS', 4, 'bullish', 'strength shows while the first pullback after the turn holds'),
  (5, '3buy', 'JOC', 4, 'bullish', 'price leaves the zone on volume and stays above it'),
  (6, '1sell', 'UTAD', 5, 'bearish', 'a failed break above the range where a trend of rising zones ends'),
  (7, '1sell', 'BC', 4, 'bearish', 'buying dries up at a climax where a trend of rising zones ends'),
  (8, '2sell', 'SOW', 4, 'bearish', 'weakness shows while the first rally after the turn fails'),
  (8, '2+3sell', 'SOW', 4, 'bearish', 'weakness shows while the first rally after the turn fails'),
  (9, '3sell', 'LPSY', 4, 'bearish', 'a weak rally fails to return into the zone'),
  (10, '3sell', 'SOW', 4, 'bearish', 'price leaves the zone downwards on volume'),
  (11, '1buy', 'AR', 3, 'bullish', 'the first rally answers the turn'),
  (11, '2buy', 'AR', 3, 'bullish', 'the first rally answers the turn'),
  (11, '2+3buy', 'AR', 3, 'bullish', 'the first rally answers the turn'),
  (12, '1sell', 'PSY', 3, 'bearish', 'supply begins to meet the rise near the turn'),
  (12, '2sell', 'PSY', 3, 'bearish', 'supply begins to meet the rise near the turn'),
  (12, '2+3sell', 'PSY', 3, 'bearish', 'supply begins to meet the rise near the turn')),
fj AS (SELECT p.*, f.idx AS event_idx, f.event_type, f.seq, t.rule, t.s, t.d, t.reading, min(t.rule) OVER (PARTITION BY p.symbol, p.tf, p.level, p.idx, p.bs_type, p.price) AS best
  FROM points p JOIN found f ON f.symbol = p.symbol AND f.tf = p.tf AND f.idx BETWEEN p.idx - 5 AND p.idx + 5 LEFT JOIN rule_table t ON t.bs_type = p.bs_type AND t.event_type = f.event_type),
fused AS MATERIALIZED (SELECT symbol, tf, level, idx, bs_type, price, string_agg(event_type, '/' ORDER BY event_idx, seq) AS events, coalesce(max(s), 2)::INTEGER AS strength,
    coalesce(max(d), CASE WHEN contains(bs_type, 'buy') THEN 'bullish' ELSE 'bearish' END) AS direction, max(best)::INTEGER AS rule, coalesce(max(reading), 'a point with volume events nearby that no rule names') AS reading
  FROM fj WHERE best IS NULL OR rule = best GROUP BY symbol, tf, level, idx, bs_type, price),
screened AS (SELECT t.symbol, t.tf, level, t.idx, bs_type, price, events, strength, direction, reading, phase, sub_phase FROM (
  SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY idx DESC, strength DESC, level, bs_type) = 1) t LEFT JOIN current_phase c ON c.symbol = t.symbol AND c.tf = t.tf)"""

FEED = """
feed AS (SELECT symbol, tf, level, idx, bs_type AS signal, price FROM points
  UNION ALL SELECT d.symbol, d.tf, d.level, d.idx, 'divergence_' || d.sub_type, CASE d.direction WHEN 'up' THEN b.high ELSE b.low END FROM d_divergences d JOIN bars b ON b.symbol = d.symbol AND b.tf = d.tf AND b.idx = d.idx)"""

CURRENT = "SELECT symbol, tf, idx, phase, sub_phase FROM current_phase"
MARKS = """
marks AS (SELECT symbol, tf, 'leg' AS layer, level, direction AS label, start_idx, end_idx, least(start_price, end_price) AS low, greatest(start_price, end_price) AS high, NULL::INTEGER AS strength FROM structures WHERE kind = 'leg'
  UNION ALL SELECT symbol, tf, 'zone', level, 'group ' || grp, start_idx, end_idx, zd, zg, NULL FROM structures WHERE kind = 'zone'
  UNION ALL SELECT symbol, tf, 'divergence', level, sub_type || ' ' || direction, idx, idx, NULL, NULL, NULL FROM d_divergences
  UNION ALL SELECT symbol, tf, 'point', level, bs_type, idx, idx, price, price, NULL FROM points)"""
LISTING = """
listing AS (SELECT symbol, tf, level, label, start_idx, end_idx, first_price, second_price, row_number() OVER (PARTITION BY symbol, tf ORDER BY part, kind_no, level, start_idx, end_idx, label)::INTEGER AS no FROM (
  SELECT symbol, tf, CASE kind WHEN 'leg' THEN 0 ELSE 1 END AS part, 0 AS kind_no, level, coalesce(direction, 'zone') AS label, start_idx, end_idx, coalesce(start_price, zd) AS first_price, coalesce(end_price, zg) AS second_price FROM structures WHERE kind IN ('leg', 'zone')
  UNION ALL SELECT symbol, tf, 2, list_position(['1buy', '2buy', '2buy_break', '3buy', '2+3buy', '2+3buy_break', '1sell', '2sell', '2sell_break', '3sell', '2+3sell', '2+3sell_break'], bs_type), level, bs_type, idx, idx, price, price FROM points))"""
REPORT = """SELECT symbol, tf, kind, count(*) AS n FROM (SELECT symbol, tf, level || '_' || kind AS kind FROM structures UNION ALL SELECT symbol, tf, 'point_' || bs_type FROM points
  UNION ALL SELECT symbol, tf, 'divergence_' || sub_type FROM d_divergences) GROUP BY ALL"""
