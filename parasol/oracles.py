"""DuckDB SQL for the queries that SQL can express, written on its own from their meaning.

The made-up city is built anew here from the same arithmetic (see sources.city). Lambert-93 is spelled out with
its derived constants.
"""

from __future__ import annotations

from parasol.functions.geo import APEX, CONE, ECCENTRICITY, SCALE

ORACLES: dict[str, str] = {}


def _rho(lat: str) -> str:
    s = f"({ECCENTRICITY!r}::DOUBLE * sin(radians({lat})))"
    return f"({SCALE!r}::DOUBLE * pow(tan(pi() / 4 - radians({lat}) / 2) * pow((1 + {s}) / (1 - {s}), {ECCENTRICITY / 2!r}::DOUBLE), {CONE!r}::DOUBLE))"


def x93(lon: str, lat: str) -> str:
    return f"(700000.0::DOUBLE + {_rho(lat)} * sin({CONE!r}::DOUBLE * radians(({lon}) - 3.0::DOUBLE)))"


def y93(lon: str, lat: str) -> str:
    return f"(6600000.0::DOUBLE + {APEX!r}::DOUBLE - {_rho(lat)} * cos({CONE!r}::DOUBLE * radians(({lon}) - 3.0::DOUBLE)))"


def _lon(n: str) -> str:
    return f"(2.35::DOUBLE + ({n} % 12) * 0.000136::DOUBLE)"


def _lat(n: str) -> str:
    return f"(48.86::DOUBLE + ({n} // 12) * 0.00009::DOUBLE)"


NODE = f"""
node_raw AS (SELECT range AS nid, {_lon("range")} AS lon, {_lat("range")} AS lat FROM range(144)),
node AS (SELECT nid, lon, lat, {x93("lon", "lat")} AS x, {y93("lon", "lat")} AS y FROM node_raw)"""

SEGMENT = f"""
seg0 AS (
  SELECT CAST(range AS INT) AS i, (range // 11) * 12 + range % 11 AS a, range // 11 AS line, 1 AS step, 'H' AS way FROM range(132)
  UNION ALL SELECT CAST(range + 132 AS INT), range, range % 12, 12, 'V' FROM range(132)),
seg1 AS (
  SELECT i, a, a + step AS b, way,
         CASE WHEN (way = 'H' AND line // 2 = 3) OR (way = 'V' AND line // 2 = 4) THEN NULL ELSE 'Rue ' || way || (line // 2) END AS rue,
         CASE WHEN way = 'H' THEN CASE WHEN line % 2 = 0 THEN 'sud' ELSE 'nord' END ELSE CASE WHEN line % 2 = 0 THEN 'ouest' ELSE 'est' END END AS cote,
         10 + ((i * 7919) % 997) / 997.0::DOUBLE AS l, (i % 3 - 1) * 1e-5::DOUBLE AS bend FROM seg0),
seg2 AS (
  SELECT i, a, b, rue, cote, l, {_lon("a")} AS lon0, {_lat("a")} AS lat0,
         ({_lon("a")} + {_lon("b")}) / 2 + CASE WHEN way = 'V' THEN bend ELSE 0 END AS lon1,
         ({_lat("a")} + {_lat("b")}) / 2 + CASE WHEN way = 'H' THEN bend ELSE 0 END AS lat1,
         {_lon("b")} AS lon2, {_lat("b")} AS lat2 FROM seg1),
segment AS (
  SELECT * FROM seg2 UNION ALL
  SELECT i + 1000, b, a, rue, cote, l + 2, lon2, lat2 + 2e-6, lon1, lat1 + 2e-6, lon0, lat0 + 2e-6 FROM seg2 WHERE i % 11 = 0),
seg3 AS (
  SELECT *, {x93("lon0", "lat0")} AS x0, {y93("lon0", "lat0")} AS y0, {x93("lon1", "lat1")} AS x1, {y93("lon1", "lat1")} AS y1,
         {x93("lon2", "lat2")} AS x2, {y93("lon2", "lat2")} AS y2 FROM segment),
seg AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d1, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS d2 FROM seg3),
strip0 AS (
  SELECT i, a, b, rue, cote, (i % 3) * 10000 + i AS ord, 1 AS p, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_, 0.0::DOUBLE AS off_, d1 AS len, d1 + d2 AS whole FROM seg
  UNION ALL SELECT i, a, b, rue, cote, (i % 3) * 10000 + i, 2, x1, y1, x2, y2, d1, d2, d1 + d2 FROM seg)"""

CROSSING = """
cell AS (SELECT range // 11 AS r, range % 11 AS c, (range // 11) * 12 + range % 11 AS a FROM range(121)),
crossing AS (
  SELECT a, a + 13 AS b, 14 + ((a * 31) % 97) / 97.0::DOUBLE AS l, CASE WHEN (r * c) % 2 = 0 THEN 'osm_crossing' ELSE 'carrefour' END AS src
  FROM cell WHERE (r + c) % 3 = 0),
edge AS (
  SELECT least(a, b) AS lo, greatest(a, b) AS hi, 'trottoir' AS kind, l, i, CAST(NULL AS VARCHAR) AS src
  FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY i DESC) AS k FROM segment) WHERE k = 1
  UNION ALL SELECT a, b, 'traversee', l, CAST(NULL AS INT), src FROM crossing)"""

SHADE = """
shade AS (
  SELECT i, CAST(range AS INT) AS j, lpad(CAST((420 + 15 * range) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((420 + 15 * range) % 60 AS VARCHAR), 2, '0') AS hhmm,
         CASE WHEN (i + range) % 23 = 0 THEN 255 ELSE (17 * i + 31 * range) % 101 END AS val, CASE WHEN (i * range) % 7 = 0 THEN 1 ELSE 0 END AS low_conf
  FROM segment, range(48))"""

REQUEST = f"""
req0 AS (SELECT c_custkey AS route_id, (c_custkey * 7) % 144 AS d, (c_custkey * 13 + 5) % 144 AS e FROM customer),
request AS (
  SELECT route_id, {_lon("d")} + (route_id % 7 - 3.5::DOUBLE) * 1e-5 AS dep_lon, {_lat("d")} + (route_id % 5 - 2.5::DOUBLE) * 1e-5 AS dep_lat,
         {_lon("e")} + (route_id % 5 - 2.5::DOUBLE) * 1e-5 AS arr_lon, {_lat("e")} + (route_id % 7 - 3.5::DOUBLE) * 1e-5 AS arr_lat,
         CAST(9 + route_id % 8 AS VARCHAR) || ':' || CAST(route_id % 60 AS VARCHAR) AS heure, ([0.0::DOUBLE, 1.0::DOUBLE, 2.0, 4.0])[route_id % 4 + 1] AS k, route_id % 2 = 0 AS by_passage
  FROM req0)"""

FIX = f"""
fix0 AS (
  SELECT event_id, user_id AS walk_id, ts, value, event_type, 2.35::DOUBLE + ((event_id * 37) % 1201) * (0.000136::DOUBLE * 11 / 1200) AS lon,
         48.86::DOUBLE + ((event_id * 53) % 1103) * (0.00009::DOUBLE * 11 / 1100) AS lat, CAST(3 + event_id % 12 AS DOUBLE) AS precision_m, epoch_us(ts) // 1000 AS t_ms FROM events),
fix AS (SELECT *, {x93("lon", "lat")} AS x, {y93("lon", "lat")} AS y FROM fix0)"""


def _near(p: str, s: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {s}.len > 0 THEN (({p}.x - {s}.ax) * ({s}.bx - {s}.ax) + ({p}.y - {s}.ay) * ({s}.by_ - {s}.ay)) / ({s}.len * {s}.len) ELSE 0 END))"


def _pair(p: str, s: str) -> str:
    return f"sqrt(({p}.x - ({s}.ax + t * ({s}.bx - {s}.ax))) ** 2 + ({p}.y - ({s}.ay + t * ({s}.by_ - {s}.ay))) ** 2)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


ORACLES["project_nodes"] = _with(NODE) + "SELECT nid, lon, lat, round(x, 3) AS x, round(y, 3) AS y FROM node"

ORACLES["shade_decode"] = _with(SEGMENT, SHADE) + "SELECT i, j, hhmm, CAST(val AS INT) AS val, CAST(low_conf AS INT) AS low_conf FROM shade"

ORACLES["shade_classes"] = _with(SEGMENT, SHADE) + """
SELECT hhmm, CASE WHEN val = 255 THEN 'indetermine' WHEN val >= 50 THEN 'ombre' ELSE 'soleil' END AS classe, count(*) AS n, CAST(sum(low_conf) AS BIGINT) AS n_faible
FROM shade GROUP BY 1, 2"""

ORACLES["edges_built"] = _with(SEGMENT, CROSSING) + """
SELECT lo AS u, hi AS v, kind, round(l, 9) AS l, i, src FROM edge UNION ALL SELECT hi, lo, kind, round(l, 9), i, src FROM edge"""

ORACLES["segment_upsert"] = _with(SEGMENT) + """
, again AS (SELECT CAST(l_partkey % 264 AS INT) AS i, max(CAST(l_orderkey * 10 + l_linenumber AS INT)) AS tag FROM lineitem GROUP BY 1)
SELECT s.i, CASE WHEN s.i % 3 = 2 OR a.tag IS NULL THEN -1 WHEN s.i % 3 = 1 AND s.i > a.tag THEN -1 ELSE a.tag END AS tag, round(s.d1 + s.d2, 3) AS longueur
FROM seg s LEFT JOIN again a ON s.i = a.i WHERE s.i < 264"""

ORACLES["tile_pruning"] = _with(REQUEST) + f"""
, p AS (SELECT route_id, {x93("dep_lon", "dep_lat")} AS ax, {y93("dep_lon", "dep_lat")} AS ay, {x93("arr_lon", "arr_lat")} AS bx, {y93("arr_lon", "arr_lat")} AS by_ FROM request),
tile AS (SELECT 6522 + range % 20 AS tx, 68614 + range // 20 AS ty FROM range(400))
SELECT route_id, count(*) AS n, min(tx || '_' || ty) AS premiere, max(tx || '_' || ty) AS derniere FROM p, tile
WHERE tx * 100.0::DOUBLE < greatest(ax, bx) + 150 AND (tx + 1) * 100.0::DOUBLE > least(ax, bx) - 150 AND ty * 100.0::DOUBLE < greatest(ay, by_) + 150 AND (ty + 1) * 100.0::DOUBLE > least(ay, by_) - 150
GROUP BY 1"""

ORACLES["floored_times"] = _with(REQUEST) + """
SELECT route_id, heure, lpad(split_part(heure, ':', 1), 2, '0') || ':' || lpad(CAST(CAST(split_part(heure, ':', 2) AS INT) // 15 * 15 AS VARCHAR), 2, '0') AS arrondie FROM request"""

ORACLES["sidewalk_layer"] = _with(SEGMENT, SHADE) + """
SELECT i, CASE WHEN val <> 255 THEN val / 100.0::DOUBLE END AS fraction_ombre, val = 255 AS indetermine, low_conf = 1 AS confiance_faible, 3 AS n_points FROM shade WHERE hhmm = '10:30'"""

ORACLES["attach_fixes"] = _with(SEGMENT, FIX) + f"""
, pair AS (SELECT f.event_id, f.x, f.y, s.*, {_near("f", "s")} AS t FROM fix f, strip0 s),
dist AS (SELECT *, {_pair("pair", "pair")} AS d FROM pair),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ord, p) AS k FROM dist)
SELECT event_id, i, round(off_ + t * len, 3) AS projection_m, round(whole - (off_ + t * len), 3) AS rest_m, round(d, 3) AS distance_m FROM best WHERE k = 1"""

ORACLES["match_candidates"] = _with(SEGMENT, FIX) + f"""
, pair AS (SELECT f.event_id, f.x, f.y, least(25, greatest(12, 2 * precision_m)) AS reach, s.*, {_near("f", "s")} AS t FROM fix f, strip0 s),
dist AS (SELECT *, {_pair("pair", "pair")} AS d FROM pair)
SELECT event_id, count(*) AS n, round(min(d), 3) AS d_min, round(max(d), 3) AS d_max FROM dist WHERE d <= reach GROUP BY 1"""

ORACLES["followed_streets"] = _with(SEGMENT, FIX) + f"""
, place AS (SELECT DISTINCT i, floor(x / 50) AS cx, floor(y / 50) AS cy FROM (
  SELECT i, x0 AS x, y0 AS y FROM seg UNION ALL SELECT i, x1, y1 FROM seg UNION ALL SELECT i, x2, y2 FROM seg)),
met AS (SELECT DISTINCT f.event_id, f.x, f.y, p.i FROM fix f JOIN place p ON abs(floor(f.x / 50) - p.cx) <= 1 AND abs(floor(f.y / 50) - p.cy) <= 1),
pair AS (SELECT m.event_id, m.x, m.y, s.*, {_near("m", "s")} AS t FROM met m JOIN strip0 s USING (i)),
dist AS (SELECT event_id, i, rue, cote, ord, min({_pair("pair", "pair")}) AS d FROM pair GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ord) AS k, min(CASE WHEN rue = 'Rue H' || (event_id % 6) THEN d END) OVER (PARTITION BY event_id) AS de FROM dist)
SELECT event_id, i, rue, cote, round(d, 3) AS d, round(de, 3) AS d_expected FROM best WHERE k = 1"""

ORACLES["facing_sides"] = _with(SEGMENT) + f"""
, way AS (SELECT *, sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2) AS n FROM seg WHERE rue IS NOT NULL),
cand AS (
  SELECT a.i, c.i AS ci, c.cote AS ccote, a.x1 AS x, a.y1 AS y FROM way a JOIN way c ON a.rue = c.rue AND a.cote <> c.cote
  WHERE abs(((a.x2 - a.x0) * (c.x2 - c.x0) + (a.y2 - a.y0) * (c.y2 - c.y0)) / (a.n * c.n)) >= cos(radians(35))
    AND (c.x1 - a.x1) * (CASE a.cote WHEN 'est' THEN 1 WHEN 'ouest' THEN -1 ELSE 0 END) + (c.y1 - a.y1) * (CASE a.cote WHEN 'nord' THEN 1 WHEN 'sud' THEN -1 ELSE 0 END) <= 0),
pair AS (SELECT m.i AS own, m.ccote, m.x, m.y, s.*, {_near("m", "s")} AS t FROM cand m JOIN strip0 s ON s.i = m.ci),
dist AS (SELECT own, i, ccote, ord, min({_pair("pair", "pair")}) AS d FROM pair GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY d, ord) AS k FROM dist WHERE d <= 30)
SELECT own AS i, i AS i_face, ccote AS cote_face, round(d, 3) AS distance_m FROM best WHERE k = 1"""

ORACLES["near_segments"] = _with(NODE, SEGMENT) + """
, box AS (SELECT min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM node WHERE nid < 3)
SELECT i, rue FROM seg, box WHERE x1 BETWEEN xa - 40 AND xb + 40 AND y1 BETWEEN ya - 40 AND yb + 40"""

ORACLES["edge_costs"] = _with(SEGMENT, CROSSING, SHADE) + """
, e AS (
  SELECT lo, hi, j, l, CASE WHEN kind = 'trottoir' AND val <> 255 THEN 1 - val / 100.0::DOUBLE ELSE 0 END AS sun,
         CASE WHEN kind = 'traversee' THEN CASE WHEN src = 'osm_crossing' THEN 15 ELSE 30 END ELSE 0 END AS fix
  FROM edge LEFT JOIN shade USING (i))
SELECT lo, hi, j, round(l * (1 + sun) + fix, 6) AS cout_1, round(l * (1 + 4 * sun) + 0.5 * fix, 6) AS cout_4 FROM e"""

ORACLES["passage_steps"] = _with(SEGMENT, REQUEST) + f"""
, q AS (SELECT route_id, {x93("dep_lon", "dep_lat")} AS x, {y93("dep_lon", "dep_lat")} AS y FROM request)
SELECT route_id, i, CAST(least(40 + floor(40 * sqrt(((x0 + x2) / 2 - x) ** 2 + ((y0 + y2) / 2 - y) ** 2) / 1.3 / 900), 47) AS INT) AS pas
FROM q, seg"""

#: Bellman-Ford on every rung of every request at once; a row's figures are those of its cheapest path.
ORACLES["route_summary"] = (
    "WITH RECURSIVE "
    + ",".join((NODE, SEGMENT, CROSSING, SHADE, REQUEST))
    + f"""
, pt AS (
  SELECT route_id, 'd' AS w, {x93("dep_lon", "dep_lat")} AS x, {y93("dep_lon", "dep_lat")} AS y FROM request
  UNION ALL SELECT route_id, 'a', {x93("arr_lon", "arr_lat")}, {y93("arr_lon", "arr_lat")} FROM request),
pair AS (SELECT f.route_id, f.w, f.x, f.y, s.*, {_near("f", "s")} AS t FROM pt f, strip0 s),
dist AS (SELECT *, {_pair("pair", "pair")} AS d, off_ + t * len AS proj, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM pair),
att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, w ORDER BY d, ord, p) AS n FROM dist) WHERE n = 1),
ready AS (
  SELECT q.route_id, q.k, q.by_passage, d.i AS di, d.a AS da, d.b AS db, d.proj AS dp, d.whole - d.proj AS dr, d.px, d.py, a.i AS ai, a.a AS aa, a.b AS ab, a.proj AS ap, a.whole - a.proj AS ar,
         (CAST(split_part(heure, ':', 1) AS INT) * 60 + CAST(split_part(heure, ':', 2) AS INT) // 15 * 15 - 420) // 15 AS j0
  FROM request q JOIN att d ON d.route_id = q.route_id AND d.w = 'd' JOIN att a ON a.route_id = q.route_id AND a.w = 'a'),
rung AS (SELECT route_id, 0 AS n, 0.0::DOUBLE AS k FROM ready UNION ALL
         SELECT route_id, r.range + 1, k / 2.0 ** r.range FROM ready, range(5) r WHERE k > 0 AND (r.range = 0 OR k / 2.0 ** r.range >= 0.25)),
ways AS (SELECT lo AS u, hi AS v, e.* FROM edge e UNION ALL SELECT hi, lo, e.* FROM edge e),
mid AS (SELECT w.*, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my FROM ways w JOIN node p ON p.nid = w.lo JOIN node q ON q.nid = w.hi),
links AS (
  SELECT route_id, u, v, l, i, CASE WHEN kind = 'traversee' THEN 1 ELSE 0 END AS crossed,
         CASE WHEN kind = 'traversee' THEN CASE WHEN src = 'osm_crossing' THEN 15 ELSE 30 END ELSE 0 END AS fix,
         CASE WHEN by_passage THEN least(j0 + CAST(floor(sqrt((mx - px) ** 2 + (my - py) ** 2) / 1.3 / 900) AS INT), 47) ELSE j0 END AS j
  FROM mid, ready),
sunny AS (
  SELECT route_id, u, v, l, crossed, fix, CASE WHEN links.i IS NULL OR val = 255 THEN 0 ELSE 1 - val / 100.0::DOUBLE END AS sun, links.i IS NOT NULL AS walk
  FROM links LEFT JOIN shade ON shade.i = links.i AND shade.j = links.j
  UNION ALL SELECT route_id, -1, da, dp, 0, 0, 0, false FROM ready UNION ALL SELECT route_id, -1, db, dr, 0, 0, 0, false FROM ready
  UNION ALL SELECT route_id, aa, -2, ap, 0, 0, 0, false FROM ready UNION ALL SELECT route_id, ab, -2, ar, 0, 0, 0, false FROM ready
  UNION ALL SELECT route_id, -1, -2, abs(dp - ap), 0, 0, 0, false FROM ready WHERE di = ai),
p(route_id, n, node, cost, dist, sun_m, shade_m, rest_m, crossed) USING KEY (route_id, n, node) AS (
  SELECT route_id, n, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(0 AS BIGINT) FROM rung
  UNION
  SELECT route_id, n, v, f.cost, f.dist, f.sun_m, f.shade_m, f.rest_m, f.crossed FROM (
    SELECT c.route_id, c.n, c.v, min(STRUCT_PACK(cost := c.cost, dist := c.dist, sun_m := c.sun_m, shade_m := c.shade_m, rest_m := c.rest_m, crossed := c.crossed)) AS f FROM (
      SELECT p.route_id, p.n, s.v, p.cost + s.l * (1 + rung.k * s.sun) + s.fix AS cost, p.dist + s.l AS dist, p.sun_m + CASE WHEN walk THEN s.l * s.sun ELSE 0 END AS sun_m,
             p.shade_m + CASE WHEN walk THEN s.l * (1 - s.sun) ELSE 0 END AS shade_m, p.rest_m + CASE WHEN walk THEN 0 ELSE s.l END AS rest_m, p.crossed + s.crossed AS crossed
      FROM p JOIN rung ON rung.route_id = p.route_id AND rung.n = p.n JOIN sunny s ON s.route_id = p.route_id AND s.u = p.node WHERE p.node <> -2) c
    LEFT JOIN recurring.p AS q ON q.route_id = c.route_id AND q.n = c.n AND q.node = c.v
    WHERE q.cost IS NULL OR c.cost < q.cost - 1e-9 GROUP BY c.route_id, c.n, c.v)),
fin AS (SELECT p.*, rung.k FROM p JOIN rung USING (route_id, n) WHERE node = -2),
base AS (SELECT route_id, dist AS base_m FROM fin WHERE n = 0),
pick AS (
  SELECT fin.*, base_m, row_number() OVER (PARTITION BY route_id ORDER BY CASE WHEN n > 0 AND dist <= 1.1::DOUBLE * base_m THEN n ELSE 100 END, n) AS r
  FROM fin JOIN base USING (route_id) WHERE n = 0 OR dist <= 1.1::DOUBLE * base_m)
SELECT q.route_id, r.route_id IS NOT NULL AS reachable, coalesce(r.k, 0.0::DOUBLE) AS k_effectif, coalesce(q.k > 0 AND r.n <> 1, false) AS plafonne, round(base_m, 3) AS base_m, round(dist, 3) AS distance_m,
       round(cost, 3) AS cout_pondere, round(shade_m, 3) AS distance_ombre_m, round(sun_m, 3) AS distance_soleil_m, round(rest_m, 3) AS distance_non_evaluee_m, r.crossed AS nb_traversees
FROM request q LEFT JOIN pick r ON r.route_id = q.route_id AND r.r = 1"""
)

ORACLES["all_costs"] = (
    "WITH RECURSIVE "
    + ",".join((SEGMENT, CROSSING))
    + """
, links AS (
  SELECT lo AS u, hi AS v, l + CASE WHEN kind = 'traversee' THEN CASE WHEN src = 'osm_crossing' THEN 15 ELSE 30 END ELSE 0 END AS cost FROM edge
  UNION ALL SELECT hi, lo, l + CASE WHEN kind = 'traversee' THEN CASE WHEN src = 'osm_crossing' THEN 15 ELSE 30 END ELSE 0 END FROM edge),
p(source, node, cost) USING KEY (source, node) AS (
  SELECT range, range, 0.0::DOUBLE FROM range(144)
  UNION
  SELECT p.source, l.v, min(p.cost + l.cost) FROM p JOIN links l ON l.u = p.node LEFT JOIN recurring.p AS q ON q.source = p.source AND q.node = l.v
  WHERE q.cost IS NULL OR p.cost + l.cost < q.cost - 1e-9 GROUP BY p.source, l.v)
SELECT source, node, round(cost, 3) AS cost FROM p"""
)

WALK = f"""
w0 AS (SELECT c_custkey AS route_id, c_custkey % 4 AS r0, (c_custkey // 4) % 4 AS c0, 4 + c_custkey % 5 AS n FROM customer),
w1 AS (SELECT w0.*, unnest(generate_series(0, n + 1)) AS seq FROM w0),
w2 AS (SELECT *, ((seq - 1) % 5 + 5) % 5 AS part, CAST(floor((seq - 1) / 5.0) AS BIGINT) AS whole, seq > 0 AND seq <= n AS inside FROM w1),
w3 AS (SELECT *, r0 + whole * 3 + CASE part WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS r, c0 + whole * 3 + CASE WHEN part >= 2 THEN 2 WHEN part = 1 THEN 1 ELSE 0 END AS c FROM w2),
w4 AS (SELECT *, r * 12 + c AS spot_, inside AND part = 4 AS crossing_, 8 + route_id % 30 AS step FROM w3),
path AS (
  SELECT route_id, seq, CASE WHEN seq = 0 THEN -1 ELSE spot_ END AS de,
         CASE WHEN seq = 0 THEN r0 * 12 + c0 WHEN seq > n THEN -2 WHEN part < 2 THEN spot_ + 1 WHEN part < 4 THEN spot_ + 12 ELSE spot_ + 13 END AS vers,
         CASE WHEN crossing_ THEN 'traversee' WHEN inside THEN 'trottoir' ELSE 'attache' END AS kind,
         CASE WHEN inside AND NOT crossing_ THEN CAST(CASE WHEN part < 2 THEN r * 11 + c ELSE 132 + spot_ END AS INT) END AS i,
         CASE WHEN crossing_ THEN CASE WHEN route_id % 2 = 0 THEN 'osm_crossing' ELSE 'carrefour' END END AS src, CAST(step AS INT) AS step
  FROM w4),
pathl AS (
  SELECT *, CASE WHEN kind = 'traversee' THEN 14.0::DOUBLE WHEN i IS NOT NULL THEN 10 + ((i * 7919) % 997) / 997.0::DOUBLE ELSE 1.5::DOUBLE + route_id % 3 END AS l,
         CASE WHEN i IS NOT NULL THEN CASE WHEN (i + step) % 23 = 0 THEN 255 ELSE (17 * i + 31 * step) % 101 END END AS val FROM path),
spot0 AS (
  SELECT p.route_id, p.seq, p.kind, p.i, p.src, p.step,
         CASE WHEN de = -1 THEN {_lon("vers")} - 2e-5 ELSE {_lon("de")} END AS lon0, CASE WHEN de = -1 THEN {_lat("vers")} ELSE {_lat("de")} END AS lat0,
         CASE WHEN vers = -2 THEN {_lon("de")} + 2e-5 ELSE {_lon("vers")} END AS lon2, CASE WHEN vers = -2 THEN {_lat("de")} ELSE {_lat("vers")} END AS lat2, s.lon1, s.lat1, s.rue, s.cote
  FROM path p LEFT JOIN segment s USING (i)),
spot1 AS (
  SELECT route_id, seq, 0 AS pos, lon0 AS lon, lat0 AS lat FROM spot0 UNION ALL SELECT route_id, seq, 1, lon1, lat1 FROM spot0 WHERE i IS NOT NULL
  UNION ALL SELECT route_id, seq, 2, lon2, lat2 FROM spot0),
spot2 AS (SELECT *, {x93("lon", "lat")} AS x, {y93("lon", "lat")} AS y FROM spot1),
spot3 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0::DOUBLE) AS d, coalesce(lon = lag(lon) OVER w AND lat = lag(lat) OVER w, false) AS again FROM spot2 WINDOW w AS (PARTITION BY route_id ORDER BY seq, pos)),
spot AS (SELECT *, sum(CASE WHEN again THEN 0.0::DOUBLE ELSE d END) OVER (PARTITION BY route_id ORDER BY seq, pos) AS s FROM spot3),
stage0 AS (SELECT route_id, seq, max(s) AS s1 FROM spot GROUP BY 1, 2),
stage AS (
  SELECT t.route_id, t.seq, coalesce(lag(t.s1) OVER (PARTITION BY t.route_id ORDER BY t.seq), 0.0::DOUBLE) AS s0, t.s1, CASE WHEN p.kind = 'attache' THEN 'liaison' ELSE p.kind END AS kind, p.rue, p.cote, p.src AS source, p.i, p.step
  FROM stage0 t JOIN spot0 p USING (route_id, seq)),
total AS (SELECT route_id, max(s1) AS longueur FROM stage GROUP BY 1),
place AS (SELECT route_id, longueur, range AS tenth, longueur * range / 10 AS s FROM total, range(1, 10))"""

ORACLES["stage_table"] = _with(SEGMENT, WALK) + "SELECT route_id, CAST(seq AS INT) AS seq, round(s0, 3) AS s0, round(s1, 3) AS s1, kind, rue, cote, source, i FROM stage"


def _at(s: str, name: str) -> str:
    """CTEs: the position at distance `s` of each place."""
    return f"""
{name}_k AS (SELECT p.route_id, p.tenth, p.s, greatest(0, least(p.longueur, {s})) AS q FROM place p),
{name}_b AS (
  SELECT k.*, lon, lat, x.s AS sx, lag(lon) OVER w AS lon_, lag(lat) OVER w AS lat_, lag(x.s) OVER w AS s_
  FROM {name}_k k JOIN spot x ON x.route_id = k.route_id AND NOT x.again WINDOW w AS (PARTITION BY k.route_id, k.tenth ORDER BY x.seq, x.pos)),
{name} AS (
  SELECT route_id, tenth, lon_ + (lon - lon_) * r AS lon, lat_ + (lat - lat_) * r AS lat FROM (
    SELECT *, CASE WHEN sx > s_ THEN (q - s_) / (sx - s_) ELSE 0 END AS r, row_number() OVER (PARTITION BY route_id, tenth ORDER BY sx) AS n
    FROM {name}_b WHERE s_ IS NOT NULL AND sx >= q) WHERE n = 1)"""


ORACLES["places_on_trace"] = _with(SEGMENT, WALK, _at("p.s", "here")) + """
SELECT p.route_id, round(p.s, 3) AS s, round(h.lon, 6) AS lon, round(h.lat, 6) AS lat FROM place p JOIN here h USING (route_id, tenth)"""

PLANNED = """
named AS (SELECT p.*, s.rue, s.cote, CASE WHEN (p.i * p.step) % 7 = 0 THEN 1 ELSE 0 END AS low FROM pathl p LEFT JOIN segment s USING (i)),
solid AS (SELECT *, lag(CASE WHEN kind = 'trottoir' THEN coalesce(rue, 'null') || '|' || coalesce(cote, 'null') ELSE 'x' || seq END) OVER (PARTITION BY route_id ORDER BY seq) AS prev,
                 CASE WHEN kind = 'trottoir' THEN coalesce(rue, 'null') || '|' || coalesce(cote, 'null') ELSE 'x' || seq END AS key FROM named WHERE kind <> 'attache'),
told AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM key THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY seq) AS n FROM solid)"""

ORACLES["planner_instructions"] = _with(SEGMENT, WALK, PLANNED) + """
, ends AS (
  SELECT a.route_id, a.seq, a.l, (SELECT max(t.n) FROM told t WHERE t.route_id = a.route_id) AS last_n,
         (SELECT arg_max(t.kind, t.seq) FROM told t WHERE t.route_id = a.route_id AND t.seq < a.seq) AS before,
         (SELECT arg_max(t.n, t.seq) FROM told t WHERE t.route_id = a.route_id AND t.seq < a.seq) AS before_n,
         (SELECT min(t.n) FROM told t WHERE t.route_id = a.route_id AND t.seq > a.seq AND t.kind = 'trottoir') AS next_n
  FROM named a WHERE a.kind = 'attache'),
extra AS (
  SELECT route_id, CASE WHEN before = 'trottoir' THEN before_n ELSE coalesce(next_n, last_n) END AS n, sum(CASE WHEN before = 'trottoir' OR next_n IS NOT NULL THEN l ELSE 0 END) AS plus,
         sum(CASE WHEN before = 'trottoir' OR next_n IS NOT NULL THEN 0 ELSE l END) AS tail FROM ends GROUP BY 1, 2),
g AS (
  SELECT route_id, n, any_value(kind) AS kind, any_value(rue) AS rue, any_value(cote) AS cote, any_value(src) AS src, sum(l) AS m,
         sum(CASE WHEN val <> 255 THEN l * val / 100.0::DOUBLE ELSE 0 END) AS dark, sum(CASE WHEN val <> 255 THEN l - l * val / 100.0::DOUBLE ELSE 0 END) AS bright,
         coalesce(bool_or(val = 255), false) AS ind, coalesce(bool_or(kind = 'trottoir' AND low = 1), false) AS weak FROM told GROUP BY 1, 2)
SELECT g.route_id, n, CASE WHEN kind = 'traversee' THEN 'traversee' ELSE 'marche' END AS type,
       CASE WHEN kind = 'traversee' THEN CASE WHEN src = 'osm_crossing' THEN 'Traverser au passage pieton' ELSE 'Traverser au carrefour' END
            ELSE coalesce(rue, 'trottoir sans nom') || ', cote ' || cote END AS texte,
       CAST(floor(m + coalesce(plus, 0) + 0.5) + floor(coalesce(tail, 0) + 0.5) AS BIGINT) AS distance_m,
       CASE WHEN kind = 'trottoir' AND dark + bright > 0 THEN CAST(floor(100 * dark / (dark + bright) + 0.5) AS BIGINT) END AS pct_ombre, ind AS indetermine, weak AS confiance_faible
FROM g LEFT JOIN extra USING (route_id, n)"""

GUIDED = """
firm AS (SELECT *, CASE WHEN kind = 'trottoir' THEN coalesce(rue, 'null') || '|' || coalesce(cote, 'null') ELSE 'x' || seq END AS key FROM stage WHERE kind <> 'liaison'),
firm2 AS (SELECT *, CASE WHEN lag(key) OVER w IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS fresh FROM firm WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
firm3 AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY seq) AS n FROM firm2),
bound AS (
  SELECT l.route_id, l.s0, l.s1,
         CASE WHEN (SELECT arg_max(f.kind, f.seq) FROM firm3 f WHERE f.route_id = l.route_id AND f.seq < l.seq) = 'trottoir' THEN (SELECT max(f.n) FROM firm3 f WHERE f.route_id = l.route_id AND f.seq < l.seq)
              ELSE coalesce((SELECT min(f.n) FROM firm3 f WHERE f.route_id = l.route_id AND f.seq > l.seq), (SELECT max(f.n) FROM firm3 f WHERE f.route_id = l.route_id)) END AS n
  FROM stage l WHERE l.kind = 'liaison'),
instr AS (
  SELECT route_id, n, max(type) AS type, max(rue) AS rue, max(cote) AS cote, max(source) AS source, min(s0) AS s0, max(s1) AS s1 FROM (
    SELECT route_id, n, CASE WHEN kind = 'trottoir' THEN 'marche' ELSE kind END AS type, rue, cote, source, s0, s1 FROM firm3
    UNION ALL SELECT route_id, n, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), s0, s1 FROM bound) GROUP BY 1, 2),
said AS (
  SELECT *, s1 - s0 AS longueur_m, CASE WHEN type = 'traversee' THEN CASE WHEN source = 'osm_crossing' THEN 'Traverser au passage pieton' ELSE 'Traverser au carrefour' END
            ELSE coalesce(rue, 'trottoir sans nom') || coalesce(', cote ' || cote, '') END AS texte FROM instr)"""

ORACLES["guidance_instructions"] = _with(SEGMENT, WALK, GUIDED) + """
SELECT route_id, n, type, texte, round(s0, 3) AS s0, round(s1, 3) AS s1, round(longueur_m, 3) AS longueur_m FROM said"""

ORACLES["merged_instructions"] = _with(SEGMENT, WALK, GUIDED) + """
, k AS (SELECT *, NOT (type = 'marche' AND longueur_m < 12) AS long_, count(*) OVER w AS total, sum(CASE WHEN type = 'marche' AND longueur_m < 12 THEN 0 ELSE 1 END) OVER w AS n_long, max(n) OVER w AS last_n FROM said WINDOW w AS (PARTITION BY route_id)),
kept AS (SELECT *, long_ OR (n_long = 0 AND n = last_n) AS keep FROM k),
num AS (SELECT *, greatest(1, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY n)) AS g FROM kept)
SELECT route_id, g AS n, max(CASE WHEN keep THEN type END) AS type, max(CASE WHEN keep THEN texte END) AS texte, round(min(s0), 3) AS s0, round(max(s1), 3) AS s1 FROM num GROUP BY 1, 2"""

ORACLES["stage_lookup"] = _with(SEGMENT, WALK) + """
, hit AS (SELECT p.route_id, p.tenth, p.s, min(t.seq) AS seq FROM place p JOIN stage t ON t.route_id = p.route_id AND p.s >= t.s0 AND p.s <= t.s1 GROUP BY ALL),
side AS (
  SELECT h.*, coalesce((SELECT min(t.seq) FROM stage t WHERE t.route_id = h.route_id AND t.seq >= h.seq AND t.kind = 'trottoir'),
                       (SELECT max(t.seq) FROM stage t WHERE t.route_id = h.route_id AND t.seq <= h.seq AND t.kind = 'trottoir')) AS w FROM hit h)
SELECT s.route_id, round(s.s, 3) AS s, CAST(s.seq AS INT) AS seq, a.kind, b.i, b.rue, b.cote
FROM side s JOIN stage a ON a.route_id = s.route_id AND a.seq = s.seq LEFT JOIN stage b ON b.route_id = s.route_id AND b.seq = s.w"""

ORACLES["instruction_lookup"] = _with(SEGMENT, WALK, GUIDED) + """
SELECT p.route_id, round(p.s, 3) AS s, x.n, x.texte, round(greatest(0, x.s1 - p.s), 3) AS reste, CASE WHEN x.s1 - p.s <= 25 THEN y.texte END AS annonce, round(least(1.0::DOUBLE, p.s / p.longueur), 6) AS progression
FROM place p JOIN said x ON x.route_id = p.route_id AND p.s >= x.s0 AND p.s < x.s1 LEFT JOIN said y ON y.route_id = p.route_id AND y.n = x.n + 1"""

FACE = f"""
way AS (SELECT *, sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2) AS n FROM seg WHERE rue IS NOT NULL),
cand AS (
  SELECT a.i, c.i AS ci, a.x1 AS x, a.y1 AS y FROM way a JOIN way c ON a.rue = c.rue AND a.cote <> c.cote
  WHERE abs(((a.x2 - a.x0) * (c.x2 - c.x0) + (a.y2 - a.y0) * (c.y2 - c.y0)) / (a.n * c.n)) >= cos(radians(35))
    AND (c.x1 - a.x1) * (CASE a.cote WHEN 'est' THEN 1 WHEN 'ouest' THEN -1 ELSE 0 END) + (c.y1 - a.y1) * (CASE a.cote WHEN 'nord' THEN 1 WHEN 'sud' THEN -1 ELSE 0 END) <= 0),
fpair AS (SELECT m.i AS own, m.x, m.y, s.*, {_near("m", "s")} AS t FROM cand m JOIN strip0 s ON s.i = m.ci),
fdist AS (SELECT own, i, ord, min({_pair("fpair", "fpair")}) AS d FROM fpair GROUP BY ALL),
face AS (SELECT own AS i, i AS i_face, d AS face_m FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY d, ord) AS k FROM fdist WHERE d <= 30) WHERE k = 1)"""


def _shaded(step_of_face: str) -> str:
    """CTE: stages with shade of both sides."""
    return f"""
lit AS (
  SELECT t.*, CASE WHEN a.val <> 255 THEN a.val / 100.0::DOUBLE END AS o, f.i_face, f.face_m, CASE WHEN b.val <> 255 THEN b.val / 100.0::DOUBLE END AS o_face
  FROM stage t LEFT JOIN shade a ON a.i = t.i AND a.j = t.step LEFT JOIN face f ON f.i = t.i LEFT JOIN shade b ON b.i = f.i_face AND b.j = {step_of_face})"""


BAND = """
span AS (SELECT p.route_id, p.tenth, p.s, least(p.longueur, p.s + h) AS fin, h FROM {places}),
band AS (
  SELECT b.route_id, b.tenth, b.s, t.seq, greatest(t.s0, b.s) AS d0, least(t.s1, b.fin) AS d1, t.kind, t.o, t.o_face, t.kind = 'trottoir' AS known, t.kind = 'trottoir' AND t.i_face IS NOT NULL AS known_face
  FROM span b JOIN lit t ON t.route_id = b.route_id AND t.s1 > b.s AND t.s0 < b.fin WHERE least(t.s1, b.fin) > greatest(t.s0, b.s))"""

ORACLES["shade_bands"] = _with(SEGMENT, SHADE, WALK, FACE, _shaded("t.step"), BAND.format(places="(SELECT *, 60.0::DOUBLE AS h FROM place) p")) + """
SELECT route_id, round(s, 3) AS s, CAST(seq AS INT) AS seq, round(d0, 3) AS d0, round(d1, 3) AS d1, kind, o, o_face, known, known_face FROM band"""

NEXT = "(SELECT min(t.s0) FROM stage t WHERE t.route_id = p.route_id AND t.kind = 'traversee' AND t.s0 > p.s)"
MEANS = """
means AS (
  SELECT route_id, tenth, CASE WHEN sum(CASE WHEN known THEN d1 - d0 ELSE 0 END) >= 0.5 * sum(d1 - d0) THEN sum(CASE WHEN known THEN coalesce(o, 1.0::DOUBLE) * (d1 - d0) ELSE 0 END) / sum(CASE WHEN known THEN d1 - d0 ELSE 0 END) END AS own,
         CASE WHEN sum(CASE WHEN known_face THEN d1 - d0 ELSE 0 END) >= 0.5 * sum(d1 - d0) THEN sum(CASE WHEN known_face THEN coalesce(o_face, 1.0::DOUBLE) * (d1 - d0) ELSE 0 END) / sum(CASE WHEN known_face THEN d1 - d0 ELSE 0 END) END AS other
  FROM band GROUP BY 1, 2)"""

ORACLES["shade_contrast"] = _with(
    SEGMENT, SHADE, WALK, FACE, _shaded("t.step"),
    f"\nasked AS (SELECT p.*, least(50.0::DOUBLE, coalesce({NEXT} - p.s, 50.0::DOUBLE)) AS h FROM place p)", BAND.format(places="(SELECT * FROM asked WHERE h >= 15) p"), MEANS,
) + """
SELECT a.route_id, round(a.s, 3) AS s, round(a.h, 3) AS horizon, round(own, 3) AS ombre_suivi, round(other, 3) AS ombre_en_face, coalesce(other - own > 0.3::DOUBLE, false) AS actif
FROM asked a LEFT JOIN means USING (route_id, tenth)"""  # fmt: skip

ORACLES["contrast_after_crossing"] = _with(
    SEGMENT, SHADE, WALK, FACE, _shaded("t.step"),
    """
first_ AS (SELECT p.route_id, p.tenth, p.s AS s_, p.longueur, c.s0 AS c0, c.s1 AS c1, row_number() OVER (PARTITION BY p.route_id, p.tenth ORDER BY c.seq) AS k
  FROM place p LEFT JOIN stage c ON c.route_id = p.route_id AND c.kind = 'traversee' AND c.s1 > p.s),
there AS (SELECT *, coalesce(c1 + 0.01::DOUBLE, s_) AS s FROM first_ WHERE k = 1)""",
    f"\nasked AS (SELECT p.*, least(50.0::DOUBLE, coalesce({NEXT} - p.s, 50.0::DOUBLE)) AS h FROM there p)", BAND.format(places="(SELECT * FROM asked WHERE h >= 15) p"), MEANS,
) + """
SELECT a.route_id, round(a.s_, 3) AS s, round(c0, 3) AS traversee_s0, CASE WHEN c0 IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0, c0 - s_), 3) END AS distance_m, round(own, 3) AS ombre_suivi, round(other, 3) AS ombre_en_face, coalesce(other - own > 0.3::DOUBLE, false) AS actif
FROM asked a LEFT JOIN means USING (route_id, tenth)"""  # fmt: skip

ORACLES["street_shade"] = _with(SEGMENT, SHADE, WALK, FACE, _shaded("t.step")) + """
, b AS (SELECT route_id, CASE WHEN kind = 'trottoir' THEN s1 - s0 ELSE 0 END AS m, coalesce(o, 1.0::DOUBLE) AS own, CASE WHEN face_m <= 12 THEN greatest(coalesce(o, 1.0::DOUBLE), coalesce(o_face, 1.0::DOUBLE)) ELSE coalesce(o, 1.0::DOUBLE) END AS best FROM lit)
SELECT route_id, CASE WHEN sum(m) > 0 THEN CAST(floor(100 * sum(m * best) / sum(m) + 0.5) AS BIGINT) END AS pct_rue, CASE WHEN sum(m) > 0 THEN CAST(floor(100 * sum(m * own) / sum(m) + 0.5) AS BIGINT) END AS pct_cote FROM b GROUP BY 1"""

ORACLES["street_lines"] = _with(SEGMENT, SHADE, WALK, FACE, _shaded("t.step")) + """
, b AS (SELECT *, CASE WHEN face_m <= 12 THEN greatest(coalesce(o, 1.0::DOUBLE), coalesce(o_face, 1.0::DOUBLE)) ELSE coalesce(o, 1.0::DOUBLE) END AS best FROM lit)
SELECT route_id, CAST(seq AS INT) AS seq, CASE WHEN kind <> 'trottoir' THEN kind WHEN best >= 0.5 THEN 'ombre' ELSE 'soleil' END AS classe, CAST(ceil((s1 - s0) / 2) + 1 AS INT) AS n_points FROM b WHERE s1 > s0"""

ORACLES["headings"] = """
WITH e AS (SELECT event_id, CAST((event_id * 37) % 1080 - 540 AS DOUBLE) AS a, CAST((event_id * 101) % 1080 - 540 AS DOUBLE) AS b FROM events),
d AS (SELECT *, ((b - a) - 360 * trunc((b - a) / 360)) AS m FROM e), g AS (SELECT *, CASE WHEN m > 180 THEN m - 360 WHEN m <= -180 THEN m + 360 ELSE m END AS ecart, ((b - a + 540) - 360 * trunc((b - a + 540) / 360)) - 180 AS t FROM d)
SELECT event_id, ecart, least(abs(ecart), 180 - abs(ecart)) AS axe, CASE WHEN abs(t) >= 150 THEN 'demi-tour' WHEN abs(t) < 30 THEN 'tout droit' WHEN t > 0 THEN 'droite' ELSE 'gauche' END AS direction FROM g"""

ORACLES["local_frame"] = _with(FIX) + """
SELECT event_id, round((lon - 2.35) * radians(6371008.8) * cos(radians(48.86)), 3) AS x, round((lat - 48.86) * radians(6371008.8), 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat, 11 AS n_cone FROM fix"""

_M = 1 << 32


def _mul(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % {_M} AS BIGINT)"


def _draw(k: str, name: str) -> str:
    s1 = f"SELECT *, (graine + ({k}) * 1831565813) % {_M} AS a FROM prev_{name}"
    s2 = f"SELECT *, {_mul('xor(a, a >> 15)', 'a | 1')} AS t1 FROM ({s1})"
    s3 = f"SELECT *, xor((t1 + {_mul('xor(t1, t1 >> 7)', 't1 | 61')}) % {_M}, t1) AS t2 FROM ({s2})"
    return f"{name}_ AS (SELECT * EXCLUDE (a, t1, t2), xor(t2, t2 >> 14) / 4294967296.0::DOUBLE AS {name} FROM ({s3}))"


ORACLES["random_draws"] = (
    "WITH prev_u AS (SELECT c_custkey AS graine, c_custkey % 50 + 1 AS k FROM customer), "
    + _draw("k", "u") + ", prev_v AS (SELECT * FROM u_), " + _draw("k + 1", "v")
    + " SELECT graine, k, round(u, 12) AS u, CASE WHEN u > 0 AND v > 0 THEN round(sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) END AS normale FROM v_"
)

ORACLES["short_dates"] = """
SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || (['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'])[month(o_orderdate)] AS date_courte FROM orders"""

ORACLES["point_to_line"] = _with(SEGMENT, FIX) + f"""
, pair AS (SELECT f.event_id, f.x, f.y, s.*, {_near("f", "s")} AS t FROM fix f, strip0 s WHERE s.i = 133)
SELECT event_id, round(min({_pair("pair", "pair")}), 3) AS d, round(max(whole), 3) AS longueur FROM pair GROUP BY 1"""

ORACLES["heading_drift"] = _with(FIX) + """
, o AS (SELECT a.event_id, a.walk_id, a.t_ms, a.x, a.y, a.value, count(*) OVER w AS n, first_value(a.x) OVER w AS x0, first_value(a.y) OVER w AS y0, avg(a.value) OVER d AS m, count(*) OVER d AS nd
  FROM fix a WINDOW w AS (PARTITION BY walk_id ORDER BY t_ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW), d AS (PARTITION BY walk_id ORDER BY t_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS dep FROM o)
SELECT event_id, CASE WHEN n >= 2 AND dep >= 12 THEN round(dep, 3) END AS deplacement_m, CASE WHEN n >= 2 AND dep >= 12 THEN round(degrees(atan2(x - x0, y - y0)), 3) END AS cap_reel, CASE WHEN nd >= 3 THEN round(m + 1e-7, 3) END AS moyenne FROM q"""

ORACLES["steady_deviation"] = _with(FIX) + """
, a AS (SELECT *, min(value) OVER (PARTITION BY walk_id ORDER BY t_ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW) >= 35 AS tous_devient,
         CASE WHEN lag(event_type) OVER (PARTITION BY walk_id ORDER BY t_ms) = event_type THEN 0 ELSE 1 END AS f FROM fix),
b AS (SELECT *, sum(f) OVER (PARTITION BY walk_id ORDER BY t_ms) AS run FROM a)
SELECT event_id, tous_devient, t_ms - min(t_ms) OVER (PARTITION BY walk_id, run) AS depuis_ms FROM b"""

ORACLES["visits"] = """
WITH g AS (SELECT user_id AS walk_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 21600 SECOND THEN 0 ELSE 1 END AS f FROM events),
r AS (SELECT *, sum(f) OVER (PARTITION BY walk_id ORDER BY ts) AS v FROM g)
SELECT walk_id, min(ts) AS debut, max(ts) AS fin, count(*) AS n FROM r GROUP BY walk_id, v"""

ORACLES["observation_confidence"] = _with(FIX) + """
SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (4 * greatest(3, precision_m) + 25 - value) / (2.5 * greatest(3, precision_m) + 15))), 9) AS confiance FROM fix"""

ORACLES["frozen_fixes"] = """
WITH f AS (SELECT event_id, user_id, ts, event_id // 300 AS here, first_value(event_id // 300) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f0 FROM events)
SELECT event_id, bool_or(here <> f0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS parti FROM f"""

ORACLES["completed_features"] = _with(SEGMENT, WALK) + """
SELECT p.route_id, round(p.s, 3) AS s, CAST(sum(CASE WHEN t.s1 <= p.s THEN 1 ELSE 0 END) AS BIGINT) AS n_fait FROM place p JOIN stage t USING (route_id) GROUP BY 1, 2"""

ORACLES["walk_journal"] = """
SELECT user_id AS walk_id, CAST(count(*) AS INT) AS n_points, CAST(count(*) FILTER (event_type = 'purchase') AS INT) AS n_evenements, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS somme_k FROM events GROUP BY 1"""

ORACLES["compass_headings"] = (
    "WITH RECURSIVE e AS (SELECT user_id AS walk_id, epoch_us(ts) // 1000 AS t_ms, CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 41 % 360 AS DOUBLE) WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN CAST((360 - event_id * 29 % 360) % 360 AS DOUBLE) END AS h FROM events)"
    ", n AS (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY t_ms) AS k FROM e WHERE h IS NOT NULL)"
    ", p AS (SELECT walk_id, k, t_ms, sin(radians(h)) AS x, cos(radians(h)) AS y FROM n WHERE k = 1 UNION ALL"
    " SELECT n.walk_id, n.k, n.t_ms, p.x + 0.35 * (sin(radians(h)) - p.x), p.y + 0.35 * (cos(radians(h)) - p.y) FROM p JOIN n ON n.walk_id = p.walk_id AND n.k = p.k + 1)"
    " SELECT walk_id, t_ms, round(CASE WHEN degrees(atan2(x, y)) < 0 THEN degrees(atan2(x, y)) + 360 ELSE degrees(atan2(x, y)) END, 3) AS cap, true AS emitted FROM p"
)

ORACLES["shape_last_wins"] = """
SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1"""

ORACLES["shape_anti_union"] = """
SELECT o_orderkey, 'vide' AS source FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT o_orderkey, 'grande' FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)"""

ORACLES["shape_islands"] = """
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY 1, 2"""

ORACLES["shape_as_of"] = """
SELECT e.event_id, p.event_id AS achat, p.value AS valeur FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"""

ORACLES["shape_totals"] = """
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS ouvert,
       count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS n_grandes FROM lineitem GROUP BY 1"""

ORACLES["shape_weighted_mean"] = """
SELECT l_suppkey, CASE WHEN sum(CASE WHEN l_quantity > 20 THEN l_extendedprice ELSE 0 END) >= 0.5 * sum(l_extendedprice)
  THEN round(sum(CASE WHEN l_quantity > 20 THEN l_discount * l_extendedprice ELSE 0 END) / sum(CASE WHEN l_quantity > 20 THEN l_extendedprice ELSE 0 END), 9) END AS moyenne FROM lineitem GROUP BY 1"""
