"""The registered queries in plain SQL (DuckDB dialect), written against the raw tables."""

from __future__ import annotations

from tocsin.fixtures import TERMS

ORACLE: dict[str, str] = {}


def hav(la1, lo1, la2, lo2) -> str:
    h = (f"(pow(sin(radians(({la2}) - ({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) "
         f"* pow(sin(radians(({lo2}) - ({lo1})) / 2), 2))")
    return f"(12742e0 * atan2(sqrt({h}), sqrt(1e0 - {h})))"


def azi(la1, lo1, la2, lo2) -> str:
    x = (f"degrees(atan2(sin(radians(({lo2}) - ({lo1}))) * cos(radians({la2})), "
         f"cos(radians({la1})) * sin(radians({la2})) - sin(radians({la1})) * cos(radians({la2})) "
         f"* cos(radians(({lo2}) - ({lo1})))))")
    return f"(CASE WHEN {x} < 0 THEN {x} + 360e0 ELSE {x} END)"


def tenth(x) -> str:
    return f"(round_even(({x}) * 10, 0) / 10e0)"


def tod(ts) -> str:
    return (f"CASE WHEN hour({ts}) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour({ts}) BETWEEN 12 AND 16 THEN 'Day' "
            f"WHEN hour({ts}) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END")


def max_km(t) -> str:
    return (f"(CASE {t} WHEN 'FPV' THEN 40e0 WHEN 'FpvFiberOptic' THEN 50e0 WHEN 'StrikeDrone' THEN 100e0 "
            f"WHEN 'Recon' THEN 25e0 WHEN 'RearDrone' THEN 150e0 WHEN 'Rocket' THEN 100e0 ELSE 40e0 END)")


def speed(t) -> str:
    return (f"(CASE {t} WHEN 'FPV' THEN 160e0 WHEN 'FpvFiberOptic' THEN 160e0 WHEN 'StrikeDrone' THEN 150e0 "
            f"WHEN 'Recon' THEN 80e0 WHEN 'RearDrone' THEN 200e0 WHEN 'Rocket' THEN 500e0 ELSE 160e0 END)")


def life(t, default) -> str:
    return (f"(CASE {t} WHEN 'FPV' THEN 30 WHEN 'FpvFiberOptic' THEN 40 WHEN 'StrikeDrone' THEN 60 "
            f"WHEN 'Recon' THEN 120 WHEN 'RearDrone' THEN 60 WHEN 'Rocket' THEN 15 ELSE {default} END)")


TYPE = "list_extract(['FPV','Recon','StrikeDrone','Rocket','Unknown'], ({}) % 5 + 1)"
MARK = "CASE event_type WHEN 'signup' THEN 'Watch' WHEN 'error' THEN 'Terminated' ELSE 'Active' END"

PLACES = """places AS (SELECT s_suppkey::BIGINT AS place_id, s_name AS name,
  49.5e0 + (s_suppkey * 37 % 200) / 100e0 AS lat, 36.5e0 + (s_suppkey * 53 % 250) / 100e0 AS lon FROM supplier)"""
POINTS = PLACES + f""",
points AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS incident_id,
  {TYPE.format('user_id')} AS type, ts, event_id, user_id, event_type, p.place_id, p.name AS place, p.lat, p.lon,
  {MARK} AS mark
  FROM events e JOIN places p ON p.place_id = (e.event_id * 17) % (SELECT count(*) FROM supplier))"""
STEPS = POINTS + """,
steps AS (SELECT *, lag(place) OVER w AS pplace, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
  lag(ts) OVER w AS pts, row_number() OVER wd AS rd FROM points
  WINDOW w AS (PARTITION BY incident_id ORDER BY ts, event_id),
         wd AS (PARTITION BY incident_id ORDER BY ts DESC, event_id DESC))"""
INC = f""",
inc0 AS (SELECT incident_id, type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_points,
  arg_max(mark, ts) AS last_mark, count(*) FILTER (mark = 'Watch') AS n_watch,
  max(ts) FILTER (mark = 'Watch') AS recon_time FROM points GROUP BY 1, 2),
inc AS (SELECT *, CASE WHEN last_mark = 'Terminated' THEN 'Terminated' WHEN n_watch > 0 THEN 'Watch'
  ELSE 'Active' END AS status, least(1e0, 0.4e0 + 0.1e0 * n_points + 0.2e0 * n_watch) AS confidence,
  n_watch > 0 AS has_recon FROM inc0)"""
TRANS = """,
firsts AS (SELECT incident_id, type, place, min(ts) AS ts FROM points GROUP BY 1, 2, 3),
moved AS (SELECT type, place AS to_place, lag(place) OVER (PARTITION BY incident_id ORDER BY ts) AS from_place FROM firsts),
tn AS (SELECT type, from_place, to_place, count(*) AS n FROM moved WHERE from_place IS NOT NULL GROUP BY 1, 2, 3),
trans AS (SELECT *, n / sum(n) OVER (PARTITION BY type, from_place)::DOUBLE AS prob FROM tn)"""
KM = hav("plat", "plon", "lat", "lon")
CHAINS = """,
l3 AS (SELECT incident_id, type, max(place) FILTER (rd = 1) AS k3, max(pplace) FILTER (rd = 1) AS k2,
  max(pplace) FILTER (rd = 2) AS k1, count(*) AS c,
  max(km) FILTER (rd = 1) + max(km) FILTER (rd = 2) AS km
  FROM (SELECT *, """ + KM + """ AS km FROM steps) GROUP BY 1, 2),
chain AS (SELECT * FROM l3 WHERE c >= 3)"""
STATS = CHAINS + """,
dirs AS (SELECT type, pplace AS k1, place AS k2, NULL AS k3, """ + KM + """ AS km, 1 AS legs FROM steps WHERE pplace IS NOT NULL
  UNION ALL SELECT type, k1, k2, k3, km, 2 FROM chain),
dg AS (SELECT type, k1, k2, k3, count(*) AS n, sum(km) / sum(legs) AS avg_km FROM dirs GROUP BY 1, 2, 3, 4),
stats AS (SELECT *, (n + 1e0) / (sum(n) OVER (PARTITION BY type) + count(*) OVER (PARTITION BY type)) AS prob,
  concat_ws('->', k1, k2, k3) AS direction FROM dg)"""
TIMES = """,
tp0 AS (SELECT type, """ + tod("first_seen") + """ AS tod, dayname(first_seen) AS dow, count(*) AS n FROM inc GROUP BY 1, 2, 3),
tp AS (SELECT *, (n + 1e0) / (sum(n) OVER (PARTITION BY type) + count(*) OVER (PARTITION BY type)) AS prob FROM tp0)"""
FEATS = f""",
path AS (SELECT incident_id, coalesce(sum({KM}), 0) AS path_km, arg_min(place, ts) AS a_place, arg_min(lat, ts) AS a_lat,
  arg_min(lon, ts) AS a_lon, arg_max(place, ts) AS z_place, arg_max(lat, ts) AS z_lat, arg_max(lon, ts) AS z_lon,
  round(avg(lat), 9) AS m_lat, round(avg(lon), 9) AS m_lon, count(DISTINCT place) AS n_places FROM steps GROUP BY 1),
f0 AS (SELECT i.*, p.* EXCLUDE (incident_id), (epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9 AS hrs FROM inc i JOIN path p USING (incident_id)),
f1 AS (SELECT *, CASE WHEN hrs > 0.01 THEN path_km / hrs ELSE 0e0 END AS avg_speed FROM f0),
feats AS (SELECT *, {tod('first_seen')} AS tod,
  CASE WHEN month(first_seen) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(first_seen) BETWEEN 6 AND 8 THEN 'Summer'
    WHEN month(first_seen) BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END AS season,
  dayname(first_seen) AS dow,
  CASE WHEN avg_speed < 10 THEN 'Slow' WHEN avg_speed < 50 THEN 'Medium' WHEN avg_speed < 150 THEN 'Fast' ELSE 'VeryFast' END AS speed_bin,
  CASE WHEN a_place = z_place THEN a_place ELSE
    regexp_replace(printf('%.1f', {tenth('m_lat')}), '\\.0$', '') || '_' || regexp_replace(printf('%.1f', {tenth('m_lon')}), '\\.0$', '') END AS region,
  CASE WHEN a_place = z_place THEN a_place ELSE
    printf('%.1f', {tenth('(a_lat + z_lat) / 2')}) || '_' || printf('%.1f', {tenth('(a_lon + z_lon) / 2')}) END AS region_key
  FROM f1),
fnode AS (SELECT *, concat_ws('|', type, tod, season, dow, has_recon::VARCHAR, speed_bin, region_key) AS node_id FROM feats)"""
EDGE_ROWS = f""",
seq AS (SELECT node_id AS dst, type, first_seen, incident_id, a_lat, a_lon, lag(node_id) OVER w AS src, lag(type) OVER w AS ptype,
  lag(z_lat) OVER w AS pz_lat, lag(z_lon) OVER w AS pz_lon, lag(first_seen) OVER w AS pfirst FROM fnode
  WINDOW w AS (ORDER BY first_seen, incident_id)),
er0 AS (SELECT src, dst, first_seen, incident_id, {hav('pz_lat', 'pz_lon', 'a_lat', 'a_lon')} AS km,
  (epoch_us(first_seen) - epoch_us(pfirst)) / 3.6e9 AS hours,
  CASE WHEN type = 'FPV' OR ptype = 'FPV' THEN 10 WHEN type = 'Rocket' OR ptype = 'Rocket' THEN 100 ELSE 50 END AS lim
  FROM seq WHERE src IS NOT NULL),
er AS (SELECT src, dst, first_seen, incident_id, km, hours FROM er0 WHERE km <= lim AND hours <= 24)"""


def deviation(rows: str) -> str:
    return f"""dv0 AS (SELECT src, dst, hours, row_number() OVER w AS k,
  avg(hours) OVER (PARTITION BY src, dst ORDER BY first_seen, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM {rows} WINDOW w AS (PARTITION BY src, dst ORDER BY first_seen, incident_id)),
dv AS (SELECT src, dst, CASE WHEN count(*) > 1 THEN sqrt(sum(CASE WHEN k > 1 THEN pow(hours - before, 2) END) / (count(*) - 1)) ELSE 0e0 END AS delay_dev
  FROM dv0 GROUP BY 1, 2)"""


EDGES = EDGE_ROWS + ",\n" + deviation("er") + """,
eg AS (SELECT src, dst, count(*) AS n, avg(hours) AS delay_mean, avg(km) AS km_mean, max(first_seen) AS last_time FROM er GROUP BY 1, 2),
edges AS (SELECT eg.*, delay_dev, (n + 1e0) / (sum(n) OVER (PARTITION BY src) + count(*) OVER (PARTITION BY src)) AS prob
  FROM eg JOIN dv USING (src, dst))"""


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --- transitions and directions ----------------------------------------------------------------------
add("transition_probability", f"WITH {POINTS}{TRANS} SELECT type, from_place, to_place, n, round(prob, 6) AS prob FROM trans")
add("incoming_weight", f"""WITH {POINTS}{TRANS} SELECT type, to_place AS place, round(0.5e0 + max(prob), 6) AS weight FROM trans GROUP BY 1, 2""")
add("incoming_weight_from", f"""WITH {POINTS}{TRANS} SELECT type, from_place, to_place AS place, round(0.5e0 + prob, 6) AS weight FROM trans""")
add("direction_stats", f"""WITH {STEPS}{STATS} SELECT type, direction, n, round(prob, 6) AS prob, round(avg_km, 6) AS avg_km, 0.5e0 AS avg_weight FROM stats""")
add("chain_stats", f"WITH {STEPS}{CHAINS} SELECT type, k1, k2, k3, count(*) AS n, round(avg(km), 6) AS km FROM chain GROUP BY 1, 2, 3, 4")
add("time_pattern", f"WITH {POINTS}{INC}{TIMES} SELECT type, tod, dow, n, round(prob, 6) AS prob FROM tp")

# --- incidents, features, graph -------------------------------------------------------------------------
add("incident_rollup", f"""WITH {POINTS}{INC} SELECT incident_id, type, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us,
  status, round(confidence, 6) AS confidence, n_points, has_recon, epoch_us(recon_time) AS recon_us FROM inc""")
add("point_dedupe", f"""WITH {POINTS} SELECT incident_id, place, arg_min(event_id, ts) AS event_id, epoch_us(min(ts)) AS ts_us
  FROM points GROUP BY incident_id, place, round(lat, 4), round(lon, 4)""")
add("incident_features", f"""WITH {STEPS}{INC}{FEATS} SELECT incident_id, type, tod, season, dow, has_recon, n_points, n_places,
  round(path_km, 6) AS path_km, round(avg_speed, 6) AS avg_speed, speed_bin, region, region_key FROM feats""")
add("graph_nodes", f"""WITH {STEPS}{INC}{FEATS}, o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY first_seen, incident_id) AS r,
  count(*) OVER (PARTITION BY node_id) AS n FROM fnode)
  SELECT node_id, n, 0.5e0 AS weight, incident_id AS first_incident, round(avg_speed, 6) AS avg_speed,
  round(path_km, 6) AS path_km, n_points FROM o WHERE r = 1""")
add("graph_edges", f"""WITH {STEPS}{INC}{FEATS}{EDGES} SELECT src, dst, n, round(prob, 6) AS prob, round(delay_mean, 6) AS delay_mean,
  round(delay_dev, 6) AS delay_dev, round(km_mean, 6) AS km_mean, epoch_us(last_time) AS last_us FROM edges""")
add("edge_deviation", f"""WITH {STEPS}{INC}{FEATS}{EDGE_ROWS}, er2 AS (SELECT split_part(src, '|', 1) AS src, split_part(dst, '|', 1) AS dst,
  first_seen, incident_id, hours FROM er), {deviation('er2')} SELECT src, dst, round(delay_dev, 6) AS delay_dev FROM dv""")
ZONE = f"""c AS (SELECT incident_id, type, avg(lat) AS clat, avg(lon) AS clon FROM zp GROUP BY 1, 2),
z AS (SELECT c.incident_id, c.type, any_value(clat) AS clat, any_value(clon) AS clon,
  least(max({hav('clat', 'clon', 'lat', 'lon')}) + 3, {max_km('c.type')} + 3) AS radius, count(*) AS n
  FROM zp JOIN c USING (incident_id) GROUP BY 1, 2)"""
add("zone_build", f"""WITH {POINTS}, zp AS (SELECT * FROM points), {ZONE}
  SELECT incident_id, type, round(clat, 6) AS center_lat, round(clon, 6) AS center_lon, round(radius, 6) AS radius_km, n FROM z""")
add("zone_update", f"""WITH {POINTS}, m AS (SELECT *, row_number() OVER (PARTITION BY incident_id, lower(place) ORDER BY event_id % 2) AS r FROM points),
  zp AS (SELECT * FROM m WHERE r = 1), {ZONE}, u AS (SELECT incident_id, count(*) FILTER (event_id % 2 = 1) AS u FROM points GROUP BY 1)
  SELECT incident_id, round(clat, 6) AS center_lat, round(radius, 6) AS radius_km, n, 1e0 + u AS weight FROM z JOIN u USING (incident_id)""")
add("profile_limits", f"""WITH {POINTS}{INC} SELECT type, count(*) AS n, {speed('type')} AS max_speed_kmh, {max_km('type')} AS max_distance_km,
  {life('type', 30)}::DOUBLE AS lifetime_min FROM inc GROUP BY 1""")

# --- spatial ------------------------------------------------------------------------------------------------
add("pair_distance", f"""WITH {STEPS}, d AS (SELECT DISTINCT pplace AS from_name, place AS to_name FROM steps WHERE pplace IS NOT NULL)
  SELECT from_name, to_name, CASE WHEN from_name = to_name THEN 0e0 ELSE round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) END AS dist_km,
  CASE WHEN from_name = to_name THEN 0e0 ELSE round({azi('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) END AS azimuth
  FROM d JOIN places a ON a.name = from_name JOIN places b ON b.name = to_name""")
PAIRS = f"""org AS (SELECT DISTINCT lat AS lat0, lon AS lon0 FROM points),
pr AS (SELECT lat0, lon0, place_id, name, lat, lon, {hav('lat0', 'lon0', 'lat', 'lon')} AS dist, {azi('lat0', 'lon0', 'lat', 'lon')} AS az
  FROM org, places)"""
SECT = """sec AS (SELECT *, (floor(az / 5) * 5)::INT AS sector FROM pr WHERE dist >= 0.1
  UNION ALL SELECT *, ((floor(az / 5) * 5)::INT + 355) % 360 FROM pr WHERE dist >= 0.1 AND az / 5 = floor(az / 5)),
ns AS (SELECT *, row_number() OVER (PARTITION BY lat0, lon0, sector ORDER BY dist, place_id) AS rank FROM sec)"""
add("nearest_k", f"""WITH {POINTS}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY lat0, lon0 ORDER BY dist, place_id) AS rank FROM pr)
  SELECT round(lat0, 6) AS lat0, round(lon0, 6) AS lon0, rank, place_id, round(dist, 6) AS dist, round(az, 6) AS azimuth FROM r WHERE rank <= 5""")
add("nearest_in_sector", f"""WITH {POINTS}, {PAIRS}, {SECT} SELECT round(lat0, 6) AS lat0, round(lon0, 6) AS lon0, sector, rank, place_id,
  round(dist, 6) AS dist FROM ns WHERE rank <= 3""")
HEADS = """heads AS (SELECT incident_id, type, lat AS lat0, lon AS lon0, plat, plon, ts, place, pplace FROM steps WHERE rd = 1)"""


def zone_weight(d, m) -> str:
    return f"(CASE WHEN {m} <= 0 THEN 0.5e0 WHEN {d} / {m} < 0.1 THEN 3e0 WHEN {d} / {m} < 0.5 THEN 1.5e0 ELSE 0.5e0 END)"


SCAN = f"""{HEADS},
h2 AS (SELECT *, {max_km('type')} AS mk, CASE WHEN plat IS NOT NULL THEN {azi('plat', 'plon', 'lat0', 'lon0')} END AS heading FROM heads),
org AS (SELECT DISTINCT lat0, lon0 FROM h2),
pr AS (SELECT lat0, lon0, place_id, name, lat, lon, {hav('lat0', 'lon0', 'lat', 'lon')} AS dist, {azi('lat0', 'lon0', 'lat', 'lon')} AS az FROM org, places),
{SECT},
mks AS (SELECT DISTINCT lat0, lon0, mk FROM h2),
sw AS (SELECT lat0, lon0, mk, sector, sum({zone_weight('dist', 'mk')}) + CASE WHEN max({zone_weight('dist', 'mk')}) >= 3 THEN 5 ELSE 0 END AS w
  FROM sec JOIN mks USING (lat0, lon0) GROUP BY 1, 2, 3, 4),
deg AS (SELECT unnest(range(0, 360, 5)) AS sector),
rated AS (SELECT h.incident_id, h.type, h.lat0, h.lon0, h.mk, d.sector, coalesce(sw.w, 0) + CASE WHEN heading IS NULL THEN 0
    WHEN least(abs(d.sector - heading), 360 - abs(d.sector - heading)) <= 30 THEN 2 ELSE 0 END AS w
  FROM h2 h CROSS JOIN deg d LEFT JOIN sw ON sw.lat0 = h.lat0 AND sw.lon0 = h.lon0 AND sw.mk = h.mk AND sw.sector = d.sector),
best AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY w DESC, sector) AS r FROM rated),
hit AS (SELECT b.incident_id, b.type, n.name AS place, n.lat, n.lon, n.dist, {zone_weight('n.dist', 'b.mk')} AS zw
  FROM best b JOIN ns n ON n.lat0 = b.lat0 AND n.lon0 = b.lon0 AND n.sector = b.sector AND n.rank <= 3 WHERE b.r <= 3),
cg AS (SELECT incident_id, type, place, sum(zw) AS weight, min(dist) AS dist, any_value(lat) AS lat, any_value(lon) AS lon FROM hit GROUP BY 1, 2, 3),
scan AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY weight DESC, dist, place) AS rank FROM cg QUALIFY rank <= 3)"""
add("sector_scan", f"WITH {STEPS}, {SCAN} SELECT incident_id, rank, place, round(dist, 6) AS dist, weight FROM scan")
add("radius_places", f"""WITH {STEPS}, {HEADS} SELECT incident_id, p.place_id, round({hav('lat0', 'lon0', 'p.lat', 'p.lon')}, 6) AS dist
  FROM heads, places p WHERE {hav('lat0', 'lon0', 'p.lat', 'p.lon')} <= 7""")


def corridor(src: str) -> str:
    return f"""seg AS (SELECT incident_id, plat, plon, lat, lon, greatest(2, floor({KM} / 2)::INT) AS k FROM {src} WHERE pplace IS NOT NULL),
smp AS (SELECT incident_id, plat + (lat - plat) * (t / k::DOUBLE) AS slat, plon + (lon - plon) * (t / k::DOUBLE) AS slon
  FROM (SELECT *, unnest(range(0, k + 1)) AS t FROM seg)
  UNION ALL SELECT incident_id, min(lat), min(lon) FROM {src} GROUP BY 1 HAVING count(*) = 1),
hits AS (SELECT DISTINCT incident_id, p.place_id, p.name FROM smp JOIN places p ON abs(p.lat - slat) < 0.1
  WHERE {hav('slat', 'slon', 'p.lat', 'p.lon')} <= 7)"""


add("corridor_places", f"WITH {STEPS}, {corridor('steps')} SELECT incident_id, place_id FROM hits")
add("box_places", f"""WITH {POINTS}, b AS (SELECT incident_id, round(min(lat) - 0.05, 4) AS a, round(max(lat) + 0.05, 4) AS b, round(min(lon) - 0.05, 4) AS c,
  round(max(lon) + 0.05, 4) AS d FROM points GROUP BY 1)
  SELECT incident_id, count(*) AS n, min(place_id) AS first_place FROM b JOIN places p
  ON round(p.lat, 4) BETWEEN b.a AND b.b AND round(p.lon, 4) BETWEEN b.c AND b.d GROUP BY 1""")
TRACK = f"""g AS (SELECT incident_id, type, min(ts) AS o, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon, max(ts) AS ts
  FROM points GROUP BY incident_id, type, round(lat, 4), round(lon, 4)),
t5 AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY o DESC) AS r FROM g QUALIFY r <= 5),
leg AS (SELECT *, lag(lat) OVER w AS qlat, lag(lon) OVER w AS qlon, lag(ts) OVER w AS qts FROM t5 WINDOW w AS (PARTITION BY incident_id ORDER BY r DESC)),
lv AS (SELECT *, {hav('qlat', 'qlon', 'lat', 'lon')} AS km, (epoch_us(ts) - epoch_us(qts)) / 3.6e9 AS h FROM leg),
lv2 AS (SELECT *, CASE WHEN h > 0.001 THEN km / h END AS v FROM lv),
tr AS (SELECT incident_id, type, count(*) AS n_track, coalesce(avg(v), 0) AS mean_speed, coalesce(stddev_pop(v), 0) AS speed_dev,
  max(lat) FILTER (r = 1) AS lat, max(lon) FILTER (r = 1) AS lon, max(ts) FILTER (r = 1) AS ts,
  max(qlat) FILTER (r = 1) AS qlat, max(qlon) FILTER (r = 1) AS qlon,
  arg_max(lat, r) AS flat, arg_max(lon, r) AS flon, arg_max(ts, r) AS fts FROM lv2 GROUP BY 1, 2 HAVING count(*) >= 2),
tr2 AS (SELECT *, {hav('flat', 'flon', 'lat', 'lon')} AS whole, (epoch_us(ts) - epoch_us(fts)) / 3.6e9 AS span, {azi('qlat', 'qlon', 'lat', 'lon')} AS bearing FROM tr),
track AS (SELECT *, CASE WHEN mean_speed < 0.1 AND span > 0.001 AND whole > 0.5 THEN whole / span ELSE mean_speed END AS speed,
  CASE WHEN n_track >= 3 AND mean_speed > 0 THEN greatest(0e0, 1 - speed_dev / mean_speed) ELSE 0e0 END AS stability FROM tr2)"""
add("speed_stats", f"""WITH {POINTS}, {TRACK} SELECT incident_id, n_track, round(mean_speed, 6) AS mean_speed, round(speed_dev, 6) AS speed_dev,
  round(speed, 6) AS speed, round(stability, 6) AS stability, round(bearing, 6) AS bearing FROM track""")

# --- forecasts ---------------------------------------------------------------------------------------------------
OPEN = "status IN ('Active', 'Watch')"
BOX = "round(la1 - {w}, 6) AS min_lat, round(la2 + {w}, 6) AS max_lat, round(lo1 - {w}, 6) AS min_lon, round(lo2 + {w}, 6) AS max_lon"
add("bayes_forecast", f"""WITH {STEPS}{INC}{TRANS}, {SCAN},
iw AS (SELECT type, to_place, 0.5e0 + max(prob) AS w FROM trans GROUP BY 1, 2),
c AS (SELECT s.*, s.weight * coalesce(iw.w, 0.5e0) AS score, i.last_seen FROM scan s JOIN inc i ON i.incident_id = s.incident_id AND {OPEN} AND i.type <> 'Recon'
  LEFT JOIN iw ON iw.type = s.type AND iw.to_place = s.place),
f AS (SELECT incident_id, type, last_seen, string_agg(place, ',' ORDER BY score DESC, rank) AS places, max(score) / sum(score) AS conf,
  min(lat) AS la1, max(lat) AS la2, min(lon) AS lo1, max(lon) AS lo2 FROM c GROUP BY 1, 2, 3)
SELECT incident_id, type, places, epoch_us(last_seen) + 300000000 AS start_us, epoch_us(last_seen) + {life('type', 30)}::BIGINT * 60000000 AS end_us,
  round(conf, 6) AS confidence, {BOX.format(w='(5e0 / 111 / 2)')} FROM f""")
add("recon_forecast", f"""WITH {STEPS}{INC}, rp AS (SELECT s.* FROM steps s JOIN inc i USING (incident_id) WHERE {OPEN} AND i.type = 'Recon'), {corridor('rp')},
p3 AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY place_id) AS r FROM hits QUALIFY r <= 3),
n3 AS (SELECT incident_id, string_agg(name, ',' ORDER BY r) AS places FROM p3 GROUP BY 1),
cl AS (SELECT incident_id, avg(slat) AS clat FROM smp GROUP BY 1),
bx AS (SELECT incident_id, min(lat) AS la1, max(lat) AS la2, min(lon) AS lo1, max(lon) AS lo2 FROM rp GROUP BY 1)
SELECT incident_id, i.type, places, epoch_us(last_seen) + 300000000 AS start_us, epoch_us(last_seen) + 120::BIGINT * 60000000 AS end_us, 0.7e0 AS confidence,
  round(la1 - 7e0 / 111, 6) AS min_lat, round(la2 + 7e0 / 111, 6) AS max_lat, round(lo1 - 7 / (111 * cos(radians(clat))), 6) AS min_lon,
  round(lo2 + 7 / (111 * cos(radians(clat))), 6) AS max_lon
FROM n3 JOIN cl USING (incident_id) JOIN bx USING (incident_id) JOIN inc i USING (incident_id)""")
RADIUS = "CASE WHEN avg_speed > 0 THEN greatest(2e0, least(50e0, avg_speed * {h} * 0.5e0)) ELSE 5e0 END"
STAT_F = f""",
hd AS (SELECT s.incident_id, s.type, s.place AS last, s.pplace AS before, f.avg_speed, f.n_points, f.last_seen, coalesce(tp.prob, 0.1e0) AS tprob
  FROM steps s JOIN feats f USING (incident_id) LEFT JOIN tp ON tp.type = f.type AND tp.tod = f.tod AND tp.dow = f.dow
  WHERE s.rd = 1 AND f.n_points >= 2 AND f.{OPEN}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY type, k1 ORDER BY prob DESC, direction) AS r FROM stats QUALIFY r <= 3),
s2 AS (SELECT *, row_number() OVER (PARTITION BY type, k1, k2 ORDER BY prob DESC, direction) AS r FROM stats WHERE k3 IS NOT NULL QUALIFY r <= 2),
cd AS (SELECT h.*, 0 AS kind, r, prob, avg_km, coalesce(k3, k2) AS target FROM hd h JOIN s1 ON s1.type = h.type AND s1.k1 = h.last
  UNION ALL SELECT h.*, 1, r, prob, avg_km, k3 FROM hd h JOIN s2 ON s2.type = h.type AND s2.k1 = h.before AND s2.k2 = h.last WHERE n_points >= 3),
sc AS (SELECT *, round(prob * tprob * CASE WHEN avg_km > 0 AND avg_speed > 0 AND avg_km / avg_speed > 3 THEN 0.3e0
  WHEN avg_km > 0 AND avg_speed > 0 AND avg_km / avg_speed > 1.5 THEN 0.7e0 ELSE 1e0 END * 0.5e0, 12) AS score FROM cd),
tk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, kind, r) AS rank FROM sc QUALIFY rank <= 3),
td AS (SELECT incident_id, target, min(rank) AS rk FROM tk GROUP BY 1, 2),
tl AS (SELECT incident_id, string_agg(target, ',' ORDER BY rk) AS places, min(lat) AS la1, max(lat) AS la2, min(lon) AS lo1, max(lon) AS lo2
  FROM td LEFT JOIN places p ON p.name = target GROUP BY 1),
statf AS (SELECT t.incident_id, t.type, tl.places, last_seen, avg_speed,
  least(1e0, 0.4e0 * prob + 0.2e0 * tprob + 0.1e0 + 0.2e0 * least(1e0, n_points / 5e0)) AS conf, la1, la2, lo1, lo2
  FROM tk t JOIN tl USING (incident_id) WHERE rank = 1)"""
STAT_ALL = f"WITH {STEPS}{INC}{FEATS}{STATS}{TIMES}{STAT_F}"
SW = f"(({RADIUS.format(h='1.5e0')}) / 111 / 2)"
add("stat_forecast", f"""{STAT_ALL} SELECT incident_id, type, places, epoch_us(last_seen) + 900000000 AS start_us, epoch_us(last_seen) + 5400000000 AS end_us,
  round(conf, 6) AS confidence, {BOX.format(w=SW)} FROM statf""")
GRAPH_F = f""",
nr AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY first_seen, incident_id) AS k FROM fnode),
nodes AS (SELECT node_id, type, region_key, first_seen, incident_id FROM nr WHERE k = 1),
pick AS (SELECT *, row_number() OVER (PARTITION BY type, region_key ORDER BY first_seen, incident_id) AS k FROM nodes),
be AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(ln(prob) + epoch_us(last_time) / 1e6 / 86400 / 7e0, 9) DESC, dst) AS rank FROM edges QUALIFY rank <= 3),
hop AS (SELECT f.incident_id, f.type, f.last_seen, f.avg_speed, f.n_points, be.rank, be.prob, be.delay_mean, be.delay_dev, n.region_key AS region
  FROM feats f JOIN pick ON pick.k = 1 AND pick.type = f.type AND pick.region_key = f.region_key
  JOIN be ON be.src = pick.node_id JOIN nodes n ON n.node_id = be.dst WHERE f.n_points >= 2 AND f.{OPEN}),
gl AS (SELECT incident_id, type, last_seen, avg_speed, n_points, string_agg(region, ',' ORDER BY rank) AS places, avg(prob) AS p,
  max(delay_mean) FILTER (rank = 1) AS dm, greatest(max(delay_dev) FILTER (rank = 1), 0.5e0) AS ds,
  min(lat) AS la1, max(lat) AS la2, min(lon) AS lo1, max(lon) AS lo2
  FROM hop LEFT JOIN places pl ON lower(pl.name) = lower(region) GROUP BY 1, 2, 3, 4, 5),
graphf AS (SELECT *, least(1e0, 0.5e0 * p + 0.15e0 + 0.2e0 * least(1e0, n_points / 5e0)) AS conf FROM gl)"""
GRAPH_ALL = f"WITH {STEPS}{INC}{FEATS}{EDGES}{GRAPH_F}"
GW = f"(({RADIUS.format(h='(dm + ds)')}) / 111 / 2)"
add("graph_forecast", f"""{GRAPH_ALL} SELECT incident_id, type, places,
  round((epoch_us(last_seen) + round(greatest(dm - ds, 0.25e0) * 60 * 6e7)) / 1e6)::BIGINT AS start_s,
  round((epoch_us(last_seen) + round((dm + ds) * 60 * 6e7)) / 1e6)::BIGINT AS end_s, round(conf, 6) AS confidence, {BOX.format(w=GW)} FROM graphf""")
add("graph_forecast_default", ORACLE["graph_forecast"].replace("FROM edges QUALIFY", "FROM edges WHERE n >= 3 QUALIFY"))
TRAJ_F = f""", {TRACK},
tj0 AS (SELECT t.*, i.last_seen, least(speed * 1.5e0, 50e0) AS km FROM track t JOIN inc i USING (incident_id) WHERE i.n_points >= 2 AND i.{OPEN} AND speed >= 0.1),
tj1 AS (SELECT *, asin(sin(radians(lat)) * cos(km / 6371e0) + cos(radians(lat)) * sin(km / 6371e0) * cos(radians(bearing))) AS p2 FROM tj0),
tj2 AS (SELECT *, degrees(p2) AS la, degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(km / 6371e0) * cos(radians(lat)),
  cos(km / 6371e0) - sin(radians(lat)) * sin(p2))) AS lo FROM tj1),
nn AS (SELECT incident_id, p.name, row_number() OVER (PARTITION BY incident_id ORDER BY {hav('la', 'lo', 'p.lat', 'p.lon')}, p.place_id) AS r FROM tj2, places p QUALIFY r = 1),
trajf AS (SELECT t.*, nn.name AS places, least(1e0, 0.5e0 + 0.2e0 * least(1e0, n_track / 5e0) + 0.15e0 * stability + 0.1e0) AS conf,
  CASE WHEN km * 0.2e0 < 0.1 THEN 1e0 ELSE km * 0.2e0 END / 111 AS w FROM tj2 t JOIN nn USING (incident_id))"""
TRAJ_ALL = f"WITH {POINTS}{INC}{TRAJ_F}"
add("trajectory_forecast", f"""{TRAJ_ALL} SELECT incident_id, type, places,
  round((epoch_us(ts) + round(km / speed * 60 * 0.8e0 * 6e7)) / 1e6)::BIGINT AS start_s,
  round((epoch_us(ts) + round(km / speed * 60 * 1.2e0 * 6e7)) / 1e6)::BIGINT AS end_s, round(conf, 6) AS confidence,
  round(la - w, 6) AS min_lat, round(la + w, 6) AS max_lat, round(lo - w, 6) AS min_lon, round(lo + w, 6) AS max_lon FROM trajf""")
ALL_F = f"""WITH {STEPS}{INC}{FEATS}{STATS}{TIMES}{STAT_F}{EDGES}{GRAPH_F}{TRAJ_F},
allf AS (SELECT incident_id, 'Graph' AS predictor, string_split(places, ',') AS pl, conf, last_seen FROM graphf
  UNION ALL SELECT incident_id, 'Statistical', string_split(places, ','), conf, last_seen FROM statf
  UNION ALL SELECT incident_id, 'Trajectory', [places], conf, last_seen FROM trajf)"""
add("vote_forecast", f"""{ALL_F}, v AS (SELECT DISTINCT incident_id, predictor, unnest(pl) AS place, conf * CASE predictor WHEN 'Graph' THEN 0.4e0 ELSE 0.3e0 END AS s FROM allf),
vg AS (SELECT incident_id, place, round(sum(s), 9) AS score FROM v GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, place) AS rank FROM vg)
SELECT incident_id, rank, place, round(score, 6) AS score FROM vr WHERE rank <= 3""")


def overlap(a: str, b: str) -> str:
    return f"""jj AS (SELECT a.incident_id, list_distinct(list_transform(a.pl, lambda x: lower(x))) AS x, list_distinct(list_transform(b.pl, lambda x: lower(x))) AS y
  FROM allf a JOIN allf b USING (incident_id) WHERE a.predictor = '{a}' AND b.predictor = '{b}'),
ov AS (SELECT incident_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS overlap FROM jj)"""


add("predictor_agreement", f"""{ALL_F}, {overlap('Graph', 'Statistical')} SELECT count(*) AS compared, count(*) FILTER (overlap >= 0.5) AS matched,
  round(100e0 * count(*) FILTER (overlap >= 0.5) / count(*), 6) AS pct FROM ov""")
add("agreement_detail", f"{ALL_F}, {overlap('Statistical', 'Trajectory')} SELECT incident_id, round(overlap, 6) AS overlap FROM ov")
add("report_predictors", f"{ALL_F} SELECT predictor, count(*) AS n, round(avg(conf), 6) AS avg_confidence FROM allf GROUP BY 1")
add("forecast_period", f"""{STAT_ALL} SELECT s.incident_id, epoch_us(s.last_seen) AS created_us, round(conf, 6) AS confidence FROM statf s JOIN inc i USING (incident_id)
  WHERE first_seen BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
add("alert_forecasts", f"{TRAJ_ALL} SELECT incident_id, round(conf, 6) AS confidence FROM trajf WHERE conf >= 0.6")
add("zone_geojson", f"""WITH {POINTS}, b AS (SELECT incident_id, round(min(lat), 2) AS a, round(max(lat), 2) AS b, round(min(lon), 2) AS c, round(max(lon), 2) AS d FROM points GROUP BY 1)
  SELECT incident_id, '{{"type":"Polygon","coordinates":[[[' || c || ',' || a || '],[' || d || ',' || a || '],[' || d || ',' || b || '],[' || c || ',' || b || '],['
  || c || ',' || a || ']]]}}' AS zone FROM b""")

# --- reports --------------------------------------------------------------------------------------------------------
add("report_types", f"""WITH {POINTS}{INC} SELECT type, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM inc GROUP BY 1""")
HOURS = "SELECT hour({t} + INTERVAL {o} HOUR)::INT AS hour, count(*) AS n FROM {s} GROUP BY 1 ORDER BY n DESC, hour LIMIT {k}"
add("report_hours", f"WITH {POINTS}{INC} " + HOURS.format(t="first_seen", o=3, s="inc", k=3))
TOP_PLACES = "SELECT place, count(*) AS n FROM {s} GROUP BY 1 ORDER BY n DESC, place LIMIT 5"
add("report_places", f"WITH {POINTS} " + TOP_PLACES.format(s="points"))
ENDS = "ends AS (SELECT incident_id, arg_max(place, ts) AS place FROM {s} GROUP BY 1)"
add("report_endpoints", f"WITH {POINTS}, {ENDS.format(s='points')} " + TOP_PLACES.format(s="ends"))
add("report_transitions", f"""WITH {STEPS} SELECT pplace AS from_place, place AS to_place, count(*) AS n FROM steps WHERE pplace IS NOT NULL
  GROUP BY 1, 2 ORDER BY n DESC, from_place, to_place LIMIT 5""")
add("report_summary", f"""WITH {POINTS}{INC} SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence,
  count(*) FILTER (status = 'Terminated') AS n_terminated, round(100e0 * count(*) FILTER (status = 'Terminated') / count(*), 6) AS pct_terminated FROM inc""")
add("report_week", f"""WITH {POINTS}{INC}, wi AS (SELECT * FROM inc WHERE first_seen BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14 23:59:59'),
  wp AS (SELECT p.* FROM points p JOIN wi USING (incident_id)), {ENDS.format(s='wp')}
  SELECT 'types' AS section, type AS item, count(*) AS n FROM wi GROUP BY 2
  UNION ALL SELECT 'hours', hour::VARCHAR, n FROM ({HOURS.format(t='first_seen', o=3, s='wi', k=3)})
  UNION ALL SELECT 'places', place, n FROM ({TOP_PLACES.format(s='wp')})
  UNION ALL SELECT 'endpoints', place, n FROM ({TOP_PLACES.format(s='ends')})
  UNION ALL SELECT 'steps', item, n FROM (SELECT pplace || '>' || place AS item, count(*) AS n FROM (SELECT place, lag(place) OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS pplace FROM wp)
    WHERE pplace IS NOT NULL GROUP BY pplace, place ORDER BY n DESC, pplace, place LIMIT 5)
  UNION ALL SELECT 'summary', 'terminated', count(*) FILTER (status = 'Terminated') FROM wi""")
add("active_incidents", f"WITH {POINTS}{INC} SELECT incident_id, status FROM inc WHERE {OPEN}")
add("expired_incidents", f"""WITH {POINTS}{INC} SELECT type, CASE WHEN {OPEN} AND date_diff('microsecond', last_seen, TIMESTAMP '2024-01-30 22:00:00') > {life('type', 120)} * 60000000::BIGINT
  THEN 'Expired' ELSE status END AS status, count(*) AS n FROM inc GROUP BY 1, 2""")
add("incident_override", f"""WITH {POINTS}{INC} SELECT incident_id, CASE WHEN n_points >= 5 THEN 'Terminated' ELSE status END AS status,
  CASE WHEN n_points >= 5 THEN 'closed by hand' END AS reason FROM inc""")
add("latest_incident_point", f"WITH {POINTS} SELECT incident_id, arg_max(event_id, ts) AS event_id, arg_max(place, ts) AS place FROM points GROUP BY 1")
add("latest_points", f"WITH {POINTS} SELECT event_id, epoch_us(ts) AS ts_us, place FROM points ORDER BY ts DESC, event_id DESC LIMIT 50")

# --- message classification ----------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(terms, col="t") -> str:
    one = lambda x: "(" + " AND ".join(f"contains({col}, {q(p)})" for p in x) + ")" if isinstance(x, tuple) else f"contains({col}, {q(x)})"
    return "(" + " OR ".join(one(x) for x in terms) + ")"


DOCS = "docs AS (SELECT doc_id AS message_id, source AS sender, lang, text, lower(text) AS t, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS ts FROM documents)"
TYPE_CASE = ("CASE WHEN " + has(TERMS["fibre"]) + " THEN 'FpvFiberOptic' "
             + " ".join(f"WHEN {has([w])} THEN {q(r or 'Unknown')}" for w, r in TERMS["types"]) + " ELSE 'Unknown' END")
STATUS_CASE = (f"CASE WHEN {has([w for w, _ in TERMS['clear']])} THEN 'Terminated' WHEN {has(TERMS['watch'])} THEN 'Watch' ELSE 'Active' END")
DESTROYED = "CASE " + " ".join(f"WHEN {has([w])} THEN {str(v).lower()}" for w, v in TERMS["clear"]) + " ELSE false END"
FLAGS = ("concat_ws(',', CASE WHEN " + DESTROYED + " THEN 'Destroyed' END, "
         + ", ".join(f"CASE WHEN {has(ws)} THEN {q(f)} END" for f, ws in TERMS["flags"]) + ")")
PARSED = f"""{DOCS}, cls AS (SELECT *, {TYPE_CASE} AS type, {STATUS_CASE} AS status, {FLAGS} AS flags FROM docs)"""
add("priority_class", f"WITH {DOCS} SELECT message_id, CASE " + " ".join(f"WHEN {has(ws)} THEN {r}" for ws, r in TERMS["priority"]) + " ELSE 5 END AS priority FROM docs")
add("type_class", f"""WITH {PARSED} SELECT message_id, type, CASE WHEN type = 'Rocket' THEN 'Missile' WHEN type <> 'Unknown' THEN 'Drone'
  WHEN {has(TERMS['weather'])} THEN 'Weather' ELSE 'Unknown' END AS category FROM cls""")
add("status_flags", f"WITH {PARSED} SELECT message_id, status, flags FROM cls")
add("clear_type_class", f"WITH {DOCS} SELECT message_id, CASE " + " ".join(f"WHEN {has([w])} THEN {q(r)}" for w, r in TERMS["types"] if r) + " END AS clear_type FROM docs")
TERM_TABLE = """bw AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\-]+', ' ', 'g')), ' ')) AS name FROM benchmark),
terms AS (SELECT ('0x' || substr(md5(name), 1, 12))::BIGINT AS place_id, name FROM bw WHERE length(name) >= 8)"""
MENTIONS = f"""{TERM_TABLE}, body AS (SELECT message_id, trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\-]+', ' ', 'g')) AS w FROM docs),
men AS (SELECT message_id, name FROM body, terms WHERE contains(w, name)),
mg AS (SELECT message_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(length(name)) AS longest FROM men GROUP BY 1)"""
add("place_mentions", f"WITH {DOCS}, {MENTIONS} SELECT message_id, n, names, longest FROM mg")
add("place_mentions_indexed", f"WITH {DOCS}, {MENTIONS} SELECT message_id, n, names FROM mg")
add("word_places", f"""WITH {DOCS}, {TERM_TABLE}, w AS (SELECT DISTINCT message_id, unnest(regexp_split_to_array(t, '[ ,;\\-–()]+')) AS w FROM docs)
  SELECT message_id, count(*) AS n, min(name) AS first_name FROM w JOIN terms ON name = w WHERE length(w) >= 3 GROUP BY 1""")
add("best_place", f"""WITH {TERM_TABLE}, ph AS (SELECT DISTINCT trim(p) AS phrase FROM (SELECT unnest(regexp_split_to_array(lower(text), '[.,!?\\n]+')) AS p FROM benchmark) WHERE length(trim(p)) > 0)
  SELECT phrase, name FROM (SELECT phrase, name, row_number() OVER (PARTITION BY phrase ORDER BY (name <> phrase), length(name) DESC, place_id) AS r
  FROM ph JOIN terms ON contains(phrase, name)) WHERE r = 1""")
add("admin_places", "SELECT p_partkey, p_size % 3 IN (0, 1) AS is_admin FROM part")
SCORED = f"""{PARSED}, {MENTIONS}, sc AS (SELECT c.*, coalesce(mg.n, 0) AS np FROM cls c LEFT JOIN mg USING (message_id)),
cf AS (SELECT *, greatest(0e0, least(1e0, 0.4e0 + CASE WHEN np > 0 THEN least(0.3e0, np * 0.1e0) ELSE -0.1e0 END
  + CASE WHEN type <> 'Unknown' THEN 0.2e0 ELSE 0e0 END + CASE WHEN status = 'Active' THEN 0.05e0 ELSE 0e0 END)) AS raw FROM sc),
scored AS (SELECT *, CASE WHEN np = 0 THEN least(raw, 0.3e0) ELSE raw END AS confidence,
  CASE WHEN np = 0 THEN CASE WHEN flags = '' THEN 'NoSettlements' ELSE flags || ',NoSettlements' END ELSE flags END AS all_flags FROM cf)"""
add("confidence_score", f"WITH {SCORED} SELECT message_id, round(confidence, 6) AS confidence, all_flags AS flags FROM scored")
add("message_route", f"""WITH {SCORED} SELECT CASE WHEN np > 0 THEN 'located' WHEN status <> 'Active' OR all_flags <> '' THEN 'clear' ELSE 'plain' END AS route, status, count(*) AS n FROM scored GROUP BY 1, 2""")
add("sender_filter", """SELECT doc_id AS message_id, source AS sender FROM documents WHERE (contains(lower(source), 'src1') OR contains(lower(source), 'src2'))
  AND NOT (contains(lower(source), 'rc12') OR contains(lower(source), 'src20'))""")
add("channel_filter", "SELECT doc_id AS message_id, source AS sender FROM documents WHERE lower(source) IN ('src3', 'src7')")
add("nonblank_messages", r"""SELECT doc_id AS message_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE length(regexp_replace(line, '[\s\p{Z}]+', '', 'g')) > 0 GROUP BY 1""")
add("priority_order", ORACLE["priority_class"])
SPACE = r"[\t-\r\x{85}\p{Z}]+"
CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\t-\r\x{{85}}\p{{Z}}]+', '', 'g'), '[\x{{10000}}-\x{{10FFFF}}\x{{2600}}-\x{{26FF}}]', '', 'g'), '{SPACE}', ' ', 'g'))"
add("clean_text", f"SELECT doc_id AS message_id, md5({CLEAN}) AS digest FROM documents")
TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\-]+'), lambda x: length(x) >= {n}{stop}))"
add("token_counts", "SELECT doc_id AS message_id, len(k) AS n, md5(array_to_string(list_sort(k), ',')) AS digest FROM (SELECT doc_id, "
    + TOK.format(n=2, stop=" AND x NOT IN ('and', 'the', 'und')") + " AS k FROM documents)")
PAY = rf"trim(regexp_replace(replace(regexp_replace('TG: ' || text, '[\x{{10000}}-\x{{10FFFF}}]', '', 'g'), '[Telegram]', 'TG:'), '{SPACE}', ' ', 'g'))"
add("payload_text", f"""WITH p AS (SELECT doc_id, {PAY} AS s FROM documents), c AS (SELECT doc_id, s, strlen(s) AS b FROM p),
  k AS (SELECT doc_id, s, b, unnest(range(0, 121)) AS i FROM c), m AS (SELECT doc_id, s, b, max(i) FILTER (strlen(substr(s, 1, i)) <= 120) AS i FROM k GROUP BY 1, 2, 3),
  o AS (SELECT doc_id, CASE WHEN b <= 120 THEN s ELSE substr(s, 1, i) || '...' END AS o FROM m)
  SELECT doc_id AS message_id, strlen(o) AS n_bytes, md5(o) AS digest FROM o""")
# RE2 knows ASCII word borders only: a word is matched with its neighbours, twice, as two words may share one
EDGE, MARKED = r"[^\p{L}\p{M}\p{N}\p{Pc}]", "text"
for short, long, mark in (("the", "THE-LONG", "chr(1)"), ("der", "DER-LANG", "chr(2)")):
    for _ in range(2):
        MARKED = rf"regexp_replace({MARKED}, '(^|{EDGE}){short}($|{EDGE})', '\1' || {mark} || '\2', 'gi')"
    MARKED = f"replace({MARKED}, {mark}, '{long}')"
add("abbreviations", f"SELECT doc_id AS message_id, md5({MARKED}) AS digest FROM documents")

# --- duplicates ----------------------------------------------------------------------------------------------------------------
NORM = (rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        rf"lower(regexp_replace(text, '[\x{{10000}}-\x{{10FFFF}}]|\p{{So}}', '', 'g')), "
        rf"'канал[\t-\r\x{{85}}\p{{Z}}]+в[\t-\r\x{{85}}\p{{Z}}]+max[\t-\r\x{{85}}\p{{Z}}]*-?', '', 'g'), "
        rf"'канал[\t-\r\x{{85}}\p{{Z}}]+оповещения[\t-\r\x{{85}}\p{{Z}}]*\"[^\"]*\"', '', 'g'), "
        rf"'резервный[\t-\r\x{{85}}\p{{Z}}]+канал[\t-\r\x{{85}}\p{{Z}}]+мах-подпишись', '', 'g'), "
        rf"'https?://[^\t-\r\x{{85}}\p{{Z}}]+', '', 'g'), '{SPACE}', ' ', 'g'))")
NORMED = rf"nd AS (SELECT doc_id AS message_id, lang, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS ts, regexp_replace({NORM}, '\b\d{{1,2}}[:.-]\d{{2}}\b', '<TIME>', 'g') AS t FROM documents)"
add("exact_dups", f"WITH {NORMED} SELECT upper(md5(t)) AS hash, min(message_id) AS first_id, count(*) AS copies FROM nd GROUP BY 1 HAVING count(*) > 1")
# levenshtein() counts bytes: letters outside ASCII are first mapped to unused single-byte ones
FOLD = "translate(t, 'áàâäãåéèêëíìîïóòôöõúùûüñçßœæ¿¡«»“”‘’–—…€°', 'ABCDFGHJKLNOPQRSUVWXYZ' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24))"
NEAR = f"""fd AS MATERIALIZED (SELECT *, {FOLD} AS f FROM nd),
  o AS MATERIALIZED (SELECT message_id, lang, ts, t, f, length(t) AS n, row_number() OVER (PARTITION BY lang ORDER BY ts, message_id) AS k,
    list_distinct(list_transform(range(1, length(f) - 3), lambda i: hash(substr(f, i, 5)))) AS g FROM fd),
  b AS MATERIALIZED (SELECT a.message_id, b.message_id AS earlier_id, greatest(a.n, b.n) AS w, a.t = b.t AS same, a.f AS af, b.f AS bf, a.g AS ag, b.g AS bg
    FROM o a JOIN o b ON a.lang = b.lang AND b.k < a.k AND b.ts >= a.ts - INTERVAL 120 SECOND
    AND abs(a.n - b.n) <= 0.1 * greatest(a.n, b.n) + 1e-9),
  p AS MATERIALIZED (SELECT * FROM b WHERE same OR len(ag) - len(list_intersect(ag, bg)) <= 5 * floor(0.1 * w + 1e-9)),
  c AS (SELECT message_id, earlier_id, w, CASE WHEN same THEN 0 ELSE levenshtein(af, bf) END AS d FROM p),
  near AS (SELECT message_id, earlier_id, CASE WHEN w = 0 THEN 1e0 ELSE 1e0 - d / w::DOUBLE END AS similarity FROM c
    WHERE CASE WHEN w = 0 THEN 1e0 ELSE 1e0 - d / w::DOUBLE END >= 0.9)"""
add("near_dup_pairs", f"WITH {NORMED}, {NEAR} SELECT message_id, earlier_id, round(similarity, 6) AS similarity FROM near")
CHATS = f"""chats AS (SELECT conv_id AS chat, conv_id * 1000 + turn AS message_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS reply_to, text,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 45) AS ts, {TYPE.format('conv_id + turn')} AS type,
  CASE WHEN role = 'user' THEN 1 + turn % 2 ELSE 0 END AS n_places, {TOK.format(n=3, stop='')} AS tokens FROM conversations)"""
add("bigram_jaccard", f"""WITH {CHATS}, p AS (SELECT message_id, text, lag(message_id) OVER w AS earlier_id, lag(text) OVER w AS ptext FROM chats WINDOW w AS (PARTITION BY chat ORDER BY ts, message_id)),
  b AS (SELECT message_id, earlier_id, list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS x,
    list_distinct(list_transform(range(1, length(ptext)), lambda i: substr(ptext, i, 2))) AS y FROM p WHERE earlier_id IS NOT NULL)
  SELECT message_id, earlier_id, round(CASE WHEN len(x) + len(y) = 0 THEN 0e0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS jaccard FROM b""")
add("compact_messages", "SELECT upper(md5(text)) AS hash, max(doc_id) AS message_id, arg_max(source, doc_id) AS sender FROM documents GROUP BY 1")

# --- context -------------------------------------------------------------------------------------------------------------------
CTX = """pa AS (SELECT c.*, CASE WHEN n_places > 0 THEN 0.75e0 ELSE 0.3e0 END AS conf FROM chats c)"""
add("reply_context", f"""WITH {CHATS}, {CTX} SELECT a.message_id, CASE WHEN use THEN ptype ELSE type END AS type, CASE WHEN use THEN pn ELSE n_places END AS n_places,
  round(CASE WHEN use THEN greatest(conf, 0.8e0 * pconf) ELSE conf END, 6) AS confidence,
  concat_ws(',', CASE WHEN n_places = 0 THEN 'NoSettlements' END, CASE WHEN use THEN 'ContextFromReply' END) AS flags
  FROM (SELECT m.*, p.type AS ptype, p.n_places AS pn, p.conf AS pconf, p.message_id IS NOT NULL AND m.n_places = 0 AS use
    FROM pa m LEFT JOIN pa p ON p.chat = m.chat AND p.message_id = m.reply_to) a""")
CAND = """num AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, message_id) AS k FROM chats),
cand AS (SELECT a.message_id, a.tokens AS own, a.type, b.message_id AS id, b.tokens AS other, b.type AS otype, b.ts AS bts,
  greatest(0e0, 1 - (epoch_us(a.ts) - epoch_us(b.ts)) / 6e7 / 5) AS fresh
  FROM num a JOIN num b ON a.chat = b.chat AND b.k BETWEEN a.k - 20 AND a.k - 1 AND b.ts >= a.ts - INTERVAL 5 MINUTE
  WHERE a.n_places = 0 AND b.n_places > 0)"""
SIMPLE = CAND + """,
ss AS (SELECT message_id, id, bts, CASE WHEN greatest(len(own), len(other)) = 0 THEN 0e0 ELSE len(list_intersect(own, other)) / greatest(len(own), len(other))::DOUBLE END
  + CASE WHEN type = otype THEN 0.2e0 ELSE 0e0 END + 0.1e0 * fresh AS score FROM cand),
simple AS (SELECT message_id, id AS context_id, score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, bts, id) AS r FROM ss) WHERE r = 1 AND score >= 0.3)"""
TFIDF = """,
cw AS (SELECT message_id, id, unnest(other) AS w FROM cand),
nc AS (SELECT message_id, count(*) AS n FROM cand GROUP BY 1),
idf AS (SELECT message_id, w, pow(ln((any_value(n) + 1) // (count(*) + 1)) + 1, 2) AS sq FROM cw JOIN nc USING (message_id) GROUP BY 1, 2),
ow AS (SELECT message_id, unnest(own) AS w FROM (SELECT DISTINCT message_id, own FROM cand)),
osq AS (SELECT message_id, sum(coalesce(sq, 1e0)) AS s FROM ow LEFT JOIN idf USING (message_id, w) GROUP BY 1),
csq AS (SELECT message_id, id, sum(sq) AS s, sum(CASE WHEN ow.w IS NOT NULL THEN sq END) AS dot FROM cw JOIN idf USING (message_id, w) LEFT JOIN ow USING (message_id, w) GROUP BY 1, 2),
ts AS (SELECT c.message_id, c.id, c.bts, round(coalesce(dot / (sqrt(osq.s) * sqrt(csq.s)), 0e0) + CASE WHEN type = otype THEN 0.1e0 ELSE 0e0 END + 0.05e0 * fresh, 9) AS score
  FROM cand c LEFT JOIN csq USING (message_id, id) LEFT JOIN osq USING (message_id)),
tfidf AS (SELECT message_id, id AS context_id, score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, bts, id) AS r FROM ts) WHERE r = 1 AND score >= 0.3)"""
add("token_context", f"WITH {CHATS}, {SIMPLE} SELECT message_id, context_id, round(score, 6) AS score FROM simple")
add("tfidf_context", f"WITH {CHATS}, {SIMPLE}{TFIDF} SELECT message_id, context_id, round(score, 6) AS score FROM tfidf")
add("ensemble_context", f"""WITH {CHATS}, {SIMPLE}{TFIDF}, j AS (SELECT message_id, s.context_id AS s, t.context_id AS t FROM simple s FULL JOIN tfidf t USING (message_id))
  SELECT j.message_id, CASE WHEN t IS NULL OR s = t THEN s WHEN s IS NULL THEN t WHEN a.n_places > b.n_places THEN s WHEN a.n_places < b.n_places THEN t
    WHEN a.ts > b.ts THEN s ELSE t END AS context_id FROM j LEFT JOIN chats a ON a.message_id = s LEFT JOIN chats b ON b.message_id = t""")
add("context_applied", f"""WITH {CHATS}, {CTX}, {SIMPLE}
  SELECT m.message_id, CASE WHEN p.message_id IS NOT NULL THEN p.type ELSE m.type END AS type,
  round(CASE WHEN p.message_id IS NOT NULL THEN greatest(m.conf, 0.7e0 * p.conf) ELSE m.conf END, 6) AS confidence,
  concat_ws(',', CASE WHEN m.n_places = 0 THEN 'NoSettlements' END, CASE WHEN p.message_id IS NOT NULL THEN 'ContextApplied' END) AS flags
  FROM pa m LEFT JOIN simple s USING (message_id) LEFT JOIN pa p ON p.message_id = s.context_id""")

# --- sources --------------------------------------------------------------------------------------------------------------------
LAB = """lab AS (SELECT d.doc_id AS message_id, source AS sender, quality = 1 AS ok FROM documents d JOIN labels l USING (doc_id)),
rel AS (SELECT sender AS name, count(*) AS total, count(*) FILTER (ok) AS n_confirmed, least(1e0, (0.5e0 + count(*) FILTER (ok) / count(*)::DOUBLE) / 2) AS weight FROM lab GROUP BY 1)"""
add("source_reliability", f"WITH {LAB} SELECT name, total, n_confirmed, round(weight, 6) AS weight FROM rel")
add("source_history", f"""WITH {LAB}, h AS (SELECT sender, message_id, count(*) OVER w AS total, sum(ok::INT) OVER w::BIGINT AS n_confirmed FROM lab
  WINDOW w AS (PARTITION BY sender ORDER BY message_id)) SELECT *, round(least(1e0, (0.5e0 + n_confirmed / total::DOUBLE) / 2), 6) AS weight FROM h""")
add("source_adjusted", f"""WITH {SCORED}, {LAB} SELECT s.message_id, round(coalesce(r.weight, 0.5e0), 6) AS source_weight,
  round(CASE WHEN np > 0 THEN least(1e0, confidence * (0.5e0 + 0.5e0 * coalesce(r.weight, 0.5e0))) ELSE confidence END, 6) AS confidence FROM scored s LEFT JOIN rel r ON r.name = s.sender""")
add("source_reset", f"""WITH {LAB}, b AS (SELECT name, 0.5e0 AS i, weight AS w FROM rel UNION ALL SELECT DISTINCT source || '-x', 0.7e0, 0.7e0 FROM documents)
  SELECT b.name, CASE WHEN r.name IS NOT NULL THEN 0.9e0 ELSE i END AS initial_weight, round(CASE WHEN r.name IS NOT NULL THEN 0.9e0 ELSE w END, 6) AS weight
  FROM b LEFT JOIN (SELECT name FROM rel WHERE name LIKE '%1') r ON r.name = b.name""")
add("place_upsert", f"""WITH {PLACES}, n AS (SELECT place_id + 1000000 AS place_id, CASE WHEN place_id % 8 = 0 THEN name ELSE name || '-new' END AS name, lat + 1 AS lat, lon FROM places WHERE place_id % 4 = 0),
  u AS (SELECT * FROM places WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT * FROM n)
  SELECT place_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM u""")

# --- incidents from messages ----------------------------------------------------------------------------------------------------
SIGHT = POINTS + """,
sight AS (SELECT user_id // 10 AS scope, type, ts, event_id AS message_id, place, lat, lon, event_type,
  event_type = 'error' AND event_id % 3 = 0 AS lost FROM points)"""
add("linked_incidents", f"""WITH {SIGHT}, s AS (SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM sight WHERE event_type <> 'error'
  WINDOW w AS (PARTITION BY scope, type ORDER BY ts, message_id)),
  g AS (SELECT *, {KM} AS km, (epoch_us(ts) - epoch_us(pts)) / 6e7 AS mins FROM s),
  c AS (SELECT *, CASE WHEN pts IS NULL THEN 1 WHEN mins < 0.1 THEN CASE WHEN km <= least({max_km('type')} * 0.3e0, 15e0) + 3 THEN 0 ELSE 1 END
    WHEN km <= {speed('type')} * (mins / 60) * 1.05e0 AND km <= {max_km('type')} + 3 AND mins <= {life('type', 30)} THEN 0 ELSE 1 END AS st FROM g)
  SELECT scope, type, message_id, place, sum(st) OVER (PARTITION BY scope, type ORDER BY ts, message_id)::BIGINT AS link_no FROM c""")
add("session_incidents", f"""WITH {SIGHT}, s AS (SELECT scope, type, ts, message_id, {life('type', 30)} AS lf, lag(ts) OVER (PARTITION BY scope, type ORDER BY ts, message_id) AS pts FROM sight),
  c AS (SELECT *, sum(CASE WHEN pts IS NULL OR ts >= pts + to_minutes(lf) THEN 1 ELSE 0 END) OVER (PARTITION BY scope, type ORDER BY ts, message_id) AS k FROM s)
  SELECT scope, type, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + any_value(lf)::BIGINT * 60000000 AS end_us, count(*) AS n FROM c GROUP BY scope, type, k""")
CLEARS = f"clears AS (SELECT user_id // 10 AS scope, {TYPE.format('user_id')} AS type, ts AS clear_ts, event_id AS clear_id FROM events WHERE event_type = 'error')"
SCOPED = "sc AS (SELECT *, incident_id // 1000000 AS scope FROM inc)"
add("all_clear_typed", f"""WITH {POINTS}{INC}, {CLEARS}, {SCOPED} SELECT incident_id, epoch_us(min(clear_ts)) AS closed_us FROM sc JOIN clears c ON c.scope = sc.scope AND c.type = sc.type
  AND clear_ts > last_seen AND clear_ts <= last_seen + to_minutes({life('sc.type', 120)}) WHERE {OPEN} GROUP BY 1""")
add("all_clear_latest", f"""WITH {POINTS}{INC}, {CLEARS}, {SCOPED} SELECT clear_id, arg_max(incident_id, last_seen) AS incident_id FROM clears c JOIN sc ON c.scope = sc.scope
  AND last_seen <= clear_ts AND last_seen > clear_ts - INTERVAL 30 MINUTE WHERE {OPEN} GROUP BY 1""")
add("auto_close", f"""WITH {POINTS}{INC}, fp AS (SELECT incident_id, arg_min(place, ts) AS place FROM points GROUP BY 1)
  SELECT DISTINCT i.incident_id FROM inc i JOIN fp USING (incident_id) JOIN points c ON c.place = fp.place AND c.mark = 'Terminated'
  AND c.ts BETWEEN first_seen - INTERVAL 1 HOUR AND last_seen + INTERVAL 1 HOUR WHERE {OPEN}""")

# --- archives and payloads ---------------------------------------------------------------------------------------------------------
ARCH = """arc AS (SELECT (conv_id * 1000 + turn)::VARCHAR AS message_id, CASE WHEN turn % 4 = 0 THEN role ELSE 'chat ' || conv_id END AS sender,
  CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'turn ' || text ELSE role || ' ' || text END AS text,
  CASE WHEN turn % 2 = 0 OR turn % 5 <> 4 THEN TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 45) END AS at_time,
  CASE WHEN turn > 0 THEN (conv_id * 1000 + turn - 1)::VARCHAR END AS reply_to FROM conversations WHERE turn % 11 <> 10)"""
add("archive_flatten", f"WITH {ARCH} SELECT message_id, sender, text, epoch_us(at_time) AS received_us, reply_to, at_time IS NULL AS rejected FROM arc")
add("archive_quality", f"WITH {ARCH} SELECT count(*) AS total, count(at_time) AS kept, count(*) - count(at_time) AS no_date, epoch_us(min(at_time)) AS first_us, epoch_us(max(at_time)) AS last_us FROM arc")
add("archive_hours", f"WITH {ARCH}, k AS (SELECT * FROM arc WHERE at_time IS NOT NULL) " + HOURS.format(t="at_time", o=0, s="k", k=5))
add("archive_edges", f"""WITH {ARCH} SELECT * FROM (SELECT 'first' AS side, message_id, epoch_us(at_time) AS received_us FROM arc WHERE at_time IS NOT NULL ORDER BY at_time, message_id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'last', message_id, epoch_us(at_time) FROM arc WHERE at_time IS NOT NULL ORDER BY at_time DESC, message_id DESC LIMIT 5)""")
add("payload_json", f"""WITH {SIGHT}, j AS (SELECT message_id, '{{"timestamp":"' || strftime(ts, '%H:%M:%S') || '","sender":"channel ' || scope || '","threat":"' || type || '","category":"'
  || CASE WHEN type = 'Rocket' THEN 'Missile' ELSE 'Drone' END || '","settlements":"' || CASE WHEN lost THEN '' ELSE place END || '","direction":"","status":"' || {MARK}
  || '","confidence":0.5,"text":"message number ' || message_id || '"}}' AS p FROM sight)
  SELECT message_id, CASE WHEN length(p) > 200 THEN substr(p, 1, 197) || '...' ELSE p END AS payload FROM j""")

# --- streams ---------------------------------------------------------------------------------------------------------------------
add("hourly_counts", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY 1")
add("stream_first_ids", "SELECT 'feed' AS source_type, count(DISTINCT event_id % 5000) AS n FROM events")
add("stream_first_texts", f"WITH {NORMED} SELECT lang, count(DISTINCT t) AS n, count(DISTINCT t) AS n_hashes FROM nd GROUP BY 1")
