"""The order-dependent jobs in SQL: recursive queries that carry the state of each scope from message to message.

Row k of a scope is made from row k - 1 and the k-th message. The state is a list: the open incidents, oldest first;
the retained messages; or the incidents already closed.
"""

from __future__ import annotations

from tocsin.catalog.oracle import (
    CLEARS, INC, MARK, NEAR, NORMED, OPEN, ORACLE, POINTS, SCOPED, SIGHT, hav, life, max_km, speed,
)

_POINT = "STRUCT(name VARCHAR, lat DOUBLE, lon DOUBLE, t BIGINT)"
_OPEN = (f"STRUCT(first BIGINT, root BIGINT, type VARCHAR, category VARCHAR, seen BIGINT, status VARCHAR, conf DOUBLE, "
         f"pts {_POINT}[], names VARCHAR[])")
_OUT = "STRUCT(root BIGINT, action VARCHAR, status VARCHAR, confidence DOUBLE, added BOOLEAN, recon BOOLEAN, gone VARCHAR, gone_t BIGINT)"


def _km(i: str) -> str:
    return hav(f"{i}.pts[-1].lat", f"{i}.pts[-1].lon", "lat", "lon")


def _travel(i: str) -> str:
    return f"{speed('type')} * ((t - {i}.seen) / 6e7 / 60) * 1.05e0"


def _far(i: str) -> str:
    return f"({_km(i)} > {max_km('type')} AND {_km(i)} <= {_travel(i)})"


def _same(i: str) -> str:
    mins = f"((t - {i}.seen) / 6e7)"
    return (f"(CASE WHEN {mins} < 0.1 THEN {_km(i)} <= least({max_km('type')} * 0.3e0, 15e0) + 3 "
            f"ELSE {_km(i)} <= {_travel(i)} AND {_km(i)} <= {max_km('type')} + 3 AND {mins} <= {life('type', 30)} END)")


def assign_sql(sight: str = "sight", more: str = "") -> str:
    """CTEs up to ``assigned``: what each row of ``sight`` did; ``more`` are CTEs that ``sight`` needs."""
    return SIGHT.replace("places AS", "RECURSIVE places AS", 1) + more + f""",
msg AS MATERIALIZED (SELECT scope, type, CASE WHEN type = 'Rocket' THEN 'Missile' ELSE 'Drone' END AS category, {MARK} AS status, ts, epoch_us(ts) AS t,
  message_id, place, lat, lon, lost, CASE WHEN lost AND message_id % 2 = 0 THEN type END AS clear_type,
  row_number() OVER (PARTITION BY scope ORDER BY ts, message_id) AS k FROM {sight}),
run AS (
  SELECT DISTINCT scope, 0::BIGINT AS k, []::{_OPEN}[] AS st, []::{_OUT}[] AS outs FROM msg
  UNION ALL
  SELECT scope, k,
    CASE WHEN status = 'Terminated' THEN list_filter(alive, lambda i: NOT list_contains(list_transform(closed, lambda c: c.root), i.root))
      WHEN lost THEN alive
      ELSE list_sort(list_append(list_filter(alive, lambda i: i.root <> now.root), now)) END,
    CASE WHEN len(closed) > 0 THEN list_transform(closed, lambda c: {{'root': c.root, 'action': CASE WHEN NOT lost THEN 'closed_by_place'
        WHEN clear_type IS NOT NULL THEN 'closed_by_type' ELSE 'closed_latest' END, 'status': 'Terminated', 'confidence': c.conf, 'added': false, 'recon': false, 'gone': NULL, 'gone_t': NULL}})
      WHEN status <> 'Terminated' AND NOT lost THEN [{{'root': now.root, 'action': CASE WHEN far THEN 'far' WHEN hit IS NULL THEN 'new' ELSE 'same' END,
        'status': now.status, 'confidence': now.conf, 'added': NOT known, 'recon': status = 'Watch',
        'gone': CASE WHEN far THEN base.pts[-1].name END, 'gone_t': CASE WHEN far THEN base.pts[-1].t END}}]
      ELSE [{{'root': NULL, 'action': 'none', 'status': NULL, 'confidence': NULL, 'added': false, 'recon': false, 'gone': NULL, 'gone_t': NULL}}] END
  FROM (SELECT *, {{'first': pts[1].t, 'root': base.root, 'type': base.type, 'category': base.category, 'seen': pts[-1].t,
      'status': CASE WHEN status = 'Watch' THEN 'Watch' ELSE base.status END,
      'conf': least(1e0, base.conf + CASE WHEN status = 'Watch' THEN 0.2e0 ELSE 0e0 END + 0.1e0), 'pts': pts, 'names': names}}::{_OPEN} AS now
    FROM (SELECT *, CASE WHEN known THEN kept ELSE list_append(kept, {{'name': place, 'lat': lat, 'lon': lon, 't': t}}::{_POINT}) END AS pts,
        CASE WHEN known OR list_contains(left_names, place) THEN left_names ELSE list_append(left_names, place) END AS names
      FROM (SELECT *, CASE WHEN far THEN base.pts[:len(base.pts) - 1] ELSE base.pts END AS kept,
          CASE WHEN far THEN list_filter(base.names, lambda n: n <> base.pts[-1].name) ELSE base.names END AS left_names,
          NOT far AND len(list_filter(base.pts, lambda p: lower(p.name) = lower(place) AND abs(p.lat - lat) < 1e-4 AND abs(p.lon - lon) < 1e-4)) > 0 AS known
        FROM (SELECT *, hit IS NOT NULL AND {_far('hit')} AS far,
            coalesce(hit, {{'first': t, 'root': message_id, 'type': type, 'category': category, 'seen': t, 'status': 'Active', 'conf': 0.5e0,
              'pts': []::{_POINT}[], 'names': []::VARCHAR[]}}::{_OPEN}) AS base
          FROM (SELECT *,
              CASE WHEN status <> 'Terminated' THEN []::{_OPEN}[]
                WHEN NOT lost THEN list_filter(alive, lambda i: list_contains(list_transform(i.names, lambda n: lower(n)), lower(place)))[1:1]
                WHEN clear_type IS NOT NULL THEN list_filter(alive, lambda i: lower(clear_type) IN (lower(i.type), lower(i.category)))
                ELSE list_transform(list_sort(list_transform(list_filter(alive, lambda i: t - i.seen < 1800000000),
                  lambda i: {{'o': -i.seen, 'i': i}}))[1:1], lambda x: x.i) END AS closed,
              CASE WHEN status <> 'Terminated' AND NOT lost THEN list_filter(alive,
                lambda i: (type = 'Unknown' OR lower(i.type) = lower(type)) AND ({_same('i')} OR {_far('i')}))[1] END AS hit
            FROM (SELECT m.*, list_filter(r.st, lambda i: m.t - i.seen <= {life('i.type', 120)} * 60000000::BIGINT) AS alive
              FROM run r JOIN msg m ON m.scope = r.scope AND m.k = r.k + 1))))))),
assigned AS (SELECT r.scope, r.k, m.ts, m.message_id, m.type, m.category, m.place, m.t, unnest(r.outs) AS o FROM run r JOIN msg m ON m.scope = r.scope AND m.k = r.k)"""


ASSIGN = assign_sql()
ASSIGNED_ROWS = f"""WITH {ASSIGN} SELECT scope, message_id, o.root AS root, o.action AS action, o.status AS status, round(o.confidence, 6) AS confidence FROM assigned"""
TABLE = f"""
tab0 AS (SELECT scope, o.root AS root, arg_min(type, k) FILTER (s) AS type, arg_min(category, k) FILTER (s) AS category, min(ts) FILTER (s) AS first_seen,
  max(ts) FILTER (s AND o.added) AS last_seen, arg_max(o.status, k) AS status, arg_max(o.confidence, k) AS confidence, bool_or(o.recon) AS has_recon,
  max(ts) FILTER (o.recon) AS recon_time, count(*) FILTER (s) AS n_messages
  FROM (SELECT *, o.action IN ('new', 'same', 'far') AS s FROM assigned WHERE o.root IS NOT NULL) GROUP BY 1, 2)"""

ORACLE["incident_assign"] = ASSIGNED_ROWS
ORACLE["stream_assign"] = ASSIGNED_ROWS
# an incident ran out if a later message of its scope found it idle, or the watermark, ten minutes behind the latest message, passed that time
ORACLE["stream_expired"] = f"""WITH {ASSIGN}, {TABLE}, due AS (SELECT *, epoch_us(last_seen) + {life('type', 120)} * 60000000::BIGINT AS due FROM tab0 WHERE status IN ('Active', 'Watch')),
  ends AS (SELECT scope, epoch_us(max(ts)) AS last FROM sight GROUP BY 1)
  SELECT scope, root, type, due AS expired_us, round(confidence, 6) AS confidence FROM due JOIN ends USING (scope)
  WHERE due < last OR due // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM sight)"""
ORACLE["incident_table"] = f"""WITH {ASSIGN}, {TABLE}
  SELECT scope, root, type, category, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us,
    CASE WHEN status IN ('Active', 'Watch') AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_seen) > {life('type', 120)} * 60000000::BIGINT THEN 'Expired' ELSE status END AS status,
    round(confidence, 6) AS confidence, has_recon, epoch_us(recon_time) AS recon_us, n_messages FROM tab0"""

ORACLE["retained_messages"] = f"""WITH RECURSIVE {NORMED}, {NEAR}, sims AS (
    SELECT message_id, list({{'e': earlier_id, 's': similarity}}) AS near FROM near GROUP BY 1),
  msg AS (SELECT n.message_id, n.lang, epoch_us(n.ts) AS t, s.near, row_number() OVER (PARTITION BY n.lang ORDER BY n.ts, n.message_id) AS k
    FROM nd n LEFT JOIN sims s USING (message_id) WHERE n.t IS NOT NULL),
  run AS (
    SELECT DISTINCT lang, 0::BIGINT AS k, []::STRUCT(t BIGINT, id BIGINT)[] AS kept, NULL::BIGINT AS message_id, NULL::STRUCT(o DOUBLE, p INT, e BIGINT) AS hit FROM msg
    UNION ALL
    SELECT lang, k, CASE WHEN hit IS NOT NULL THEN held ELSE list_append(held, {{'t': t, 'id': message_id}})[-50:] END, message_id, hit
    FROM (SELECT *, list_sort(list_transform(list_filter(near, lambda x: list_contains(ids, x.e)),
          lambda x: {{'o': -x.s, 'p': list_position(ids, x.e), 'e': x.e}}))[1]::STRUCT(o DOUBLE, p INT, e BIGINT) AS hit
      FROM (SELECT *, list_transform(held, lambda x: x.id) AS ids
        FROM (SELECT m.*, list_filter(r.kept, lambda x: x.t >= m.t - 120000000) AS held FROM run r JOIN msg m ON m.lang IS NOT DISTINCT FROM r.lang AND m.k = r.k + 1))))
  SELECT message_id, hit.e AS duplicate_of, round(-hit.o, 6) AS similarity FROM run WHERE k > 0
  UNION ALL SELECT message_id, NULL, NULL FROM nd WHERE t IS NULL"""

ORACLE["all_clear_place"] = f"""WITH {(POINTS + INC).replace("places AS", "RECURSIVE places AS", 1)}, {CLEARS}, {SCOPED},
  cl AS (SELECT c.*, p.place, row_number() OVER (PARTITION BY c.scope ORDER BY clear_ts, clear_id) AS k FROM clears c JOIN points p ON p.event_id = c.clear_id),
  cand AS (SELECT clear_id, list_transform(list_sort(list(DISTINCT {{'f': first_seen, 'i': sc.incident_id}})), lambda x: x.i) AS ids
    FROM cl JOIN sc ON sc.scope = cl.scope AND first_seen <= clear_ts AND clear_ts <= last_seen + to_minutes({life('sc.type', 120)}) AND {OPEN}
    JOIN points p ON p.incident_id = sc.incident_id AND lower(p.place) = lower(cl.place) AND p.ts <= cl.clear_ts GROUP BY 1),
  run AS (
    SELECT DISTINCT scope, 0::BIGINT AS k, []::BIGINT[] AS closed, NULL::BIGINT AS clear_id, NULL::BIGINT AS incident_id FROM cl
    UNION ALL
    SELECT scope, k, CASE WHEN pick IS NULL THEN closed ELSE list_append(closed, pick) END, clear_id, pick
    FROM (SELECT c.scope, c.k, c.clear_id, r.closed, list_filter(d.ids, lambda i: NOT list_contains(r.closed, i))[1] AS pick
      FROM run r JOIN cl c ON c.scope = r.scope AND c.k = r.k + 1 LEFT JOIN cand d ON d.clear_id = c.clear_id))
  SELECT clear_id, incident_id FROM run WHERE incident_id IS NOT NULL"""

# --- the live flow: weekly slices, every 37th message a slice late ---------------------------------------------------------------
FEED = """,
feed0 AS (SELECT *, epoch(ts)::BIGINT // 604800 AS wk FROM sight),
feed1 AS (SELECT *, wk + CASE WHEN message_id % 37 = 0 AND wk < (SELECT max(wk) FROM feed0) THEN 1 ELSE 0 END AS slice FROM feed0),
tops AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM feed1 GROUP BY slice),
feed AS (SELECT f.*, coalesce(ts < top - INTERVAL 10 MINUTE, false) AS late FROM feed1 f JOIN tops USING (slice)),
in_time AS (SELECT * FROM feed WHERE NOT late)"""
ORACLE["live_late"] = f"WITH {SIGHT}{FEED} SELECT scope, message_id, late FROM feed"
ORACLE["live_rerun"] = ASSIGNED_ROWS
ORACLE["live_alerts"] = f"""WITH {assign_sql("in_time", FEED)},
  rows AS MATERIALIZED (SELECT *, epoch(ts)::BIGINT // 604800 * 604800 AS version FROM assigned),
  versions AS (SELECT DISTINCT version FROM rows WHERE o.added),
  pts AS MATERIALIZED (SELECT v.version, r.scope, o.root AS root, r.type, r.place, r.t, r.message_id FROM versions v JOIN rows r ON r.t < v.version * 1000000 WHERE o.added
    AND NOT EXISTS (SELECT 1 FROM rows g WHERE g.scope = r.scope AND g.o.root = r.o.root AND g.o.gone = r.place AND g.o.gone_t = r.t AND g.t < v.version * 1000000)),
  fst AS MATERIALIZED (SELECT version, scope, root, type, place, min({{'t': t, 'i': message_id}}) AS f FROM pts GROUP BY ALL),
  mvd AS (SELECT version, type, place AS to_place, lag(place) OVER (PARTITION BY version, scope, root ORDER BY f) AS from_place FROM fst),
  tn AS (SELECT version, type, from_place, to_place, count(*) AS n FROM mvd WHERE from_place IS NOT NULL GROUP BY ALL),
  tp AS (SELECT *, n / sum(n) OVER (PARTITION BY version, type, from_place)::DOUBLE AS prob FROM tn),
  tr AS (SELECT *, row_number() OVER (PARTITION BY version, type, from_place ORDER BY prob DESC, to_place) AS r FROM tp),
  best AS (SELECT version, type, from_place AS place, list(to_place ORDER BY r) AS nxt, max(prob) AS p FROM tr WHERE r <= 3 GROUP BY ALL),
  fc AS (SELECT r.scope, r.message_id, r.o.root AS root, r.ts, r.version, r.type, r.category, r.o.status AS status, r.place, coalesce(nxt, []) AS nxt,
    r.o.confidence * (0.5e0 + 0.5e0 * coalesce(p, 0e0)) AS confidence
    FROM rows r LEFT JOIN best b ON b.version = r.version AND b.type = r.type AND b.place = r.place WHERE r.o.added AND r.o.status IN ('Active', 'Watch')),
  al AS (SELECT *, '{{"timestamp":"' || strftime(ts, '%H:%M:%S') || '","sender":"channel ' || scope || '","threat":"' || type || '","category":"' || category
    || '","settlements":"' || array_to_string(list_prepend(place, nxt), ',') || '","direction":"","status":"' || status || '","confidence":'
    || round(confidence, 3) || ',"text":"' || place || ' -> ' || array_to_string(nxt, ', ') || '"}}' AS p FROM fc WHERE confidence >= 0.6e0)
  SELECT scope, message_id, root, version, place, array_to_string(nxt, ',') AS next_places, round(confidence, 6) AS confidence,
    CASE WHEN length(p) > 200 THEN substr(p, 1, 197) || '...' ELSE p END AS payload FROM al"""
