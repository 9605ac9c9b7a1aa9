"""DuckDB fragments that the queries' SQL shares."""

from __future__ import annotations

BASE = """
base AS (
  SELECT vec_id AS pos, 'img_' || vec_id AS image_id, label AS vehicle_id, vec_id % 7 AS camera_id,
         CAST((vec_id * 37) % 1900 AS INTEGER) AS x, CAST((vec_id * 53) % 1060 AS INTEGER) AS y,
         CAST(40 + (vec_id * 11) % 400 AS INTEGER) AS w, CAST(30 + (vec_id * 13) % 300 AS INTEGER) AS h,
         CASE WHEN vec_id % 11 = 0 THEN '1.1.0' ELSE '1.2.0' END AS model_version,
         CASE WHEN vec_id % 3 = 0 THEN 'P' || vec_id END AS plate, embedding::DOUBLE[] AS v
  FROM embeddings)"""

SIDES = f"""{BASE},
q AS (SELECT * FROM base WHERE pos % 5 = 0),
g AS (SELECT * FROM base WHERE pos % 5 <> 0 AND vehicle_id NOT IN (8, 9))"""

PAIRS = f"""{SIDES},
pairs AS (
  SELECT q.pos AS qpos, g.pos AS gpos, q.vehicle_id AS qv, g.vehicle_id AS gv, q.camera_id AS qc, g.camera_id AS gc, g.model_version,
         list_dot_product(q.v, g.v) AS score
  FROM q, g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qpos ORDER BY score DESC, gpos) AS rank FROM pairs),
top10 AS (SELECT * FROM ranked WHERE rank <= 10)"""

COUNTS = """
counts AS (
  SELECT q.pos AS qpos, count(*) FILTER (q.vehicle_id = g.vehicle_id AND q.camera_id <> g.camera_id) AS n_pos,
         count(*) FILTER (q.vehicle_id = g.vehicle_id AND q.camera_id = g.camera_id) AS n_junk
  FROM q, g GROUP BY q.pos)"""


def average_precision(source: str, k: int | None) -> str:
    """CTEs s and ap over ``source``."""
    cut, top = (f"WHERE r <= {k}", f"least(n_pos, {k})") if k else ("", "n_pos")
    return f"""
s AS (SELECT qpos, CAST(qv = gv AND qc <> gc AS INTEGER) AS hit, row_number() OVER (PARTITION BY qpos ORDER BY rank) AS r FROM {source} WHERE NOT (qv = gv AND qc = gc)),
s2 AS (SELECT *, sum(hit) OVER (PARTITION BY qpos ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM s),
ap AS (
  SELECT c.qpos, n_pos, coalesce(x / {top}, 0.0) AS ap, coalesce(n_pos / last, 0.0) AS inp, first_hit
  FROM counts c LEFT JOIN (
    SELECT qpos, sum(CASE WHEN hit = 1 THEN hits / r END) AS x, max(CASE WHEN hit = 1 THEN r END) AS last, min(CASE WHEN hit = 1 THEN r END) AS first_hit
    FROM s2 {cut} GROUP BY qpos) p ON c.qpos = p.qpos
  WHERE n_pos > 0)"""


DECIDED = """
d AS (
  SELECT c.qpos, t.score, coalesce(qv = gv, false) AS correct, n_pos > 0 AS has_match, coalesce(t.score >= 0.35, false) AS accepted
  FROM counts c LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) t ON c.qpos = t.qpos),
o AS (SELECT *, CASE WHEN accepted AND correct AND has_match THEN 'tp' WHEN accepted THEN 'fp' WHEN has_match THEN 'fn' ELSE 'tn' END AS outcome FROM d)"""

RATES = """
pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall FROM c),
rt AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, CAST(tn AS DOUBLE) / nullif(n_open, 0) AS tnr FROM pr),
rq AS (SELECT *, 0.7::DOUBLE * f1 + 0.3::DOUBLE * coalesce(tnr, 0.0) AS q FROM rt)"""

CONFUSION = """
c AS (SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
             count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (NOT has_match) AS n_open FROM o)"""

SWEEP = """
b AS (SELECT score AS threshold, count(*) AS n, count(*) FILTER (correct AND has_match) AS t, count(*) FILTER (has_match) AS m FROM o WHERE score IS NOT NULL GROUP BY score),
tot AS (SELECT count(*) FILTER (has_match) AS all_m, count(*) FILTER (NOT has_match) AS n_open FROM o),
u AS (SELECT threshold, sum(n) OVER w AS accepted, sum(t) OVER w AS tp, sum(m) OVER w AS known FROM b WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(accepted - tp AS BIGINT) AS fp, CAST(all_m - known AS BIGINT) AS fn, CAST(n_open - (accepted - known) AS BIGINT) AS tn, n_open FROM u, tot)"""

CAMERAS = """
cam AS (
  SELECT CAST(id AS BIGINT) AS camera_id, 55.50::DOUBLE + ((id * 37) % 97) * 0.005::DOUBLE AS lat, 37.30::DOUBLE + ((id * 53) % 89) * 0.008::DOUBLE AS lon,
         CASE WHEN id < 80 THEN 'home' ELSE 'city_' || (id % 5) END AS city, CASE WHEN id % 4 = 0 THEN 'parking' ELSE 'road' END AS kind
  FROM range(100) AS r(id))"""

SIGHTINGS = f"""{CAMERAS},
si AS (
  SELECT event_id AS sighting_id, user_id AS entity_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS camera_id, ts,
         CASE event_type WHEN 'purchase' THEN 'real' WHEN 'error' THEN 'lookalike' ELSE 'sim' END AS kind, value / 600 AS confidence,
         CASE WHEN event_type = 'signup' THEN CAST(floor(value * 3) AS BIGINT) END AS dwell_min
  FROM events),
lo AS (SELECT si.*, lat, lon, city, cam.kind AS camera_kind FROM si JOIN cam USING (camera_id))"""

HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0)))"


def _trip(a: str, b: str) -> str:
    """A struct km, gap, top of the trip between two sightings; null if one is missing."""
    km = f"CASE WHEN {a}.cam = {b}.cam THEN 0.0 ELSE 1.3 * {HAVERSINE.format(a=a, b=b)} END"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {{'km': ({km})::DOUBLE, 'gap': (({b}.us - {a}.us) / 60e6 - {a}.dwell)::DOUBLE, 'top': CASE WHEN {a}.city = 'home' AND {b}.city = 'home' THEN 90 ELSE 130 END}} END"


_BAD = "60 * {t}.km > {t}.top * greatest({t}.gap + 10, 0)"
#: Needs WITH RECURSIVE. Each step checks every entity's next sighting against the list of those kept so far.
TRACK = f"""{SIGHTINGS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE kind WHEN 'real' THEN 0 WHEN 'sim' THEN 1 ELSE 2 END, coalesce(confidence, 0) DESC, ts, sighting_id) AS n FROM lo),
sight AS (SELECT entity_id, n, {{'us': epoch_us(ts), 'k': n, 'id': sighting_id, 'cam': camera_id, 'lat': lat, 'lon': lon, 'city': city, 'dwell': coalesce(dwell_min, 0)::DOUBLE}} AS s FROM ordered),
walk AS (SELECT entity_id, n, s, [s] AS kept, NULL::BIGINT AS conflict_with, NULL::DOUBLE AS km, NULL::DOUBLE AS gap FROM sight WHERE n = 1
UNION ALL SELECT entity_id, n, s, CASE WHEN c IS NULL THEN list_append(kept, s) ELSE kept END, c.id, c.km, c.gap FROM (
SELECT *, CASE WHEN {_BAD.format(t="t")} THEN {{'id': a.id, 'km': t.km, 'gap': t.gap}} WHEN {_BAD.format(t="u")} THEN {{'id': b.id, 'km': u.km, 'gap': u.gap}} END AS c FROM (
SELECT *, {_trip("a", "s")} AS t, {_trip("s", "b")} AS u FROM (
SELECT x.entity_id, x.n, x.s, w.kept, list_max(list_filter(w.kept, lambda y: y.us <= x.s.us)) AS a, list_min(list_filter(w.kept, lambda y: y.us > x.s.us)) AS b
FROM walk w JOIN sight x ON x.entity_id = w.entity_id AND x.n = w.n + 1)))),
track AS (SELECT s.id AS sighting_id, entity_id, conflict_with IS NULL AS accepted, conflict_with, km, gap AS gap_min, 60 * km / greatest(gap, 0.5) AS need_kmh FROM walk)"""

#: Needs TRACK. Stays join the first place within 0.3 km of its running centre, in order of time.
PLACES = f"""
stay AS (SELECT lo.*, row_number() OVER (PARTITION BY lo.entity_id ORDER BY ts, sighting_id) AS n FROM lo JOIN track USING (sighting_id) WHERE accepted AND dwell_min > 0),
grown AS (SELECT entity_id, n, sighting_id, [{{'lat': lat, 'lon': lon, 'n': 1}}] AS centres, CAST(1 AS BIGINT) AS place FROM stay WHERE n = 1
UNION ALL SELECT entity_id, n, sighting_id, CASE WHEN near IS NULL THEN list_append(centres, {{'lat': lat, 'lon': lon, 'n': 1}})
ELSE list_transform(centres, lambda c, i: CASE WHEN i = near THEN {{'lat': (c.lat * c.n + lat) / (c.n + 1), 'lon': (c.lon * c.n + lon) / (c.n + 1), 'n': c.n + 1}} ELSE c END) END, coalesce(near, len(centres) + 1) FROM (
SELECT x.entity_id, x.n, x.sighting_id, x.lat, x.lon, g.centres, list_min(list_filter(list_transform(g.centres, lambda c, i: CASE WHEN {HAVERSINE.format(a="c", b="x")} <= 0.3 THEN i END), lambda i: i IS NOT NULL)) AS near
FROM grown g JOIN stay x ON x.entity_id = g.entity_id AND x.n = g.n + 1)),
placed AS (SELECT stay.*, place, stay.ts + INTERVAL 3 HOUR AS a, stay.ts + INTERVAL 3 HOUR + to_minutes(dwell_min) AS b FROM stay JOIN grown USING (sighting_id)),
days AS (SELECT *, unnest(generate_series(date_trunc('day', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM placed),
covered AS (SELECT *, day + INTERVAL 3 HOUR BETWEEN a AND b AS night, isodow(day) <= 5 AND day + INTERVAL 13 HOUR BETWEEN a AND b AS work FROM days),
marked AS (SELECT *, EXISTS (SELECT 1 FROM covered c WHERE c.sighting_id = p.sighting_id AND night) AS nights, EXISTS (SELECT 1 FROM covered c WHERE c.sighting_id = p.sighting_id AND work) AS works FROM placed p),
of_place AS (SELECT entity_id, place, min_by(city, {{'t': ts, 'i': sighting_id}}) AS city, count(*) AS n_stays, sum(dwell_min) / 60 AS hours, count(DISTINCT a::DATE) AS days,
{{clock_night_a}} AS na, {{clock_night_b}} AS nb, {{clock_work_a}} AS wa, {{clock_work_b}} AS wb FROM marked GROUP BY ALL),
seen AS (SELECT entity_id, place, count(DISTINCT day) FILTER (night) AS n_night, count(DISTINCT day) FILTER (work) AS n_day FROM covered GROUP BY ALL),
seen_all AS (SELECT entity_id, count(DISTINCT day) FILTER (night) AS all_night, count(DISTINCT day) FILTER (work) AS all_day FROM covered GROUP BY ALL),
roles AS (SELECT *, CASE WHEN n_night >= 4 THEN 'night' WHEN n_day >= 4 THEN 'day' WHEN city <> 'home' THEN 'trip' ELSE 'episodic' END AS role FROM of_place JOIN seen USING (entity_id, place) JOIN seen_all USING (entity_id))"""


def _clock(t: str, where: str) -> str:
    angle = f"(hour({t}) * 60 + minute({t})) * 2 * pi() / 1440"
    return f"atan2(sum(sin({angle})) FILTER ({where}), sum(cos({angle})) FILTER ({where})) * 1440 / (2 * pi())"


PLACES = PLACES.replace("{clock_night_a}", _clock("a", "nights")).replace("{clock_night_b}", _clock("b", "nights")).replace("{clock_work_a}", _clock("a", "works")).replace("{clock_work_b}", _clock("b", "works"))
