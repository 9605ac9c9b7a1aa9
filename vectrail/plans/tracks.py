"""Queries on tracks and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import places
from vectrail.operators import tracks
from vectrail.plans import sql
from vectrail.sources import tables


def _track(spark, sf):
    return tracks.greedy_track(tables.located(spark, sf), tracks.reach_km(tables.cameras(spark)))


def _walked(spark, sf):
    return tracks.walked(tables.located(spark, sf), tracks.reach_km(tables.cameras(spark)))


def greedy_track(spark, sf):
    """Accepted and rejected sightings of every entity."""
    return _track(spark, sf).select("sighting_id", "entity_id", "accepted", "conflict_with", *(F.round(c, 4).alias(c) for c in ("km", "gap_min", "need_kmh")))


def track_summary(spark, sf):
    """Sightings, accepted and rejected ones by entity."""
    return _track(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected"))


def place_roles(spark, sf):
    d = tracks.place_roles(tracks.accepted_sightings(_walked(spark, sf)))
    return d.withColumn("hours", F.round("hours", 6)).withColumn("confidence", F.round("confidence", 6))


def covered_nights(spark, sf):
    """Stays that last at 03:00 local time, with the number of such dates."""
    d = tables.sightings(spark, sf).withColumn("dwell_min", F.col("dwell_min") * 3)
    return d.select("sighting_id", F.size(tracks.covered_dates(F.col("ts"), F.col("dwell_min"), tracks.NIGHT_HOUR)).cast("long").alias("nights")).where("nights > 0")


def mean_stay_clock(spark, sf):
    """Circular mean of the local minute of the day, by kind of sighting."""
    t = places.local(F.col("ts"))
    return tables.sightings(spark, sf).groupBy("kind").agg(F.round(places.mean_clock_minutes(F.hour(t) * 60 + F.minute(t)), 3).alias("minute"))


def nearest_camera(spark, sf):
    """Each parking's nearest road camera; the registry has a fixed 100 rows."""
    cams = tables.cameras(spark)
    road = cams.where("kind = 'road'").select(F.col("camera_id").alias("road_id"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    km = places.haversine_km(*map(F.col, ("lat", "lon", "rlat", "rlon")))
    d = cams.where("kind = 'parking'").crossJoin(F.broadcast(road)).withColumn("km", km)
    best = d.groupBy("camera_id").agg(F.min(F.struct(F.round("km", 9).alias("km"), "road_id")).alias("b"))
    return best.select("camera_id", "b.road_id", F.round("b.km", 6).alias("km"))


QUERIES = {f.__name__: f for f in (greedy_track, track_summary, place_roles, covered_nights, mean_stay_clock, nearest_camera)}

_ANGLE = "(hour(t) * 60 + minute(t)) * 2 * pi() / 1440"
_MINUTE = "CAST(floor(({0} % 1440 + 1440) % 1440 + 0.5) AS BIGINT)"
_HHMM = f"printf('%02d:%02d', {_MINUTE} // 60 % 24, {_MINUTE} % 60)"
_REGULAR = "least(0.95, {0} / {1} * (1 - exp(-{0} / 5.0::DOUBLE)))"
ORACLES = {
    "greedy_track": f"WITH RECURSIVE {sql.TRACK} SELECT sighting_id, entity_id, accepted, conflict_with, round(km, 4) AS km, round(gap_min, 4) AS gap_min, round(need_kmh, 4) AS need_kmh FROM track",
    "track_summary": f"WITH RECURSIVE {sql.TRACK} SELECT entity_id, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted) AS n_rejected FROM track GROUP BY entity_id",
    "place_roles": f"""WITH RECURSIVE {sql.TRACK}, {sql.PLACES}
SELECT entity_id, place, row_number() OVER (PARTITION BY entity_id ORDER BY list_position(['night', 'day', 'trip', 'episodic'], role), hours DESC, place) AS position, role, city, n_stays, round(hours, 6) AS hours, days, n_night, n_day,
round(CASE role WHEN 'night' THEN {_REGULAR.format("n_night", "all_night")} WHEN 'day' THEN {_REGULAR.format("n_day", "all_day")} END, 6) AS confidence,
CASE role WHEN 'night' THEN {_HHMM.format("na")} || '-' || {_HHMM.format("nb")} WHEN 'day' THEN {_HHMM.format("wa")} || '-' || {_HHMM.format("wb")} END AS "window" FROM roles""",
    "covered_nights": f"""WITH {sql.SIGHTINGS},
s AS (SELECT sighting_id, ts + INTERVAL 3 HOUR AS a, ts + INTERVAL 3 HOUR + to_minutes(dwell_min * 3) AS b FROM si WHERE dwell_min > 0),
d AS (SELECT sighting_id, a, b, unnest(generate_series(date_trunc('day', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) + INTERVAL 3 HOUR AS t FROM s)
SELECT sighting_id, count(*) AS nights FROM d WHERE t >= a AND t <= b GROUP BY sighting_id""",
    "mean_stay_clock": f"""WITH {sql.SIGHTINGS}, l AS (SELECT kind, ts + INTERVAL 3 HOUR AS t FROM si),
m AS (SELECT kind, atan2(sum(sin({_ANGLE})), sum(cos({_ANGLE}))) * 1440 / (2 * pi()) AS m FROM l GROUP BY kind)
SELECT kind, round(CASE WHEN m < 0 THEN m + 1440 ELSE m END, 3) AS minute FROM m""",
    "nearest_camera": f"""WITH {sql.CAMERAS},
d AS (SELECT p.camera_id, r.camera_id AS road_id, round({sql.HAVERSINE.format(a="p", b="r")}, 9) AS km FROM cam p, cam r WHERE p.kind = 'parking' AND r.kind = 'road')
SELECT camera_id, road_id, round(km, 6) AS km FROM d QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY d.km, road_id) = 1""",
}
