"""Queries on camera sightings: trips, heat, cities, look-alikes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import places
from vectrail.plans import sql
from vectrail.sources import tables


def feasibility_consecutive(spark, sf):
    """Each sighting's trip from the entity's previous one: km, minutes, needed speed, feasible."""
    w = Window.partitionBy("entity_id").orderBy("ts", "sighting_id")
    d = tables.located(spark, sf)
    for c in ("camera_id", "lat", "lon", "city", "ts", "dwell_min"):
        d = d.withColumn(f"p_{c}", F.lag(c).over(w))
    d = d.where("p_camera_id IS NOT NULL")
    km = F.when(F.col("camera_id") == F.col("p_camera_id"), 0.0).otherwise(places.ROAD_FACTOR * places.haversine_km(*map(F.col, ("p_lat", "p_lon", "lat", "lon"))))
    d = d.withColumn("km", km).withColumn("gap", places.minutes_between(F.col("p_ts"), F.col("p_dwell_min"), F.col("ts")))
    home = (F.col("city") == "home") & (F.col("p_city") == "home")
    need = places.needed_kmh(F.col("km"), F.col("gap"))
    return d.select("sighting_id", F.round("km", 6).alias("km"), F.round("gap", 4).alias("gap_min"), F.round(need, 4).alias("need_kmh"), places.feasible(F.col("km"), F.col("gap"), home).alias("feasible"))


def heat_grid(spark, sf):
    """Sightings by local weekday (Monday 0) and hour, zeros included."""
    t = places.local(F.col("ts"))
    n = tables.sightings(spark, sf).groupBy(F.weekday(t).alias("day"), F.hour(t).alias("hour")).agg(F.count("*").alias("n"))
    grid = spark.range(168).selectExpr("cast(id DIV 24 AS int) AS day", "cast(id % 24 AS int) AS hour")
    return grid.join(n, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def city_stats(spark, sf):
    return tables.located(spark, sf).groupBy("city").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first"), F.max("ts").cast("timestamp_ntz").alias("last"))


def map_points(spark, sf):
    """Sightings per camera; a camera with a real one counts as real."""
    return tables.sightings(spark, sf).groupBy("camera_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "real").alias("real"))


QUERIES = {f.__name__: f for f in (feasibility_consecutive, heat_grid, city_stats, map_points)}

_HAV = sql.HAVERSINE.format(a="p", b="l")
ORACLES = {
    "feasibility_consecutive": f"""WITH {sql.SIGHTINGS},
n AS (SELECT *, lag(sighting_id) OVER (PARTITION BY entity_id ORDER BY ts, sighting_id) AS prev FROM lo),
t AS (SELECT l.sighting_id, CASE WHEN l.camera_id = p.camera_id THEN 0.0 ELSE 1.3::DOUBLE * {_HAV} END AS km,
             (epoch_us(l.ts) - epoch_us(p.ts)) / 60e6::DOUBLE - coalesce(p.dwell_min, 0) AS gap, l.city = 'home' AND p.city = 'home' AS home
      FROM n l JOIN lo p ON l.prev = p.sighting_id)
SELECT sighting_id, round(km, 6) AS km, round(gap, 4) AS gap_min, round(CASE WHEN km = 0 THEN 0.0 ELSE km / greatest(gap, 0.5) * 60 END, 4) AS need_kmh,
       km <= (CASE WHEN home THEN 90.0 ELSE 130.0 END)::DOUBLE * greatest(gap + 10, 0) / 60 AS feasible FROM t""",
    "heat_grid": f"""WITH {sql.SIGHTINGS}, h AS (SELECT isodow(ts + INTERVAL 3 HOUR) - 1 AS d, hour(ts + INTERVAL 3 HOUR) AS h, count(*) AS n FROM si GROUP BY ALL)
SELECT CAST(i // 24 AS INTEGER) AS day, CAST(i % 24 AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(168) AS r(i) LEFT JOIN h ON d = i // 24 AND h.h = i % 24""",
    "city_stats": f"WITH {sql.SIGHTINGS} SELECT city, count(*) AS n, min(ts) AS first, max(ts) AS last FROM lo GROUP BY city",
    "map_points": f"WITH {sql.SIGHTINGS} SELECT camera_id, count(*) AS n, bool_or(kind = 'real') AS real FROM si GROUP BY camera_id",
}
