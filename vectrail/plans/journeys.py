"""Queries on entity journeys and the index: frames, timelines, day layers, camera assignment, formats, tagging, approximate search."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from vectrail.functions import places
from vectrail.operators import ivfpq, ranking, tracks
from vectrail.plans import sql
from vectrail.plans.tracks import _walked
from vectrail.sources import tables
from vectrail.sources.shared import place
from vectrail.streaming import tagging


def fnv1a(text: Column) -> Column:
    """FNV-1a (32 bits) of an ASCII string's characters."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    # products of 32-bit numbers with the prime fit a long: the prime is 2**24 + 403
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def camera_of_image(spark, sf):
    """Every image's camera by the hash of its id over the 60 road cameras of the home city."""
    road = tables.cameras(spark).where("kind = 'road' AND city = 'home'").withColumn("slot", F.row_number().over(Window.orderBy("camera_id")) - 1).select("slot", F.col("camera_id").alias("cam"))
    d = tables.gallery_base(spark, sf).select("pos", fnv1a(F.col("image_id")).alias("hash")).withColumn("slot", F.col("hash") % 60)
    return d.join(F.broadcast(road), "slot").select("pos", "hash", "cam")


def entity_frames(spark, sf):
    """Frames of each query's vehicle among its first 100 candidates, and the first other candidate as look-alike."""
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    d = ranking.top_k(q, g, 100).join(q.selectExpr("pos AS qpos", "vehicle_id AS qv"), "qpos").join(g.selectExpr("pos AS gpos", "vehicle_id AS gv"), "gpos")
    own = F.col("qv") == F.col("gv")
    return d.groupBy("qpos").agg(F.count_if(own).alias("frames"), F.min_by("gpos", F.when(own, F.col("rank"))).alias("first"), F.min_by("gpos", F.when(~own, F.col("rank"))).alias("lookalike"))


def latest_sightings(spark, sf):
    """The five latest sightings of every entity."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("sighting_id"))
    return tables.sightings(spark, sf).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("entity_id", "place", "sighting_id")


def timeline(spark, sf):
    """Days of every entity, newest first, with the day's sightings in order of time."""
    d = tables.sightings(spark, sf).withColumn("day", F.to_date(places.local(F.col("ts"))))
    d = d.groupBy("entity_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "sighting_id"))).alias("s"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("day"))
    return d.select("entity_id", F.row_number().over(order).cast("long").alias("place"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.concat_ws(",", F.transform("s", lambda x: x["sighting_id"].cast("string"))).alias("sightings"))


def time_parts(spark, sf):
    """Local date, weekday (Monday 0), hour, minute, midnight and clock of sightings."""
    t = places.local(F.col("ts"))
    midnight = (F.unix_micros(F.date_trunc("day", t)) - places.UTC_HOURS * 3_600_000_000).alias("midnight_us")
    return tables.sightings(spark, sf).select("sighting_id", F.date_format(t, "yyyy-MM-dd").alias("day"), F.weekday(t).alias("weekday"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), midnight, F.date_format(t, "HH:mm").alias("clock"))


def day_layers(spark, sf):
    """Per entity and day the points in order with their line, and bounds; a single point gets a margin of 0.01."""
    d = tables.located(spark, sf).withColumn("day", F.date_format(places.local(F.col("ts")), "yyyy-MM-dd"))
    pad = F.when(F.col("n") > 1, 0.0).otherwise(0.01)
    d = d.groupBy("entity_id", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "sighting_id", "camera_id"))).alias("s"), *[f(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("lo", F.min), ("hi", F.max))])
    line = F.when(F.col("n") > 1, F.concat_ws(">", F.transform("s", lambda x: x["camera_id"].cast("string"))))
    return d.select("entity_id", "day", "n", line.alias("line"), *[F.round(F.col(f"lo_{c}") - pad, 6).alias(f"lo_{c}") for c in ("lat", "lon")], *[F.round(F.col(f"hi_{c}") + pad, 6).alias(f"hi_{c}") for c in ("lat", "lon")])


def route_stats(spark, sf):
    """Per entity: sightings that the track accepts, real ones, places of nights or working days, cities, and rejected ones."""
    d = _walked(spark, sf)
    ok, real = F.col("accepted"), F.col("rank") == 0
    roles = tracks.place_roles(tracks.accepted_sightings(d)).groupBy("entity_id").agg(F.count_if(F.col("role").isin("night", "day")).alias("regular"))
    d = d.groupBy("entity_id").agg(F.count_if(ok).alias("sightings"), F.count_if(ok & real).alias("real"), F.countDistinct(F.when(ok, F.col("city"))).alias("cities"), F.count_if(~ok).alias("rejected"))
    return d.join(roles, "entity_id", "left").withColumn("regular", F.coalesce("regular", F.lit(0)).cast("long"))


def registry_cameras(spark, sf):
    """Cameras along streets: number i stands on street i mod 25, in the middle of part i div 25 of four."""
    d = spark.range(96).selectExpr("id", "id % 25 AS street", "id DIV 25 AS part")
    at = lambda a, b: F.round(a + (b - a) * ((F.col("part") + 0.5) / 4) + 1e-9, 5)
    s = F.col("street")
    return d.select("id", "street", "part", at(55.5 + s * 0.01, 55.6 + s * 0.012).alias("lat"), at(37.3 + s * 0.02, 37.4 + s * 0.015).alias("lon"))


def detour_ranking(spark, sf):
    """The two road cameras with the smallest detour between every two neighbouring parkings; the registry has a fixed 100 rows."""
    cams = tables.cameras(spark)
    w = Window.orderBy("camera_id")
    p = cams.where("kind = 'parking'").select("camera_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat").over(w).alias("blat"), F.lead("lon").over(w).alias("blon")).where("blat IS NOT NULL")
    road = F.broadcast(cams.where("kind = 'road'").select(F.col("camera_id").alias("road_id"), "lat", "lon"))
    km = lambda *c: places.haversine_km(*map(F.col, c))
    d = p.crossJoin(road).withColumn("km", F.round(km("alat", "alon", "lat", "lon") + km("lat", "lon", "blat", "blon") - km("alat", "alon", "blat", "blon"), 8))
    order = Window.partitionBy("camera_id").orderBy("km", "road_id")
    return d.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 2").select("camera_id", "place", "road_id", F.round("km", 6).alias("km"))


def plural_forms(spark, sf):
    """Plural form (0 one, 1 few, 2 many), per cent and duration texts of numbers."""
    n, ten, hundred = F.col("id"), F.col("id") % 10, F.col("id") % 100
    form = F.when((ten == 1) & (hundred != 11), 0).when(ten.between(2, 4) & ~hundred.between(12, 14), 1).otherwise(2)
    duration = F.when(n * 36 < 1000, F.concat((n * 36).cast("string"), F.lit(" ms"))).otherwise(F.concat(F.translate(F.format_string("%.2f", n * 36 / 1000), ".", ","), F.lit(" s")))
    return spark.range(130).select("id", form.alias("form"), F.concat(F.translate(F.format_string("%.0f", n / 2 * 2), ".", ","), F.lit(" %")).alias("percent"), duration.alias("duration"))


def tagging_queue(spark, sf):
    """Items through the tagging stream with a back end that tags by the crop's first byte and fails on some."""
    root = place(spark, "tagging")
    crop = F.when(F.col("pos") % 13 != 0, F.encode(F.concat(F.chr(97 + F.col("pos") % 5), "image_id"), "utf-8"))
    tables.gallery_base(spark, sf).select(F.col("pos").alias("item_id"), crop.alias("crop")).repartition(4).write.parquet(f"{root}/in")

    def backend(data: bytes) -> list[tuple[str, float]]:
        if data[:1] == b"e":
            raise ValueError("no model for it")
        return [(data[:1].decode(), 0.5)] if data[:1] != b"d" else []

    tagging.tag_stream(spark, f"{root}/in", f"{root}/out", f"{root}/progress", backend, files_at_once=2).awaitTermination()
    d = spark.read.parquet(f"{root}/out")
    tags = tagging.current_tags(d).groupBy("item_id").agg(F.concat_ws(",", F.collect_list("tag")).alias("tag"))
    return d.select("item_id", "error").join(tags, "item_id", "left").select("item_id", F.col("error").alias("error"), "tag")


def _index(spark, sf):
    """A new index of the gallery on the shared folder, opened from there."""
    path = place(spark, "index")
    ivfpq.build(tables.gallery(spark, sf).select("pos", "embedding"), path)
    return ivfpq.load(spark, path)


def ann_search(spark, sf):
    """The best ten by codes of all cells, a tenth of the rows scored exactly."""
    index = _index(spark, sf)
    d = ivfpq.search(tables.queries(spark, sf).select("pos", "embedding"), index, len(index.model.centres), index.rows // 10)
    return d.select("qpos", F.col("rank").cast("long").alias("rank"), "gpos", F.round("score", 6).alias("score"))


def ann_sweep(spark, sf):
    """Recall of the first ten, share of rows compared by code and re-ranked, for growing probes and re-ranks.

    These vectors hardly cluster, so that few cells find few of the neighbours; the last setting is that of ``ann_search``.
    """
    q, index = tables.queries(spark, sf).select("pos", "embedding"), _index(spark, sf)
    cells, rows = len(index.model.centres), index.rows
    settings = [(cells // 8, rows // 50), (cells // 2, rows // 20), (cells * 3 // 4, rows // 20), (cells, rows // 20), (cells, rows // 10)]
    d = ivfpq.sweep(q, index, ranking.top_k(q, tables.gallery(spark, sf)), settings)
    return d.select("probes", "rerank", "n", *[F.round(c, 4).alias(c) for c in ("recall", "compared", "scored")])


def ann_recall(spark, sf):
    """Recall at 10 of ``ann_search`` against the exact search, and whether at most a tenth of the rows was scored."""
    q, index = tables.queries(spark, sf).select("pos", "embedding"), _index(spark, sf)
    d = ivfpq.sweep(q, index, ranking.top_k(q, tables.gallery(spark, sf)), [(len(index.model.centres), index.rows // 10)])
    return d.select("n", F.round("recall", 2).alias("recall"), (F.col("scored") <= 0.1).alias("few"))


_NAMES = """
camera_of_image entity_frames latest_sightings timeline time_parts day_layers route_stats registry_cameras detour_ranking plural_forms tagging_queue ann_search
ann_sweep ann_recall
"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

ORACLES = {
    "camera_of_image": f"""WITH RECURSIVE {sql.BASE}, {sql.CAMERAS},
h AS (SELECT pos, image_id, 0 AS i, CAST(2166136261 AS BIGINT) AS hash FROM base
UNION ALL SELECT pos, image_id, i + 1, xor(hash, CAST(ascii(image_id[i + 1]) AS BIGINT)) * 16777619 & 4294967295 FROM h WHERE i < length(image_id)),
r AS (SELECT camera_id, row_number() OVER (ORDER BY camera_id) - 1 AS slot FROM cam WHERE kind = 'road' AND city = 'home')
SELECT pos, hash, camera_id AS cam FROM h JOIN r ON hash % 60 = slot WHERE i = length(image_id)""",
    "entity_frames": f"""WITH {sql.PAIRS} SELECT qpos, count(*) FILTER (qv = gv) AS frames, min_by(gpos, rank) FILTER (qv = gv) AS first, min_by(gpos, rank) FILTER (qv <> gv) AS lookalike FROM ranked WHERE rank <= 100 GROUP BY qpos""",
    "latest_sightings": f"WITH {sql.SIGHTINGS} SELECT entity_id, row_number() OVER w AS place, sighting_id FROM si WINDOW w AS (PARTITION BY entity_id ORDER BY ts DESC, sighting_id DESC) QUALIFY row_number() OVER w <= 5",
    "timeline": f"""WITH {sql.SIGHTINGS}, d AS (SELECT entity_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, string_agg(sighting_id::VARCHAR, ',' ORDER BY ts, sighting_id) AS sightings FROM si GROUP BY ALL)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS place, day, sightings FROM d""",
    "time_parts": f"""WITH {sql.SIGHTINGS}, l AS (SELECT sighting_id, ts + INTERVAL 3 HOUR AS t FROM si)
SELECT sighting_id, strftime(t, '%Y-%m-%d') AS day, CAST(isodow(t) - 1 AS INTEGER) AS weekday, CAST(hour(t) AS INTEGER) AS hour, CAST(minute(t) AS INTEGER) AS minute, epoch_us(date_trunc('day', t)) - 10800000000 AS midnight_us, strftime(t, '%H:%M') AS clock FROM l""",
    "day_layers": f"""WITH {sql.SIGHTINGS}, d AS (SELECT entity_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, count(*) AS n, string_agg(camera_id::VARCHAR, '>' ORDER BY ts, sighting_id) AS line,
min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM lo GROUP BY ALL), p AS (SELECT *, CASE WHEN n > 1 THEN 0.0 ELSE 0.01 END::DOUBLE AS pad FROM d)
SELECT entity_id, day, n, CASE WHEN n > 1 THEN line END AS line, round(a - pad, 6) AS lo_lat, round(b + pad, 6) AS hi_lat, round(c - pad, 6) AS lo_lon, round(e + pad, 6) AS hi_lon FROM p""",
    "route_stats": f"""WITH RECURSIVE {sql.TRACK}, {sql.PLACES}, r AS (SELECT entity_id, count(*) FILTER (role IN ('night', 'day')) AS regular FROM roles GROUP BY entity_id),
j AS (SELECT lo.entity_id, count(*) FILTER (accepted) AS sightings, count(*) FILTER (accepted AND kind = 'real') AS real, count(DISTINCT city) FILTER (accepted) AS cities, count(*) FILTER (NOT accepted) AS rejected FROM lo JOIN track USING (sighting_id) GROUP BY ALL)
SELECT j.*, coalesce(regular, 0) AS regular FROM j LEFT JOIN r USING (entity_id)""",
    "registry_cameras": """WITH d AS (SELECT i AS id, i % 25 AS s, i // 25 AS k FROM range(96) t(i)),
e AS (SELECT id, s, k, 55.5::DOUBLE + s * 0.01::DOUBLE AS a, 55.6::DOUBLE + s * 0.012::DOUBLE AS b, 37.3::DOUBLE + s * 0.02::DOUBLE AS c, 37.4::DOUBLE + s * 0.015::DOUBLE AS d FROM d)
SELECT id, s AS street, CAST(k AS BIGINT) AS part, round(a + (b - a) * ((k + 0.5) / 4)::DOUBLE + 1e-9, 5) AS lat, round(c + (d - c) * ((k + 0.5) / 4)::DOUBLE + 1e-9, 5) AS lon FROM e""",
    "detour_ranking": f"""WITH {sql.CAMERAS}, o AS (SELECT *, lead(camera_id) OVER (ORDER BY camera_id) AS nxt FROM cam WHERE kind = 'parking'),
d AS (SELECT o.camera_id, r.camera_id AS road_id, round({sql.HAVERSINE.format(a="o", b="r")} + {sql.HAVERSINE.format(a="r", b="p")} - {sql.HAVERSINE.format(a="o", b="p")}, 8) AS km FROM o JOIN cam p ON p.camera_id = o.nxt, cam r WHERE r.kind = 'road')
SELECT camera_id, row_number() OVER w AS place, road_id, round(km, 6) AS km FROM d WINDOW w AS (PARTITION BY camera_id ORDER BY d.km, road_id) QUALIFY row_number() OVER w <= 2""",
    "plural_forms": """SELECT i AS id, CASE WHEN i % 10 = 1 AND i % 100 <> 11 THEN 0 WHEN i % 10 BETWEEN 2 AND 4 AND i % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END AS form, i || chr(8239) || '%' AS percent,
CASE WHEN i * 36 < 1000 THEN (i * 36) || ' ms' ELSE replace(printf('%.2f', i * 36 / 1000), '.', ',') || ' s' END AS duration FROM range(130) t(i)""",
    "tagging_queue": """SELECT vec_id AS item_id, CASE WHEN vec_id % 13 <> 0 AND vec_id % 5 = 4 THEN 'ValueError: no model for it' END AS error, CASE WHEN vec_id % 13 <> 0 AND vec_id % 5 < 3 THEN chr(CAST(97 + vec_id % 5 AS INTEGER)) END AS tag FROM embeddings""",
    "ann_recall": "SELECT count(*) FILTER (vec_id % 5 = 0) AS n, 1.0::DOUBLE AS recall, true AS few FROM embeddings",
    "ann_search": f"WITH {sql.PAIRS} SELECT qpos, rank, gpos, round(score, 6) AS score FROM top10",
}
