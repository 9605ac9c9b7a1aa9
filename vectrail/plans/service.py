"""Queries on the search and gallery service: lookups, rules, composed searches, exports, import reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import boxes
from vectrail.operators import gallery, ranking
from vectrail.plans import sql
from vectrail.plans.retrieval import _TOK, ALPHA, THRESHOLD
from vectrail.sources import tables
from vectrail.sources.tables import FRAME_H, FRAME_W


def _base(spark, sf):
    d = tables.gallery_base(spark, sf)
    return d.withColumn("crop_uri", F.when(F.col("pos") % 9 != 0, F.concat(F.lit(f"{gallery.CROP_ROOT}/"), "image_id", F.lit(".jpg"))).otherwise(F.lit("s3://cropsx/other.jpg")))


def item_tags(spark, sf):
    """Tags of the items of one camera, as the search side reads them."""
    items = tables.gallery(spark, sf).where("camera_id = 3").select(F.col("pos").alias("item_id"))
    return tables.tags(spark, sf).join(items, "item_id", "left_semi").select("item_id", "tag", F.round("confidence", 6).alias("confidence"))


def crop_uri_lookup(spark, sf):
    """One item's crop, none if the id is unknown."""
    return _base(spark, sf).where("pos = 17").select("pos", "crop_uri").limit(1)


def tag_regions(spark, sf):
    """Tags with their region where all four numbers are there."""
    r = gallery.region(*(F.col(f"box_{c}") for c in "xywh"))
    return tables.tags(spark, sf).withColumn("r", r).select("item_id", "tag", F.col("r").isNotNull().alias("has_region"), "r.x", "r.y", "r.w", "r.h")


def gallery_insert(spark, sf):
    """New items appended; every fourth came without an id."""
    d = tables.gallery_base(spark, sf).select("pos", F.expr("if(pos % 4 = 0, if(pos % 8 = 0, NULL, ' '), image_id)").alias("image_id"))
    d = gallery.inserted(d, tables.CURRENT_VERSION)
    own = F.col("image_id").startswith("img_")
    return d.select("pos", F.when(own, F.col("image_id")).otherwise("random").alias("image_id"), F.length("image_id").alias("chars"), "model_version", F.size("tags").cast("long").alias("n_tags")).withColumn("chars", F.when(~F.col("image_id").startswith("img_"), F.col("chars")).cast("long"))


def gallery_count(spark, sf):
    return tables.gallery_base(spark, sf).agg(F.count("*").alias("n"))


def item_with_tags(spark, sf):
    """Items with their tags in order, an empty list where there are none."""
    tags = tables.tags(spark, sf).where("tag <> 'kind_1'").groupBy("item_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("tag"))).alias("tags"))
    return tables.gallery_base(spark, sf).join(tags, F.col("pos") == F.col("item_id"), "left").select("pos", "image_id", F.coalesce("tags", F.lit("")).alias("tags"))


def current_versions(spark, sf):
    """Items of one given version."""
    return tables.gallery_base(spark, sf).where("model_version = '1.1.0'").select("pos", "vehicle_id")


def plate_rule(spark, sf):
    """What setting a plate does: error, cleared or set."""
    plate = F.expr("CASE pos % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN repeat('ж', cast(30 + pos % 6 AS int)) WHEN 3 THEN concat(' A', pos, ' ') ELSE '' END")
    d = tables.gallery_base(spark, sf).select("pos", plate.alias("new"))
    problem = gallery.plate_problem(F.col("new"))
    return d.select("pos", F.coalesce(problem, F.when(F.col("new").isNull(), "cleared").otherwise("set")).alias("result"), F.when(problem.isNull(), F.trim("new")).alias("plate"))


def page_clamp(spark, sf):
    """Page requests, odd ones too, over the gallery's count."""
    n = tables.gallery_base(spark, sf).agg(F.count("*").alias("total"))
    d = spark.range(40).selectExpr("id", "if(id % 7 = 0, NULL, id - 5) AS page", "if(id % 5 = 0, NULL, id * 13 - 40) AS size")
    return d.crossJoin(F.broadcast(n)).select("id", *[c.cast("long").alias(k) for c, k in zip(gallery.page_columns(*map(F.col, ("page", "size", "total"))), ("offset", "limit", "pages"), strict=True)])


def top_n_clamp(spark, sf):
    return spark.range(30).select("id", gallery.top_n(F.expr("if(id % 6 = 0, NULL, id * 9 - 50)")).cast("long").alias("top_n"))


def _search(spark, sf):
    cards = _base(spark, sf).where("pos % 6 <> 0").select("pos", "image_id", "plate", gallery.crop_url(F.col("crop_uri")).alias("url"))
    return gallery.search(tables.queries(spark, sf), tables.gallery(spark, sf), cards, THRESHOLD, 3, ALPHA)


def search_cards(spark, sf):
    """Searches with blended confidence, in its order, with every candidate's card and acceptance."""
    return _search(spark, sf).select("qpos", "place", "gpos", F.round("confidence", 6).alias("confidence"), "accepted", "image_id", "plate", "url")


def search_export(spark, sf):
    return gallery.export_lines(_search(spark, sf))


def crop_urls(spark, sf):
    return _base(spark, sf).select("pos", gallery.crop_url(F.col("crop_uri")).alias("url"))


def _matches(spark, sf):
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    top = ranking.top_k(q, g, 3)
    return top, ranking.patch_matches(top, ranking.tokens(q), ranking.tokens(g)).where("similarity >= 0.8")


def compare_notes(spark, sf):
    """Per compared pair the number of matches over 0.8, and a note where there is none."""
    top, m = _matches(spark, sf)
    d = top.select("qpos", "gpos").join(m.groupBy("qpos", "gpos").agg(F.count("*").alias("n")), ["qpos", "gpos"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return d.withColumn("note", F.when(F.col("n") == 0, "few_shared_views"))


def compare_regions(spark, sf):
    """The matches that a comparison shows, with the regions of both patches and the item's tags."""
    _, m = _matches(spark, sf)
    order = Window.partitionBy("qpos", "gpos").orderBy(F.desc(F.round("similarity", 9)), "i", "j")
    d = m.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= gallery.SHOWN)
    a, b = (boxes.patch_region(F.col(c), 4, 4, 256, 256) for c in "ij")
    tags = tables.tags(spark, sf).groupBy(F.col("item_id").alias("gpos")).agg(F.count("*").alias("n_tags"))
    return d.join(tags, "gpos", "left").select("qpos", "gpos", "place", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), "n_tags")


def import_report(spark, sf):
    """Import results by status."""
    d = tables.gallery_base(spark, sf).withColumn("image_id", F.expr("concat('img_', pos % 350)")).withColumn("embedding", F.expr("if(pos % 23 = 0, NULL, embedding)")).withColumn("w", F.expr("if(pos % 19 = 0, 0, w)"))
    return gallery.import_report(d, FRAME_W, FRAME_H).groupBy("status").agg(F.count("*").alias("n"))


def response_order(spark, sf):
    """Answers put back in request order by key; a request without an answer fails."""
    asked = _base(spark, sf).where("pos % 10 = 0").select(F.col("pos").alias("place"), "image_id")
    answers = tables.gallery_base(spark, sf).select("image_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    d = asked.join(answers, "image_id", "left")
    return d.select("place", "image_id", F.when(F.col("first").isNull(), F.raise_error(F.lit("an answer is missing")).cast("double")).otherwise(F.col("first")).alias("first"))


def event_allow_list(spark, sf):
    """Events that an allow-list of (type, greatest value) lets pass; the list has a fixed 3 rows."""
    rules = spark.createDataFrame([("click", 50.0), ("purchase", 80.0), ("view", 20.0)], "event_type string, most double")
    d = tables.table(spark, sf, "events").join(F.broadcast(rules), "event_type", "left")
    verdict = F.when(F.col("most").isNull(), "unknown").when(F.col("value") > F.col("most"), "over").otherwise("allowed")
    return d.groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_NAMES = """
item_tags crop_uri_lookup tag_regions gallery_insert gallery_count item_with_tags current_versions plate_rule page_clamp top_n_clamp search_cards
search_export crop_urls compare_notes compare_regions import_report response_order event_allow_list
"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_URI = "CASE WHEN pos % 9 <> 0 THEN '/files/crops/img_' || pos || '.jpg' END"
_TAGS = f"""WITH {sql.BASE},
tags AS (SELECT pos AS item_id, 'kind_' || (pos % 4) AS tag, 0.5::DOUBLE + (pos % 5) / 10 AS confidence, CASE WHEN pos % 2 = 0 THEN x END AS bx, y AS by_, w AS bw, h AS bh FROM base
UNION ALL SELECT pos, 'colour_' || (pos % 6), 0.9::DOUBLE, NULL, NULL, NULL, NULL FROM base WHERE pos % 3 = 0)"""
_FOUND = f"""{_TOK},
l AS (SELECT qpos, gpos, least(sum(greatest(similarity, 0.0)) / 16, 1.0) AS l FROM m GROUP BY qpos, gpos),
c AS (SELECT qpos, gpos, rank, score, least(greatest(0.7 * score + (1 - 0.7::DOUBLE) * coalesce(l, 0.0), 0.0), 1.0) AS confidence FROM ranked LEFT JOIN l USING (qpos, gpos) WHERE rank <= 3),
f AS (SELECT c.*, row_number() OVER (PARTITION BY qpos ORDER BY confidence DESC, rank) AS place, b.image_id, b.plate, b.pos AS bp FROM c LEFT JOIN (SELECT * FROM base WHERE pos % 6 <> 0) b ON b.pos = gpos)"""
ORACLES = {
    "item_tags": f"{_TAGS} SELECT item_id, tag, round(confidence, 6) AS confidence FROM tags WHERE item_id IN (SELECT pos FROM base WHERE pos % 5 <> 0 AND vehicle_id NOT IN (8, 9) AND camera_id = 3)",
    "crop_uri_lookup": f"WITH {sql.BASE} SELECT pos, 's3://crops/img_17.jpg' AS crop_uri FROM base WHERE pos = 17",
    "tag_regions": f"{_TAGS} SELECT item_id, tag, bx IS NOT NULL AS has_region, bx AS x, CASE WHEN bx IS NOT NULL THEN by_ END AS y, CASE WHEN bx IS NOT NULL THEN bw END AS w, CASE WHEN bx IS NOT NULL THEN bh END AS h FROM tags",
    "gallery_insert": "SELECT vec_id AS pos, CASE WHEN vec_id % 4 = 0 THEN 'random' ELSE 'img_' || vec_id END AS image_id, CAST(CASE WHEN vec_id % 4 = 0 THEN 36 END AS BIGINT) AS chars, '1.2.0' AS model_version, CAST(0 AS BIGINT) AS n_tags FROM embeddings",
    "gallery_count": "SELECT count(*) AS n FROM embeddings",
    "item_with_tags": f"{_TAGS} SELECT pos, image_id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM base LEFT JOIN (SELECT * FROM tags WHERE tag <> 'kind_1') ON item_id = pos GROUP BY pos, image_id",
    "current_versions": f"WITH {sql.BASE} SELECT pos, vehicle_id FROM base WHERE model_version = '1.1.0'",
    "plate_rule": """SELECT vec_id AS pos, CASE WHEN vec_id % 5 = 0 THEN 'cleared' WHEN vec_id % 5 IN (1, 4) THEN 'empty' WHEN vec_id % 5 = 2 AND 30 + vec_id % 6 > 32 THEN 'too_long' ELSE 'set' END AS result,
CASE WHEN vec_id % 5 = 2 AND 30 + vec_id % 6 <= 32 THEN repeat('ж', 30 + vec_id % 6) WHEN vec_id % 5 = 3 THEN 'A' || vec_id END AS plate FROM embeddings""",
    "page_clamp": """WITH r AS (SELECT id, coalesce(CASE WHEN id % 7 <> 0 THEN id - 5 END, 1) AS page, least(greatest(coalesce(CASE WHEN id % 5 <> 0 THEN id * 13 - 40 END, 20), 1), 200) AS n FROM range(40) t(id))
SELECT id, (greatest(page, 1) - 1) * n AS "offset", n AS "limit", CAST(ceil((SELECT count(*) FROM embeddings) / n) AS BIGINT) AS pages FROM r""",
    "top_n_clamp": "SELECT id, CAST(least(greatest(coalesce(CASE WHEN id % 6 <> 0 THEN id * 9 - 50 END, 10), 1), 100) AS BIGINT) AS top_n FROM range(30) t(id)",
    "search_cards": f"{_FOUND} SELECT qpos, place, gpos, round(confidence, 6) AS confidence, confidence >= 0.35 AS accepted, image_id, plate, CASE WHEN bp % 9 <> 0 THEN '/files/crops/img_' || bp || '.jpg' END AS url FROM f",
    "search_export": f"{_FOUND} SELECT qpos, place, 'img_' || gpos || ',' || printf('%.6f', score) || ',' || printf('%.6f', confidence) || ',' || coalesce(plate, '') AS line FROM f",
    "crop_urls": f"SELECT pos, {_URI} AS url FROM (SELECT vec_id AS pos FROM embeddings)",
    "compare_notes": f"""{_TOK}, n AS (SELECT r.qpos, r.gpos, count(m.i) AS n FROM (SELECT * FROM ranked WHERE rank <= 3) r LEFT JOIN (SELECT * FROM m WHERE similarity >= 0.8) m ON r.qpos = m.qpos AND r.gpos = m.gpos GROUP BY ALL)
SELECT qpos, gpos, n, CASE WHEN n = 0 THEN 'few_shared_views' END AS note FROM n""",
    "compare_regions": f"""{_TOK}, p AS (SELECT *, row_number() OVER (PARTITION BY qpos, gpos ORDER BY round(similarity, 9) DESC, i, j) AS place FROM m WHERE similarity >= 0.8)
SELECT qpos, gpos, place, CAST(i % 4 * 64 AS INTEGER) AS ax, CAST(i // 4 * 64 AS INTEGER) AS ay, CAST(j % 4 * 64 AS INTEGER) AS bx, CAST(j // 4 * 64 AS INTEGER) AS by, CAST(CASE WHEN gpos % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_tags FROM p WHERE place <= 12""",
    "import_report": f"""WITH {sql.BASE}, s AS (SELECT *, CASE WHEN pos % 19 = 0 THEN 0 ELSE w END AS w2, row_number() OVER (PARTITION BY pos % 350 ORDER BY pos) AS n FROM base)
SELECT CASE WHEN pos % 23 = 0 THEN 'no_image' WHEN w2 = 0 OR h = 0 THEN 'empty' WHEN x + w2 > 1920 OR y + h > 1080 THEN 'out_of_frame' WHEN n > 1 THEN 'repeated' ELSE 'imported' END AS status, count(*) AS n FROM s GROUP BY 1""",
    "response_order": f"WITH {sql.BASE} SELECT pos AS place, image_id, round(v[1], 6) AS first FROM base WHERE pos % 10 = 0",
    "event_allow_list": """WITH r(event_type, most) AS (VALUES ('click', 50.0), ('purchase', 80.0), ('view', 20.0))
SELECT e.event_type, CASE WHEN most IS NULL THEN 'unknown' WHEN value > most THEN 'over' ELSE 'allowed' END AS verdict, count(*) AS n FROM events e LEFT JOIN r ON e.event_type = r.event_type GROUP BY ALL""",
}
