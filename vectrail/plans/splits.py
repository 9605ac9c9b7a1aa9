"""Queries on evaluation splits, replaced tags and vectors, search records and submitted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.operators import ranking
from vectrail.plans import sql
from vectrail.sources import readers, tables

#: Vehicles held out and the share of them that has no gallery rows.
N_IDS, OPEN_SHARE = 4, 0.25


def split_roles(rows: DataFrame, n_ids: int, open_share: float, seed: str = "s") -> DataFrame:
    """``rows`` with a role: held-out vehicles are drawn by hash, the first share of them gives queries only, each other one
    gives one camera's rows as gallery and the rest as queries; all else is train. Fails if one of these has a single camera."""
    by_hash = lambda *c: F.sha2(F.concat_ws(":", F.lit(seed), *c), 256)
    drawn = rows.select("vehicle_id").distinct().withColumn("h", by_hash("vehicle_id")).orderBy("h", "vehicle_id").limit(n_ids)
    drawn = drawn.withColumn("draw", F.row_number().over(Window.orderBy("h", "vehicle_id"))).drop("h")
    cams = rows.select("vehicle_id", "camera_id").distinct().groupBy("vehicle_id").agg(F.count("*").alias("n_cams"), F.min_by("camera_id", by_hash("vehicle_id", "camera_id")).alias("chosen"))
    is_open = F.col("draw") <= round(n_ids * open_share)
    role = (
        F.when(F.col("draw").isNull(), "train").when(is_open, "query")
        .when(F.col("n_cams") < 2, F.raise_error(F.concat(F.lit("one camera only: "), F.col("vehicle_id").cast("string"))))
        .when(F.col("camera_id") == F.col("chosen"), "gallery").otherwise("query")
    )
    return rows.join(drawn.join(cams, "vehicle_id"), "vehicle_id", "left").withColumn("role", role).drop("draw", "n_cams", "chosen")


def _roles(spark, sf):
    return split_roles(tables.gallery_base(spark, sf).select("pos", "vehicle_id", "camera_id"), N_IDS, OPEN_SHARE)


def cross_camera_split(spark, sf):
    return _roles(spark, sf).select("pos", "role")


def split_summary(spark, sf):
    """Rows and vehicles by role, and queries with a gallery row of their vehicle."""
    d = _roles(spark, sf)
    known = d.where("role = 'gallery'").select("vehicle_id").distinct().withColumn("known", F.lit(True))
    d = d.join(known, "vehicle_id", "left")
    return d.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("vehicle_id").alias("n_vehicles"), F.count_if((F.col("role") == "query") & F.col("known")).alias("with_pair"))


def role_overlap(spark, sf):
    """Vehicles that two roles share."""
    d = _roles(spark, sf).select("role", "vehicle_id").distinct()
    other = d.select(F.col("role").alias("other"), "vehicle_id")
    return d.join(other, "vehicle_id").where("role < other").groupBy("role", "other").agg(F.count("*").alias("n"))


def tags_replace(spark, sf):
    """Tag sets of every tenth item replaced as a whole by one new tag."""
    items = tables.gallery_base(spark, sf).where("pos % 10 = 0").select(F.col("pos").alias("item_id"), F.lit("fresh").alias("tag"))
    return tables.tags(spark, sf).select("item_id", "tag").join(items.select("item_id"), "item_id", "left_anti").unionByName(items)


def embedding_update(spark, sf):
    """Vectors of stale items overlaid with new ones (here reversed) and the current version."""
    base = tables.gallery_base(spark, sf).select("pos", "model_version", "embedding")
    new = base.where(F.col("model_version") != tables.CURRENT_VERSION).select("pos", F.reverse("embedding").alias("new"), F.lit(tables.CURRENT_VERSION).alias("to"))
    d = base.join(new, "pos", "left").select("pos", F.coalesce("to", "model_version").alias("model_version"), F.coalesce("new", "embedding").alias("e"))
    return d.select("pos", "model_version", F.round(F.col("e")[0].cast("double"), 6).alias("first"), F.round(F.element_at("e", -1).cast("double"), 6).alias("last"))


def search_record(spark, sf):
    """Searches kept as JSON records; candidates read back."""
    top = ranking.top_k(tables.queries(spark, sf), tables.gallery(spark, sf))
    saved = top.groupBy("qpos").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "gpos", "score")))).alias("candidates"))
    c = F.explode(F.from_json("candidates", "array<struct<rank: bigint, gpos: bigint, score: double>>"))
    return saved.select("qpos", c.alias("c")).select("qpos", "c.rank", "c.gpos", F.round("c.score", 6).alias("score"))


def submission_parse(spark, sf):
    """Dirty submitted lines (mark, blanks, unknown and repeated ids, a repeated query) as ranked pairs."""
    q, g = tables.queries(spark, sf).select("pos", "image_id"), tables.gallery(spark, sf).select("image_id")
    name = lambda n: F.concat(F.lit("img_"), n.cast("string"))
    first = q.select((F.col("pos") * 2).alias("line_no"), F.concat(F.lit("\ufeff"), F.col("image_id"), F.lit(",nobody, img_1 ,img_1")).alias("line"))
    again = q.where("pos % 2 = 0").select((F.col("pos") * 2 + 1).alias("line_no"), F.concat_ws(",", "image_id", name(F.lit(2)), F.lit(" "), name(F.lit(1)), name(F.lit(2))).alias("line"))
    return readers.parse_submission(first.unionByName(again), q.select("image_id"), g).select("query_id", "gallery_id", "rank")


QUERIES = {f.__name__: f for f in (cross_camera_split, split_summary, role_overlap, tags_replace, embedding_update, search_record, submission_parse)}

_SPLIT = f"""WITH {sql.BASE},
v AS (SELECT vehicle_id, row_number() OVER (ORDER BY sha256('s:' || vehicle_id), vehicle_id) AS draw FROM (SELECT DISTINCT vehicle_id FROM base)),
c AS (SELECT vehicle_id, camera_id AS chosen FROM (SELECT DISTINCT vehicle_id, camera_id FROM base) QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY sha256('s:' || vehicle_id || ':' || camera_id)) = 1),
r AS (SELECT pos, vehicle_id, camera_id, CASE WHEN draw > {N_IDS} THEN 'train' WHEN draw <= 1 THEN 'query' WHEN camera_id = chosen THEN 'gallery' ELSE 'query' END AS role FROM base JOIN v USING (vehicle_id) JOIN c USING (vehicle_id))"""
ORACLES = {
    "cross_camera_split": f"{_SPLIT} SELECT pos, role FROM r",
    "split_summary": f"{_SPLIT} SELECT role, count(*) AS n, count(DISTINCT vehicle_id) AS n_vehicles, count(*) FILTER (role = 'query' AND vehicle_id IN (SELECT vehicle_id FROM r WHERE role = 'gallery')) AS with_pair FROM r GROUP BY role",
    "role_overlap": f"{_SPLIT} SELECT a.role, b.role AS other, count(DISTINCT a.vehicle_id) AS n FROM r a JOIN r b USING (vehicle_id) WHERE a.role < b.role GROUP BY ALL",
    "tags_replace": f"""WITH {sql.BASE} SELECT pos AS item_id, 'fresh' AS tag FROM base WHERE pos % 10 = 0 UNION ALL SELECT pos, 'kind_' || (pos % 4) FROM base WHERE pos % 10 <> 0
UNION ALL SELECT pos, 'colour_' || (pos % 6) FROM base WHERE pos % 10 <> 0 AND pos % 3 = 0""",
    "embedding_update": f"WITH {sql.BASE} SELECT pos, '1.2.0' AS model_version, round(CASE WHEN pos % 11 = 0 THEN v[-1] ELSE v[1] END, 6) AS first, round(CASE WHEN pos % 11 = 0 THEN v[1] ELSE v[-1] END, 6) AS last FROM base",
    "search_record": f"WITH {sql.PAIRS} SELECT qpos, rank, gpos, round(score, 6) AS score FROM top10",
    "submission_parse": f"""WITH {sql.SIDES}, w AS (SELECT image_id AS query_id, CASE WHEN pos % 2 = 0 THEN ['img_2', 'img_1'] ELSE ['img_1'] END AS ids FROM q),
u AS (SELECT query_id, unnest(ids) AS gallery_id, unnest(range(len(ids))) AS i FROM w)
SELECT query_id, gallery_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rank FROM u WHERE gallery_id IN (SELECT image_id FROM g)""",
}
