"""Queries on writes and their order: commits to a versioned gallery, kept searches, batches of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import vectors
from vectrail.operators import catalogue, packing, profile, ranking
from vectrail.plans import sql
from vectrail.plans.retrieval import THRESHOLD
from vectrail.sources import tables
from vectrail.sources.shared import place
from vectrail.streaming import embedding


def _edited(spark, sf):
    """A gallery with its tags after one of each kind of edit; the last one is done twice under one name."""
    base = tables.gallery_base(spark, sf).select("pos", "image_id", "vehicle_id", "model_version", "plate", "embedding")
    tags = tables.tags(spark, sf).select("item_id", "tag")
    store = catalogue.opened(spark, place(spark, "gallery"), base.where("pos % 4 <> 3"), tags.where("item_id % 4 <> 3"))
    catalogue.add_items(store, base.where("pos % 4 = 3"), tables.CURRENT_VERSION)
    catalogue.set_plates(store, base.where("pos % 50 IN (0, 1)").select("pos", F.expr("if(pos % 50 = 0, concat(' NEW', pos), NULL)").alias("plate")))
    catalogue.update_vectors(store, base.where("model_version <> '1.2.0' AND pos % 4 <> 3").select("pos", F.reverse("embedding").alias("embedding")), tables.CURRENT_VERSION)
    catalogue.delete_items(store, base.where("vehicle_id % 3 = 0").select("pos"))
    fresh = store.read("items").where("pos % 10 = 0").select(F.col("pos").alias("item_id"))
    for _ in range(2):
        catalogue.replace_tags(store, fresh, fresh.withColumn("tag", F.lit("fresh")), "retagging")
    return store


def store_edits(spark, sf):
    """Items and their tags as the last version has them."""
    store = _edited(spark, sf)
    tags = store.read("tags").groupBy("item_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("tag"))).alias("tags"))
    d = store.read("items").join(tags, F.col("pos") == F.col("item_id"), "left")
    return d.select("pos", "model_version", "plate", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.coalesce("tags", F.lit("")).alias("tags"))


def store_versions(spark, sf):
    """Items, plates and tags of every version; a retried edit made none of its own."""
    store, out = _edited(spark, sf), None
    for v in range(1, store.manifest()["version"] + 1):
        n = store.read("tags", v).agg(F.count("*").alias("tags"))
        row = store.read("items", v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("items"), F.count("plate").alias("plates")).join(n)
        out = row if out is None else out.unionByName(row)
    return out


def kept_searches(spark, sf):
    """Searches kept in two batches, the second one tried twice; ids follow one another."""
    store = catalogue.opened(spark, place(spark, "searches"), tables.gallery_base(spark, sf).select("pos", "image_id"), tables.tags(spark, sf).select("item_id", "tag"))
    found = ranking.top_k(tables.queries(spark, sf), tables.gallery(spark, sf))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    catalogue.save_searches(store, found.where("qpos % 2 = 1"), THRESHOLD, at, "odd")
    for _ in range(2):
        catalogue.save_searches(store, found.where("qpos % 2 = 0"), THRESHOLD, at, "even")
    best = F.from_json("result", "array<struct<rank: int, gpos: bigint, score: double>>")
    return store.read("searches").select("id", "qpos", "accepted", F.size(best).cast("long").alias("n"), best[0]["gpos"].alias("gpos"), F.round(best[0]["score"], 6).alias("score"))


def _toy_model():
    """Stands in for an encoder: a crop's length and last byte."""
    return lambda crops: [[float(len(c)), float(c[-1])] for c in crops]


def reindex_run(spark, sf):
    """Stale items embedded anew as a stream of commits; crops that can't be read keep their item stale."""
    base = tables.gallery_base(spark, sf)
    store = catalogue.opened(spark, place(spark, "reindexed"), base.select("pos", "image_id", "model_version", F.expr("array(0F, 0F)").alias("embedding")), tables.tags(spark, sf).select("item_id", "tag"))
    crops = base.select("pos", F.when(F.col("pos") % 55 != 0, F.encode("image_id", "utf-8")).alias("crop"))
    folder = place(spark, "queue")
    embedding.queue_stale(store, crops, tables.CURRENT_VERSION, folder, files=4)
    embedding.reindex(store, folder, f"{folder}-progress", tables.CURRENT_VERSION, _toy_model, files_at_once=2).awaitTermination()
    d = store.read("items").join(embedding.failures(spark, folder), "pos", "left")
    return d.select("pos", "model_version", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("last"), "error")


def frame_batches(spark, sf):
    """Documents as frames of a thousand bytes a character: import batches of at most 64 frames and 3 MiB, larger frames refused."""
    d = tables.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    d = packing.packed(d, [F.col("doc_id")], F.col("n") * 1000, segment=150)
    return d.select("doc_id", "batch", "place", "refused")


def profile_verdicts(spark, sf):
    """Stream events as profile events, many of them at fault, held against a list of three nodes."""
    rules = spark.createDataFrame([("n0", "Gather", [("int64", 40, 320)]), ("n1", "Shape", [("float16", 40, 60)]), ("n2", "Cast", [("int32", 40, 160)])], profile.RULE)
    e = F.col("event_id")
    part = lambda text, *c: F.format_string(text, *c)
    name = F.when(e % 17 == 0, "session_run").otherwise(part("n%d_kernel_time", e % 4))
    provider = F.when((e % 17 == 0) & (e % 2 == 0), F.lit(None)).when(e % 5 == 0, profile.CARD).when(e % 23 == 0, "Other").otherwise(profile.PROCESSOR)
    op = F.when(e % 13 == 0, "Other").when(e % 4 == 0, "Gather").when(e % 4 == 1, "Shape").otherwise("Cast")
    kind = F.when(e % 11 == 0, "bool").when(e % 4 == 0, "int64").when(e % 4 == 1, "float16").otherwise("int32")
    shape = F.array(e % 7, F.lit(8).cast("long"))
    size = (e % 7) * 8 * F.when(e % 4 == 0, 8).when(e % 4 == 1, 2).otherwise(4) + F.when(e % 19 == 0, 1).otherwise(0)
    args = F.struct(provider.alias("provider"), op.alias("op_name"), F.array(F.create_map(kind, shape)).alias("output_type_shape"), size.alias("output_size"))
    d = tables.table(spark, sf, "events").select("event_id", F.to_json(F.struct(name.alias("name"), args.alias("args"))).alias("event"))
    return profile.verdicts(d, rules).select("event_id", "verdict")


def l2_policies(spark, sf):
    """First entries of normalised vectors, some of them null vectors, under each policy that lets them pass."""
    d = tables.gallery_base(spark, sf).select("pos", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("pos") % 9 == 0, 0.0).otherwise(F.col("pos") % 4 + 1)).alias("v"))
    first = lambda v, c: F.round(v[0], 6).alias(c)
    whole = F.when(F.col("pos") % 9 != 0, F.col("v"))
    return d.select("pos", first(vectors.l2_normalize("v", "passthrough"), "passed"), first(vectors.l2_normalize("v", "floor"), "floored"), first(vectors.l2_normalize(whole, "error"), "strict"))


QUERIES = {f.__name__: f for f in (store_edits, store_versions, kept_searches, reindex_run, frame_batches, profile_verdicts, l2_policies)}

_TAGGED = f"""WITH {sql.BASE},
t AS (SELECT pos AS item_id, 'kind_' || (pos % 4) AS tag FROM base UNION ALL SELECT pos, 'colour_' || (pos % 6) FROM base WHERE pos % 3 = 0)"""
ORACLES = {
    "store_edits": f"""{_TAGGED}, u AS (SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t WHERE item_id % 4 <> 3 GROUP BY item_id)
SELECT pos, '1.2.0' AS model_version, CASE pos % 50 WHEN 0 THEN 'NEW' || pos WHEN 1 THEN NULL ELSE plate END AS plate, round(CASE WHEN pos % 11 = 0 AND pos % 4 <> 3 THEN v[-1] ELSE v[1] END, 6) AS first,
CASE WHEN pos % 10 = 0 THEN 'fresh' ELSE coalesce(tags, '') END AS tags FROM base LEFT JOIN u ON item_id = pos WHERE vehicle_id % 3 <> 0""",
    "store_versions": f"""{_TAGGED}, s AS (SELECT b.*, (SELECT count(*) FROM t WHERE item_id = pos) AS n FROM base b),
p AS (SELECT *, CASE pos % 50 WHEN 0 THEN 'NEW' WHEN 1 THEN NULL ELSE plate END AS plate2, pos % 4 <> 3 AS early, vehicle_id % 3 <> 0 AS stays FROM s),
o AS (SELECT count(*) FILTER (early) AS i1, count(plate) FILTER (early) AS p1, sum(n) FILTER (early) AS t1, count(*) AS i2, count(plate) AS p2, count(plate2) AS p3,
count(*) FILTER (stays) AS i5, count(plate2) FILTER (stays) AS p5, sum(n) FILTER (early AND stays) AS t5, sum(CASE WHEN pos % 10 = 0 THEN 1 WHEN early THEN n ELSE 0 END) FILTER (stays) AS t6 FROM p)
SELECT CAST(unnest([1, 2, 3, 4, 5, 6]) AS BIGINT) AS version, unnest([i1, i2, i2, i2, i5, i5]) AS items, unnest([p1, p2, p3, p3, p5, p5]) AS plates, CAST(unnest([t1, t1, t1, t1, t5, t6]) AS BIGINT) AS tags FROM o""",
    "kept_searches": f"""WITH {sql.PAIRS} SELECT row_number() OVER (ORDER BY qpos % 2 DESC, qpos) AS id, qpos, max(score) >= 0.35 AS accepted, count(*) AS n, min_by(gpos, rank) AS gpos, round(max(score), 6) AS score FROM top10 GROUP BY qpos""",
    "profile_verdicts": """WITH d AS (SELECT event_id AS e, (event_id % 7) * 8 AS n FROM events)
SELECT e AS event_id, CASE WHEN e % 17 = 0 THEN CASE WHEN e % 2 = 0 THEN 'other' ELSE 'no kernel' END WHEN e % 5 = 0 THEN 'card' WHEN e % 23 = 0 THEN 'provider' WHEN e % 4 = 3 THEN 'not reviewed' WHEN e % 13 = 0 THEN 'operator'
WHEN e % 11 = 0 THEN 'type' WHEN n = 0 OR n > 40 OR (e % 4 = 1 AND n * 2 > 60) THEN 'bounds' WHEN e % 19 = 0 THEN 'output bytes' ELSE 'processor' END AS verdict FROM d""",
    "l2_policies": f"""WITH {sql.BASE} SELECT pos, CASE WHEN pos % 9 = 0 THEN 0.0 ELSE round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS passed, CASE WHEN pos % 9 = 0 THEN 0.0 ELSE round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS floored,
CASE WHEN pos % 9 <> 0 THEN round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS strict FROM base""",
    "reindex_run": """SELECT vec_id AS pos, CASE WHEN vec_id % 55 = 0 THEN '1.1.0' ELSE '1.2.0' END AS model_version, CASE WHEN vec_id % 11 = 0 AND vec_id % 55 <> 0 THEN 4.0::DOUBLE + length(vec_id::VARCHAR) ELSE 0 END AS chars,
CASE WHEN vec_id % 11 = 0 AND vec_id % 55 <> 0 THEN 48.0::DOUBLE + vec_id % 10 ELSE 0 END AS last, CASE WHEN vec_id % 55 = 0 THEN 'no crop' END AS error FROM embeddings""",
    "frame_batches": """WITH RECURSIVE f AS (SELECT doc_id, length(text) * 1000 AS size FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM f WHERE size <= 3145728),
w AS (SELECT i, doc_id, size AS total, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place FROM n WHERE i = 1
UNION ALL SELECT n.i, n.doc_id, CASE WHEN place = 63 OR total + size > 3145728 THEN size ELSE total + size END, batch + CAST(place = 63 OR total + size > 3145728 AS BIGINT),
CASE WHEN place = 63 OR total + size > 3145728 THEN 0 ELSE place + 1 END FROM w JOIN n ON n.i = w.i + 1)
SELECT f.doc_id, batch, place, w.doc_id IS NULL AS refused FROM f LEFT JOIN w ON w.doc_id = f.doc_id""",
}
