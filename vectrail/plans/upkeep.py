"""Queries on gallery maintenance and data preparation: pages, updates, deletes, admission, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.operators import ordered
from vectrail.plans import sql
from vectrail.sources import tables


def gallery_page(spark, sf):
    """The second page of 20, newest first, with the number of tags."""
    page = tables.gallery_base(spark, sf).select("pos", "image_id", "plate").orderBy(F.desc("pos")).offset(20).limit(20)
    n = tables.tags(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    return page.join(n, F.col("pos") == F.col("item_id"), "left").select("pos", "image_id", "plate", F.coalesce("n", F.lit(0)).cast("long").alias("n_tags"))


def gallery_set_plate(spark, sf):
    """An overlay of updates: set plates of every 50th item, clear those of its successor."""
    base = tables.gallery_base(spark, sf).select("pos", "plate")
    new = base.where("pos % 50 IN (0, 1)").select(F.col("pos").alias("id"), F.expr("if(pos % 50 = 0, concat('NEW', pos), NULL)").alias("value"))
    return base.join(new, F.col("pos") == F.col("id"), "left").select("pos", F.when(F.col("id").isNotNull(), F.col("value")).otherwise(F.col("plate")).alias("plate"))


def gallery_delete_cascade(spark, sf):
    """Tags that are left when every third vehicle's items go."""
    gone = tables.gallery_base(spark, sf).where("vehicle_id % 3 = 0").select(F.col("pos").alias("id"))
    return tables.tags(spark, sf).join(gone, F.col("item_id") == F.col("id"), "left_anti").groupBy("item_id").agg(F.count("*").alias("n"))


def stale_versions(spark, sf):
    return tables.gallery_base(spark, sf).where(F.col("model_version") != tables.CURRENT_VERSION).select("pos", "model_version")


def sha256_admission(spark, sf):
    """External texts (even ids) whose content is also a protected one (odd ids)."""
    d = tables.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1").select("h"), "h", "left_semi").select("doc_id", "h")


def dense_relabel(spark, sf):
    """Vehicles as dense numbers in order; ranked over distinct vehicles only."""
    base = tables.gallery_base(spark, sf).select("pos", F.concat(F.lit("v"), "vehicle_id").alias("identity"))
    number = ordered.numbered(base.select("identity").distinct(), [F.col("identity")], "label")
    return base.join(number, "identity").select("pos", "label")


QUERIES = {f.__name__: f for f in (gallery_page, gallery_set_plate, gallery_delete_cascade, stale_versions, sha256_admission, dense_relabel)}

ORACLES = {
    "gallery_page": f"WITH {sql.BASE} SELECT pos, image_id, plate, CAST(CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_tags FROM base ORDER BY pos DESC LIMIT 20 OFFSET 20",
    "gallery_set_plate": f"WITH {sql.BASE} SELECT pos, CASE pos % 50 WHEN 0 THEN 'NEW' || pos WHEN 1 THEN NULL ELSE plate END AS plate FROM base",
    "gallery_delete_cascade": f"WITH {sql.BASE} SELECT pos AS item_id, CAST(CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM base WHERE vehicle_id % 3 <> 0",
    "stale_versions": f"WITH {sql.BASE} SELECT pos, model_version FROM base WHERE model_version <> '1.2.0'",
    "sha256_admission": "SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)",
    "dense_relabel": f"WITH {sql.BASE} SELECT pos, CAST(dense_rank() OVER (ORDER BY 'v' || vehicle_id) - 1 AS BIGINT) AS label FROM base",
}
