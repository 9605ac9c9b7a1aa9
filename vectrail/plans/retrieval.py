"""Queries on search, refinement and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import boxes, vectors
from vectrail.operators import metrics, ranking
from vectrail.plans import sql
from vectrail.sources import tables
from vectrail.sources.tables import FRAME_H, FRAME_W

#: Acceptance threshold on this data, weight of the score against the local score.
THRESHOLD, ALPHA = 0.35, 0.7


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tables.queries(spark, sf), tables.gallery(spark, sf)


def _ranked(spark: SparkSession, sf: str, k: int | None = 10) -> DataFrame:
    q, g = _sides(spark, sf)
    return metrics.labelled(ranking.top_k(q, g, k), q, g)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.positives(*_sides(spark, sf))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.decisions(_ranked(spark, sf, 1), _counts(spark, sf), THRESHOLD)


def _six(name: str) -> Column:
    return F.round(name, 6).alias(name)


def knn_top10(spark, sf):
    return ranking.top_k(*_sides(spark, sf)).select("qpos", F.col("rank").cast("long").alias("rank"), "gpos", _six("score"))


def knn_version_filtered(spark, sf):
    q, g = _sides(spark, sf)
    return ranking.top_k(q, g.where(F.col("model_version") == tables.CURRENT_VERSION)).select("qpos", F.col("rank").cast("long").alias("rank"), "gpos", _six("score"))


def search_accept_flag(spark, sf):
    d = ranking.top_k(*_sides(spark, sf)).groupBy("qpos").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min_by("gpos", "rank").alias("gpos"))
    return d.select("qpos", "gpos", "n", _six("best"), (F.col("best") >= THRESHOLD).alias("accepted"))


def threshold_refusals(spark, sf):
    q, g = _sides(spark, sf)
    accepted = ranking.top_k(q, g, 1).where(F.col("score") >= THRESHOLD)
    return q.select("pos", "image_id").join(accepted, F.col("pos") == F.col("qpos"), "left_anti").withColumnRenamed("pos", "qpos")


def candidates_export(spark, sf):
    d = ranking.top_k(*_sides(spark, sf), 1).where(F.col("score") >= THRESHOLD)
    return d.select(F.concat(F.lit("img_"), "qpos").alias("query_id"), F.concat(F.lit("img_"), "gpos").alias("gallery_id"), F.format_string("%.6f", "score").alias("confidence"))


def submission_lines(spark, sf):
    d = ranking.top_k(*_sides(spark, sf)).groupBy("qpos").agg(F.array_sort(F.collect_list(F.struct("rank", "gpos"))).alias("r"))
    ids = F.transform("r", lambda s: F.concat(F.lit("img_"), s["gpos"].cast("string")))
    return d.select(F.concat_ws(",", F.concat(F.lit("img_"), "qpos"), ids).alias("line"))


def _matched(spark, sf):
    q, g = _sides(spark, sf)
    return ranking.top_k(q, g, 3), ranking.tokens(q), ranking.tokens(g)


def patch_mutual_nn(spark, sf):
    return ranking.patch_matches(*_matched(spark, sf)).select("qpos", "gpos", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _six("similarity"))


def confidence_blend(spark, sf):
    top, q, g = _matched(spark, sf)
    d = top.join(ranking.local_scores(top, q, g), ["qpos", "gpos"])
    return d.select("qpos", "gpos", F.round(vectors.blend(F.col("score"), F.col("local_score"), ALPHA), 6).alias("confidence"))


def patch_regions(spark, sf):
    d = spark.range(16).select(F.col("id").alias("patch"), boxes.patch_region(F.col("id"), 4, 4, 254, 250).alias("r"))
    return d.select("patch", "r.*")


def l2_normalize(spark, sf):
    d = tables.gallery_base(spark, sf).select("pos", F.transform("embedding", lambda x: x.cast("double") * (F.col("pos") % 3 + 0.5)).alias("v"))
    return d.select("pos", F.posexplode(vectors.l2_normalize("v")).alias("i", "x")).select("pos", F.col("i").cast("long").alias("i"), _six("x"))


def unit_norm_violations(spark, sf):
    d = tables.gallery_base(spark, sf).select("pos", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("pos") % 10 == 0, 1.01).otherwise(1.0)).alias("v"))
    return d.where(~vectors.is_unit("v")).select("pos", F.round(vectors.norm("v"), 4).alias("norm"))


def weighted_concat(spark, sf):
    d = tables.gallery_base(spark, sf).select("pos", vectors.weighted_concat("embedding", F.reverse("embedding"), 0.6).alias("v"))
    return d.select("pos", F.posexplode("v").alias("i", "x")).select("pos", F.col("i").cast("long").alias("i"), _six("x"))


def duplicate_ids(spark, sf):
    d = tables.gallery_base(spark, sf).select(F.expr("concat('img_', pos % 340)").alias("image_id"))
    return d.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1")


def bbox_validate(spark, sf):
    d = tables.gallery_base(spark, sf)
    return d.select("pos", boxes.validate(*map(F.col, "xywh"), FRAME_W, FRAME_H).alias("status"), boxes.usable(F.col("w"), F.col("h")).alias("usable"))


def bbox_clamp(spark, sf):
    return tables.gallery_base(spark, sf).select("pos", *boxes.clamp(*map(F.col, "xywh"), FRAME_W, FRAME_H))


def bbox_clip(spark, sf):
    d = tables.gallery_base(spark, sf)
    return d.select("pos", *boxes.clip(F.col("x") - 50, F.col("y") - 20, F.col("w"), F.col("h"), FRAME_W, FRAME_H))


def dba_refine(spark, sf):
    d = ranking.dba_refine(tables.gallery(spark, sf).select("pos", "embedding"))
    return d.select("pos", F.posexplode("embedding").alias("i", "x")).select("pos", F.col("i").cast("long").alias("i"), _six("x"))


def ap_at_10(spark, sf):
    return metrics.average_precision(_ranked(spark, sf), _counts(spark, sf)).select("qpos", "n_pos", _six("ap"))


def rank_1_5(spark, sf):
    d = metrics.average_precision(_ranked(spark, sf), _counts(spark, sf))
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("first_hit") <= k, F.lit(False)).cast("double")), 6).alias(f"rank{k}")
    return d.agg(F.count("*").alias("n_scored"), F.round(F.avg("ap"), 6).alias("map10"), hit(1), hit(5))


def full_ranking_metrics(spark, sf):
    d = metrics.precision_of_sums(ranking.ranked_sums(*_sides(spark, sf)), _counts(spark, sf))
    return d.agg(F.count("*").alias("n_scored"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("inp"), 6).alias("minp"))


def junk_filtered_positives(spark, sf):
    return _counts(spark, sf)


def openset_queries(spark, sf):
    q, g = _sides(spark, sf)
    g = g.select(F.col("vehicle_id").alias("gv"), F.col("camera_id").alias("gc")).distinct()
    return q.join(g, F.expr("vehicle_id = gv AND camera_id <> gc"), "left_anti").select("pos", "vehicle_id")


def confusion_at_threshold(spark, sf):
    return metrics.confusion(_decided(spark, sf))


def f1_tnr_q(spark, sf):
    return metrics.rates(metrics.confusion(_decided(spark, sf))).select(*map(_six, ("precision", "recall", "f1", "tnr", "q")))


def pr_auc(spark, sf):
    return metrics.pr_auc(_decided(spark, sf)).select(_six("pr_auc"))


def outcome_classes(spark, sf):
    return _decided(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def threshold_sweep(spark, sf):
    return metrics.sweep(_decided(spark, sf)).select(_six("threshold"), "tp", "fp", "fn", "tn", _six("f1"), _six("tnr"), _six("q"))


def calibrate_pick(spark, sf):
    return metrics.pick(metrics.sweep(_decided(spark, sf)), "q", 0.5).select(_six("threshold"), "tp", "fp", "fn", "tn", _six("q"))


def calibrate_with_reject_all(spark, sf):
    c = metrics.calibrate(_decided(spark, sf))
    return c.select(_six("threshold"), "tp", "fp", "fn", "tn", _six("q"))


def grid_curve(spark, sf):
    d = metrics.grid_curve(_decided(spark, sf), step=0.005)
    return d.select("t", "tp", "fp", "fn", "tn", _six("precision"), _six("f1"), _six("tnr"), _six("q"))


def run_parity(spark, sf):
    q, g = _sides(spark, sf)
    refined = ranking.dba_refine(g.select("pos", "embedding"))
    d = metrics.parity(ranking.top_k(q, g), ranking.top_k(q, refined))
    return d.withColumn("top_shift", F.round("top_shift", 6))


def latency_percentiles(spark, sf):
    d = tables.table(spark, sf, "events").groupBy("event_type")
    return d.agg(F.count("*").alias("n"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


def triplet_hardest(spark, sf):
    return ranking.hardest(tables.gallery_base(spark, sf)).select("pos", _six("hardest_positive"), _six("hardest_negative"))


def bootstrap_ci(spark, sf):
    q = tables.queries(spark, sf).select(F.col("pos").alias("qpos"), "vehicle_id")
    ap = metrics.average_precision(_ranked(spark, sf), _counts(spark, sf)).select("qpos", "ap")
    d = metrics.bootstrap(_decided(spark, sf).join(q, "qpos").join(ap, "qpos", "left"))
    return d.select("metric", _six("low"), _six("high"))


def recall_at_k(spark, sf):
    """Recall of a search on vectors cut to their first half against the exact one."""
    q, g = _sides(spark, sf)
    half = lambda d: d.withColumn("embedding", F.slice("embedding", 1, 32))
    d = metrics.parity(ranking.top_k(q, g), ranking.top_k(half(q), half(g)))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(F.col("overlap") / 10), 6).alias("recall"))


_NAMES = """
knn_top10 knn_version_filtered search_accept_flag threshold_refusals candidates_export submission_lines patch_mutual_nn confidence_blend patch_regions
l2_normalize unit_norm_violations weighted_concat duplicate_ids bbox_validate bbox_clamp bbox_clip dba_refine ap_at_10 rank_1_5 full_ranking_metrics
junk_filtered_positives openset_queries confusion_at_threshold f1_tnr_q pr_auc outcome_classes threshold_sweep calibrate_pick calibrate_with_reject_all
grid_curve run_parity latency_percentiles triplet_hardest bootstrap_ci recall_at_k
"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_WITH = f"WITH {sql.PAIRS}, {sql.COUNTS}"
_TOK = f"""WITH {sql.PAIRS},
tok AS (SELECT pos, t, list_transform(s, lambda e: e / greatest(sqrt(list_dot_product(s, s)), 1e-12)) AS u FROM (SELECT pos, t, v[t * 4 + 1 : t * 4 + 4] AS s FROM base, range(16) AS r(t))),
sims AS (SELECT qpos, gpos, a.t AS i, b.t AS j, list_dot_product(a.u, b.u) AS similarity FROM ranked JOIN tok a ON a.pos = qpos JOIN tok b ON b.pos = gpos WHERE rank <= 3),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qpos, gpos, i ORDER BY similarity DESC, j) AS ri, row_number() OVER (PARTITION BY qpos, gpos, j ORDER BY similarity DESC, i) AS rj FROM sims) WHERE ri = 1 AND rj = 1)"""
_DBA = f"""WITH {sql.PAIRS},
gg AS (SELECT a.pos, b.pos AS n, b.v, list_dot_product(a.v, b.v) AS s FROM g a, g b),
near AS (SELECT pos, n, v, pow(greatest(s, 0.0), 2.0) AS w FROM gg QUALIFY row_number() OVER (PARTITION BY pos ORDER BY s DESC, n) <= 5),
sums AS (SELECT pos, i, sum(w * v[i + 1]) AS x FROM near, range(64) AS r(i) GROUP BY pos, i),
ref AS (SELECT pos, i, x / sqrt(sum(x * x) OVER (PARTITION BY pos)) AS x FROM sums)"""

ORACLES = {
    "knn_top10": f"WITH {sql.PAIRS} SELECT qpos, rank, gpos, round(score, 6) AS score FROM top10",
    "knn_version_filtered": f"WITH {sql.PAIRS} SELECT qpos, row_number() OVER (PARTITION BY qpos ORDER BY score DESC, gpos) AS rank, gpos, round(score, 6) AS score FROM (SELECT * FROM pairs WHERE model_version = '1.2.0') QUALIFY row_number() OVER (PARTITION BY qpos ORDER BY score DESC, gpos) <= 10",
    "search_accept_flag": f"WITH {sql.PAIRS} SELECT qpos, min_by(gpos, rank) AS gpos, count(*) AS n, round(max(score), 6) AS best, max(score) >= 0.35 AS accepted FROM top10 GROUP BY qpos",
    "threshold_refusals": f"WITH {sql.PAIRS} SELECT pos AS qpos, image_id FROM q WHERE pos NOT IN (SELECT qpos FROM ranked WHERE rank = 1 AND score >= 0.35)",
    "candidates_export": f"WITH {sql.PAIRS} SELECT 'img_' || qpos AS query_id, 'img_' || gpos AS gallery_id, printf('%.6f', score) AS confidence FROM ranked WHERE rank = 1 AND score >= 0.35",
    "submission_lines": f"WITH {sql.PAIRS} SELECT 'img_' || qpos || ',' || string_agg('img_' || gpos, ',' ORDER BY rank) AS line FROM top10 GROUP BY qpos",
    "patch_mutual_nn": f"{_TOK} SELECT qpos, gpos, i, j, round(similarity, 6) AS similarity FROM m",
    "confidence_blend": f"""{_TOK},
l AS (SELECT qpos, gpos, least(sum(greatest(similarity, 0.0)) / 16, 1.0) AS l FROM m GROUP BY qpos, gpos)
SELECT qpos, gpos, round(least(greatest(0.7 * score + (1 - 0.7::DOUBLE) * coalesce(l, 0.0), 0.0), 1.0), 6) AS confidence FROM ranked LEFT JOIN l USING (qpos, gpos) WHERE rank <= 3""",
    "patch_regions": """
WITH e AS (SELECT id AS patch, id % 4 AS c, id // 4 AS r FROM range(16) AS t(id))
SELECT patch, CAST(round(c * 254.0::DOUBLE / 4) AS INTEGER) AS x, CAST(round(r * 250.0::DOUBLE / 4) AS INTEGER) AS y,
       CAST(round((c + 1) * 254.0::DOUBLE / 4) AS INTEGER) - CAST(round(c * 254.0::DOUBLE / 4) AS INTEGER) AS w,
       CAST(round((r + 1) * 250.0::DOUBLE / 4) AS INTEGER) - CAST(round(r * 250.0::DOUBLE / 4) AS INTEGER) AS h FROM e""",
    "l2_normalize": f"WITH {sql.BASE}, s AS (SELECT pos, list_transform(v, lambda e: e * (pos % 3 + 0.5::DOUBLE)) AS v FROM base) SELECT pos, i, round(v[i + 1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS x FROM s, range(64) AS r(i)",
    "unit_norm_violations": f"WITH {sql.BASE}, s AS (SELECT pos, list_transform(v, lambda e: e * CASE WHEN pos % 10 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM base) SELECT pos, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM s WHERE abs(sqrt(list_dot_product(v, v)) - 1) > 1e-5",
    "weighted_concat": f"""WITH {sql.BASE},
s AS (SELECT pos, v, list_reverse(v) AS u, sqrt(list_dot_product(v, v)) AS n FROM base),
c AS (SELECT pos, list_concat(list_transform(v, lambda e: e / n * sqrt(0.6::DOUBLE)), list_transform(u, lambda e: e / n * sqrt(0.4::DOUBLE))) AS z FROM s)
SELECT pos, i, round(z[i + 1] / sqrt(list_dot_product(z, z)), 6) AS x FROM c, range(128) AS r(i)""",
    "duplicate_ids": "SELECT 'img_' || (vec_id % 340) AS image_id, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) > 1",
    "bbox_validate": f"WITH {sql.BASE} SELECT pos, CASE WHEN w = 0 OR h = 0 THEN 'empty' WHEN x + w > 1920 OR y + h > 1080 THEN 'out_of_frame' ELSE 'ok' END AS status, w >= 8 AND h >= 8 AS usable FROM base",
    "bbox_clamp": f"WITH {sql.BASE} SELECT pos, least(x, 1919) AS x, least(y, 1079) AS y, least(w, 1920 - least(x, 1919)) AS w, least(h, 1080 - least(y, 1079)) AS h FROM base",
    "bbox_clip": f"""WITH {sql.BASE}, s AS (SELECT pos, x - 50 AS x, y - 20 AS y, w, h FROM base)
SELECT pos, greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(least(x + w, 1920) - greatest(x, 0), 0) AS w, greatest(least(y + h, 1080) - greatest(y, 0), 0) AS h FROM s""",
    "dba_refine": f"{_DBA} SELECT pos, i, round(x, 6) AS x FROM ref",
    "ap_at_10": f"{_WITH}, {sql.average_precision('top10', 10)} SELECT qpos, n_pos, round(ap, 6) AS ap FROM ap",
    "rank_1_5": f"{_WITH}, {sql.average_precision('top10', 10)} SELECT count(*) AS n_scored, round(avg(ap), 6) AS map10, round(avg(CAST(coalesce(first_hit <= 1, false) AS DOUBLE)), 6) AS rank1, round(avg(CAST(coalesce(first_hit <= 5, false) AS DOUBLE)), 6) AS rank5 FROM ap",
    "full_ranking_metrics": f"{_WITH}, {sql.average_precision('ranked', None)} SELECT count(*) AS n_scored, round(avg(ap), 6) AS map, round(avg(inp), 6) AS minp FROM ap",
    "junk_filtered_positives": f"WITH {sql.SIDES}, {sql.COUNTS} SELECT * FROM counts",
    "openset_queries": f"WITH {sql.SIDES} SELECT pos, vehicle_id FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.vehicle_id = q.vehicle_id AND g.camera_id <> q.camera_id)",
    "confusion_at_threshold": f"{_WITH}, {sql.DECIDED}, {sql.CONFUSION} SELECT * FROM c",
    "f1_tnr_q": f"{_WITH}, {sql.DECIDED}, {sql.CONFUSION}, {sql.RATES} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(tnr, 6) AS tnr, round(q, 6) AS q FROM rq",
    "pr_auc": f"""{_WITH}, {sql.DECIDED},
r AS (SELECT CAST(has_match AS INTEGER) AS y, sum(CAST(has_match AS INTEGER)) OVER w AS hits, count(*) OVER w AS r FROM o WINDOW w AS (ORDER BY accepted DESC, CASE WHEN accepted THEN score ELSE 0 END DESC, qpos ROWS UNBOUNDED PRECEDING))
SELECT round(sum(CASE WHEN y = 1 THEN hits / r END) / sum(y), 6) AS pr_auc FROM r""",
    "outcome_classes": f"{_WITH}, {sql.DECIDED} SELECT outcome, count(*) AS n, round(avg(score), 6) AS mean_score FROM o GROUP BY outcome",
    "threshold_sweep": f"{_WITH}, {sql.DECIDED}, {sql.SWEEP}, {sql.RATES} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(tnr, 6) AS tnr, round(q, 6) AS q FROM rq",
    "calibrate_pick": f"{_WITH}, {sql.DECIDED}, {sql.SWEEP}, {sql.RATES} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(q, 6) AS q FROM rq WHERE tnr IS NULL OR tnr >= 0.5 ORDER BY rq.q DESC, rq.threshold DESC LIMIT 1",
    "calibrate_with_reject_all": f"""{_WITH}, {sql.DECIDED}, {sql.SWEEP.replace("c AS (", "c0 AS (")},
c AS (SELECT * FROM c0 UNION ALL SELECT (SELECT CAST(max(score) AS FLOAT)::DOUBLE + pow(2, floor(log2(max(score)))) * pow(2, -23) FROM o), 0, 0, all_m, n_open, n_open FROM tot), {sql.RATES}
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(q, 6) AS q FROM rq ORDER BY rq.q DESC, rq.tnr DESC, rq.threshold DESC LIMIT 1""",
    "grid_curve": f"""{_WITH}, {sql.DECIDED},
grid AS (SELECT i, 0.30::DOUBLE + i * 0.005::DOUBLE AS t FROM range(130) AS r(i)),
c AS (SELECT i, count(*) FILTER (score >= t - 5e-12 AND correct AND has_match) AS tp, count(*) FILTER (score >= t - 5e-12 AND NOT (correct AND has_match)) AS fp,
             count(*) FILTER (has_match AND NOT coalesce(score >= t - 5e-12, false)) AS fn, count(*) FILTER (NOT has_match AND NOT coalesce(score >= t - 5e-12, false)) AS tn, count(*) FILTER (NOT has_match) AS n_open FROM grid, o GROUP BY i), {sql.RATES}
SELECT round(0.30::DOUBLE + i * 0.005::DOUBLE, 4) AS t, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE precision END, 6) AS precision, round(f1, 6) AS f1, round(coalesce(tnr, 0.0), 6) AS tnr, round(q, 6) AS q FROM rq""",
    "run_parity": f"""{_DBA},
rv AS (SELECT pos, list(x ORDER BY i) AS v FROM ref GROUP BY pos),
b AS (SELECT q.pos AS qpos, rv.pos AS gpos, list_dot_product(q.v, rv.v) AS score FROM q, rv QUALIFY row_number() OVER (PARTITION BY q.pos ORDER BY list_dot_product(q.v, rv.v) DESC, rv.pos) <= 10),
xs AS (SELECT qpos, list(gpos ORDER BY score DESC, gpos) AS x, max(score) AS xt FROM top10 GROUP BY qpos),
ys AS (SELECT qpos, list(gpos ORDER BY score DESC, gpos) AS y, max(score) AS yt FROM b GROUP BY qpos)
SELECT qpos, x[1] = y[1] AS same_top1, list_sort(x) = list_sort(y) AS same_set, x = y AS same_order, CAST(len(list_intersect(x, y)) AS BIGINT) AS overlap, round(abs(xt - yt), 6) AS top_shift FROM xs JOIN ys USING (qpos)""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "triplet_hardest": f"""WITH {sql.SIDES}, p AS (SELECT a.pos, a.vehicle_id = b.vehicle_id AS same, list_dot_product(a.v, b.v) AS s FROM base a, base b WHERE a.pos <> b.pos)
SELECT pos, round(min(CASE WHEN same THEN s END), 6) AS hardest_positive, round(max(CASE WHEN NOT same THEN s END), 6) AS hardest_negative FROM p GROUP BY pos""",
    "bootstrap_ci": f"""{_WITH}, {sql.DECIDED}, {sql.average_precision('top10', 10)},
bs AS (SELECT vehicle_id, sum(ap.ap) AS ap, count(ap.ap) AS n_ap, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
  count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (NOT has_match) AS n_open FROM o JOIN q ON q.pos = o.qpos LEFT JOIN ap ON ap.qpos = o.qpos GROUP BY vehicle_id),
bi AS (SELECT *, row_number() OVER (ORDER BY vehicle_id) - 1 AS i, count(*) OVER () AS n FROM bs),
bd AS (SELECT rep, CAST('0x' || substr(md5(rep || ':' || draw), 1, 8) AS BIGINT) % (SELECT max(n) FROM bi) AS i FROM range(2000) t(rep), range(1, (SELECT max(n) + 1 FROM bi)) u(draw)),
c AS (SELECT rep, sum(ap) / sum(n_ap) AS map, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(n_open) AS n_open FROM bd JOIN bi USING (i) GROUP BY rep), {sql.RATES},
m AS (SELECT 'map' AS metric, map AS value FROM rq UNION ALL SELECT 'q', rq.q FROM rq)
SELECT metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM m GROUP BY metric""",
    "recall_at_k": f"""WITH {sql.PAIRS},
hp AS (SELECT q.pos AS qpos, g.pos AS gpos FROM q, g QUALIFY row_number() OVER (PARTITION BY q.pos ORDER BY list_dot_product(q.v[1:32], g.v[1:32]) DESC, g.pos) <= 10),
ov AS (SELECT t.qpos, count(hp.gpos) AS overlap FROM top10 t LEFT JOIN hp ON t.qpos = hp.qpos AND t.gpos = hp.gpos GROUP BY t.qpos)
SELECT count(*) AS n, round(avg(overlap / 10), 6) AS recall FROM ov""",
}
