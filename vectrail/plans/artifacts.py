"""Queries on a run's artifacts: array files, summaries, verification, parity, calibration, training lists and samplers."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import boxes
from vectrail.functions.vectors import doubles, dot
from vectrail.operators import metrics, ordered, ranking, sampling, verification
from vectrail.plans import sql
from vectrail.plans.retrieval import _DBA, _WITH, THRESHOLD, _decided, _six
from vectrail.sources import arrays, npy, readers, tables
from vectrail.sources.shared import place as _place
from vectrail.sources.shared import stored


#: Threshold of the verified run, whose scores are higher as its gallery is refined.
RUN_THRESHOLD = 0.45


def _round_trip(spark, sf, kind):
    path = _place(spark, kind)
    arrays.write_matrix(tables.gallery_base(spark, sf).select("pos", "embedding").repartitionByRange(4, "pos"), path, kind)
    d = arrays.read_matrix(spark, path, kind)
    return d.select("pos", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def npy_round_trip(spark, sf):
    """All vectors written as .npy parts and read back."""
    return _round_trip(spark, sf, "npy")


def f32_round_trip(spark, sf):
    """All vectors written as raw floats with sidecars and read back."""
    return _round_trip(spark, sf, "f32")


def matrix_shape(spark, sf):
    """Rows and dimensions of the vectors, and whether all have the same."""
    return tables.gallery_base(spark, sf).agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("consistent"))


def run_summary(spark, sf):
    """A run's summary with its accepted queries, written as JSON and read back without its seconds."""
    began = time.monotonic()
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    refined, threshold = verification.retrieval_policy({"threshold": THRESHOLD})
    summary = {"model": "tables", "version": tables.CURRENT_VERSION, "provider": "spark", "threshold": threshold, "retrieval": "gallery_dba_k4_alpha2" if refined else "cosine"}
    accepted = ranking.top_k(q, g, 1).where(F.col("score") >= threshold).count()
    path = _place(spark, "run") + ".json"
    arrays.write_summary(spark, path, summary | {"n_query": q.count(), "n_gallery": g.count(), "accepted": accepted, "batch_size": 1, "seconds": round(time.monotonic() - began, 2)})
    d = spark.read.schema("model string, version string, provider string, threshold double, retrieval string, n_query long, n_gallery long, accepted long, batch_size long, seconds double").json(path)
    return d.where("seconds >= 0").drop("seconds")


def _numbered_sides(spark, sf):
    """Queries and gallery numbered in order of pos, as a run's CSV files list them."""
    sides = (tables.queries(spark, sf), tables.gallery(spark, sf))
    return [stored(ordered.numbered(d.select("pos", "image_id", "embedding"), [F.col("pos")], "at"), "side") for d in sides]


def _input_files(sides, folder):
    """Writes both lists of ids; returns their paths and the vectors as rows of one array."""
    n_q = sides[0].count()
    for d, name in zip(sides, ("query.csv", "gallery.csv"), strict=True):
        d.repartitionByRange(3, "at").sortWithinPartitions("at").select(F.lit(1).alias("x"), "image_id").write.csv(f"{folder}/{name}", header=True)
    rows = sides[0].select(F.col("at").alias("row"), "embedding").unionByName(sides[1].select((F.col("at") + n_q).alias("row"), "embedding"))
    return f"{folder}/query.csv", f"{folder}/gallery.csv", rows


def evaluation_vectors(spark, sf):
    """An array written in order of two CSV files, read by ranges and given back its ids; normalised."""
    folder, sides = _place(spark, "evaluation"), _numbered_sides(spark, sf)
    q, g, rows = _input_files(sides, folder)
    arrays.write_matrix(rows.select(F.col("row").alias("pos"), F.transform("embedding", lambda x: x * 4).alias("embedding")).repartitionByRange(4, "pos").sortWithinPartitions("pos"), f"{folder}/embeddings")
    d = npy.evaluation_vectors(spark, f"{folder}/embeddings", q, g, part_bytes=8192)
    return d.select("side", "at", "image_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def artifact_verification(spark, sf):
    """What is wrong in a run's files, which are written with planted faults and read again.

    Every seventh line swaps its first two candidates, from every seventh plus 1 an accepted query is not listed, plus 2 has a
    wrong confidence, plus 3 is listed where it was refused.
    """
    folder, sides = _place(spark, "artifacts"), _numbered_sides(spark, sf)
    query_csv, gallery_csv, rows = _input_files(sides, folder)
    manifest = verification.manifest_of(RUN_THRESHOLD, 64)
    lines = verification.ranked_lines(*(d.select("at", "image_id", "embedding") for d in sides), *verification.retrieval_policy(manifest))
    ids, fault = F.split("line", ","), F.col("at") % 7
    swapped = F.concat_ws(",", ids[0], ids[2], ids[1], F.slice(ids, 4, 8))
    confidence = F.when(fault == 2, F.col("score") + 0.01).otherwise(F.col("score"))
    verification.write_run(lines, rows, folder, {"threshold": RUN_THRESHOLD}, F.when(fault == 0, swapped).otherwise(F.col("line")), F.when(fault == 1, False).when(fault == 3, True).otherwise(F.col("accepted")), confidence)
    d = verification.verify(spark, folder, query_csv, gallery_csv, manifest)
    return d.select("query_id", "problem")


def retrieval_policies(spark, sf):
    """The policies of manifests in many forms."""
    method = F.expr("CASE pos % 4 WHEN 0 THEN 'gallery_dba' WHEN 1 THEN 'cosine' WHEN 2 THEN NULL ELSE if(pos % 3 = 0, 'other', 'gallery_dba') END")
    own = F.struct(method.alias("method"), F.expr("cast(4 - pos % 5 DIV 4 AS int)").alias("k"), F.lit(2).alias("alpha"), F.expr("if(pos % 7 = 0, NULL, pos / 1000)").alias("threshold"))
    d = tables.gallery_base(spark, sf).select("pos", F.to_json(F.struct(F.expr("if(pos % 6 = 5, NULL, pos / 500)").alias("threshold"), own.alias("retrieval"))).alias("manifest"))
    return d.select("pos", *verification.policy_columns(F.col("manifest")))


def run_decisions(spark, sf):
    """Two runs by their decisions: both accept and name the same, both refuse, greatest confidence difference."""
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    one = lambda d, n: d.select("qpos", F.col("gpos").alias(f"{n}_gpos"), F.col("score").alias(f"{n}_score"), (F.col("score") >= THRESHOLD).alias(n))
    refined = ranking.dba_refine(g.select("pos", "embedding"))
    d = one(ranking.top_k(q, g, 1), "a").join(one(ranking.top_k(q, refined, 1), "b"), "qpos")
    both = F.col("a") & F.col("b")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same_decision"), F.count_if(both).alias("both_accept"), F.count_if(both & (F.col("a_gpos") == F.col("b_gpos"))).alias("same_candidate"), F.round(F.max(F.abs(F.col("a_score") - F.col("b_score"))), 6).alias("most_difference"))


def vector_drift(spark, sf):
    """Least and median cosine of each row's vector between two runs; the second has every seventh one reversed."""
    d = tables.gallery_base(spark, sf).select("pos", doubles("embedding").alias("a"), doubles(F.when(F.col("pos") % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))).alias("b"))
    c = d.select((dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("c"))
    return c.agg(F.round(F.min("c"), 6).alias("least"), F.round(F.expr("percentile(c, 0.5)"), 6).alias("median"), F.round(1 - F.avg("c"), 6).alias("shift"))


def float_dot(spark, sf):
    """Scores of queries and their own vehicle's next row, summed from left to right in single precision."""
    w = Window.partitionBy("vehicle_id").orderBy("pos")
    d = tables.gallery_base(spark, sf).select("pos", F.col("embedding").alias("a"), F.lead("embedding").over(w).alias("b")).where("b IS NOT NULL")

    def run(batches):
        for batch in batches:
            a, b = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.float32) for c in (1, 2))
            total = np.zeros(len(a), np.float32)
            for k in range(a.shape[1]):
                total = total + a[:, k] * b[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], names=["pos", "score"])

    return d.mapInArrow(run, "pos long, score float").select("pos", F.round(F.col("score").cast("double"), 4).alias("score"))


def inventory_digest(spark, sf):
    """SHA-256 over each vehicle's rows as JSON lines in order, and their number."""
    line = F.to_json(F.struct("pos", "image_id", "camera_id"))
    d = tables.gallery_base(spark, sf).groupBy("vehicle_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("r"))
    return d.select("vehicle_id", "n", F.sha2(F.concat_ws("\n", F.transform("r", lambda x: x["line"])), 256).alias("digest"))


def calibrate_midpoint(spark, sf):
    d = _decided(spark, sf)
    n = d.agg(F.count_if(~F.col("has_match")).alias("n_open"))
    curve = metrics.sweep(d).drop("n_open").join(F.broadcast(n.select(F.when(F.col("n_open") > 0, 0.3).otherwise(0.0).alias("q_none"))))
    return metrics.midpoint(curve).select(_six("threshold"), _six("q"))


def holdout_classes(spark, sf):
    """Queries by outcome: absent from the gallery, first candidate correct, or wrong."""
    kind = F.when(~F.col("has_match"), "absent").when(F.col("correct"), "correct").otherwise("wrong")
    return _decided(spark, sf).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))


def metric_counts(spark, sf):
    """Queries scored, left out as open-set, and without a list."""
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    listed = ranking.top_k(q, g.where("vehicle_id <> 1"), 10).where("qpos % 3 <> 0").select("qpos").distinct().withColumn("listed", F.lit(True))
    d = metrics.positives(q, g).join(listed, "qpos", "left")
    return d.agg(F.count_if(F.expr("n_pos > 0")).alias("n_scored"), F.count_if(F.expr("n_pos = 0")).alias("n_openset_excluded"), F.count_if(F.expr("n_pos > 0 AND listed IS NULL")).alias("n_missing"))


def unlabelled_candidates(spark, sf):
    """Ranked candidates with their vehicle, -1 where the gallery row has no label."""
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    d = metrics.labelled(ranking.top_k(q, g, 3), q, g.where("pos % 4 <> 1"))
    return d.select("qpos", F.col("rank").cast("long").alias("rank"), F.col("gv").cast("long").alias("gv"))


def latency_scores(spark, sf):
    """Latency and throughput scores of events taken as milliseconds and frames a second."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    d = tables.table(spark, sf, "events")
    return d.select("event_id", F.round(clip((80 - F.col("value")) / 40), 6).alias("latency_score"), F.round(clip((F.col("value") - 50) / 50), 6).alias("throughput_score"))


def bbox_clip_strict(spark, sf):
    """Boxes cut at the frame's edges; those with nothing left are rejected, and so are those that a strict reader refuses."""
    d = tables.gallery_base(spark, sf).selectExpr("pos", "x - 300 AS x", "y - 20 AS y", "w", "h")
    x, y, w, h = boxes.clip(*map(F.col, "xywh"), tables.FRAME_W, tables.FRAME_H)
    d = d.select("pos", x.alias("cx"), y.alias("cy"), w.alias("cw"), h.alias("ch"), ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > tables.FRAME_W) | (F.col("y") + F.col("h") > tables.FRAME_H)).alias("refused"))
    return d.where("cw > 0 AND ch > 0")


def bbox_scale(spark, sf):
    """Boxes from screen corners to the frame and whether they are large enough to search with."""
    d = tables.gallery_base(spark, sf).select("pos", *boxes.from_corners(F.col("x") / 3, F.col("y") / 3, (F.col("x") + F.col("w")) / 3, (F.col("y") + F.col("h") / 8) / 3, 3.0))
    return d.withColumn("usable", boxes.usable(F.col("w"), F.col("h")))


def masked_area(spark, sf):
    """Share of crops with a masked zone, and the mean share of their area (boxes of regions in tags)."""
    d = tables.tags(spark, sf).where("box_x IS NOT NULL").groupBy("item_id").agg(F.sum(F.col("box_w") * F.col("box_h") / 4).alias("masked"))
    d = tables.gallery_base(spark, sf).join(d, F.col("pos") == F.col("item_id"), "left").withColumn("share", F.coalesce(F.col("masked") / (F.col("w") * F.col("h")), F.lit(0.0)))
    return d.agg(F.count("*").alias("n"), F.count_if(F.expr("masked IS NOT NULL")).alias("n_masked"), F.round(F.avg("share"), 6).alias("mean_share"))


def exact_exclusion(spark, sf):
    """Rows without those that a list names by all seven columns; a name that doesn't match one row exactly fails."""
    key = ["image_id", "vehicle_id", "camera_id", "x", "y", "w", "h"]
    rows = tables.gallery_base(spark, sf).select("pos", *key)
    return sampling.excluded(rows, rows.where("pos % 12 = 0").select(*key), key).select("pos")


def dataset_counts(spark, sf):
    return tables.gallery_base(spark, sf).agg(F.count("*").alias("images"), F.countDistinct("vehicle_id").alias("identities"), F.countDistinct("camera_id").alias("cameras"))


def _list(spark, sf, what, parity):
    d = tables.gallery_base(spark, sf).where(f"vehicle_id % 2 = {parity}")
    line = F.concat(F.lit(".\\"), F.lit(what), F.lit("\\"), "image_id", F.expr("CASE pos % 3 WHEN 0 THEN ' ' WHEN 1 THEN ',' ELSE '; ' END"), F.concat_ws(" ", F.concat(F.lit("v"), "vehicle_id"), "camera_id", F.expr("vehicle_id DIV 2")))
    head = spark.createDataFrame([("path identity camera label",), ("",)], "line string")
    return readers.parse_train_list(d.select(line.alias("line")).unionByName(head))


def train_list(spark, sf):
    return _list(spark, sf, "a", 0)


def train_list_union(spark, sf):
    """Two lists under one numbering."""
    return readers.union_lists({"a": _list(spark, sf, "a", 0), "b": _list(spark, sf, "b", 1)})


def _batches(spark, sf):
    rows = tables.gallery_base(spark, sf).select("pos", "vehicle_id", "camera_id")
    return sampling.identity_batches(rows, 3, 4, 20)


def identity_batches(spark, sf):
    """Seeded batches of 3 identities with 4 rows each, other cameras first."""
    return _batches(spark, sf)


def batch_rules(spark, sf):
    """Batches with other than 3 identities, or 4 rows of one, or with fewer cameras than they could have: none."""
    rows = tables.gallery_base(spark, sf)
    has = rows.groupBy("vehicle_id").agg(F.countDistinct("camera_id").alias("cams"))
    d = _batches(spark, sf).join(rows.select("pos", "camera_id"), "pos").groupBy("batch", "vehicle_id").agg(F.count("*").alias("n"), F.countDistinct("camera_id").alias("c"))
    d = d.join(has, "vehicle_id").withColumn("bad", (F.col("n") != 4) | (F.col("c") < F.least("cams", F.lit(4))))
    return d.groupBy("batch").agg(F.count("*").alias("identities"), F.count_if("bad").alias("bad"))


def balanced_batches(spark, sf):
    """Batches over two cameras per identity, blocks of 3 + 1 made 2 + 2: rows by camera and block."""
    rows = tables.gallery_base(spark, sf).selectExpr("pos", "vehicle_id", "pos % 4 DIV 3 AS camera_id")
    d = sampling.balanced(sampling.identity_batches(rows, 3, 4, 20), rows)
    return d.groupBy("batch", "vehicle_id").agg(F.count("*").alias("n"), F.count_if(F.expr("camera_id = 0")).alias("first"), F.count_if(F.expr("camera_id = 1")).alias("second"))


def sampler_coverage(spark, sf):
    """Rows and identities that batches have shown by the end of each epoch of five batches."""
    d = _batches(spark, sf).withColumn("epoch", F.expr("batch DIV 5"))
    return sampling.coverage(d, "epoch")


def row_remap(spark, sf):
    """Old moments carried to a new numbering by identity, zeros for new ones."""
    old = tables.gallery_base(spark, sf).where("pos % 2 = 0").groupBy(F.concat(F.lit("v"), "vehicle_id").alias("identity")).agg(F.sum(F.col("embedding")[0].cast("double")).alias("moment"))
    ids = tables.gallery_base(spark, sf).select(F.explode(F.array(F.concat(F.lit("v"), "vehicle_id"), F.concat(F.lit("w"), "vehicle_id"))).alias("identity")).distinct()
    new = ordered.numbered(ids, [F.col("identity")], "row")
    return new.join(old, "identity", "left").select("row", "identity", F.round(F.coalesce("moment", F.lit(0.0)), 5).alias("moment"))


def cyclic_batches(spark, sf):
    """Rows by batch of 32 and by place in a cycle of 100."""
    return tables.gallery_base(spark, sf).select("pos", F.floor(F.col("pos") / 32).alias("batch"), (F.col("pos") % 100).alias("place"))


def warmup_factor(spark, sf):
    d = spark.range(60).selectExpr("id AS step", "id % 4 * 10 AS warm")
    return d.select("step", F.round(F.least(F.lit(1.0), (F.col("step") + 1) / F.greatest("warm", F.lit(1))), 6).alias("factor"))


def clustered_vectors(spark, sf):
    """Synthetic unit vectors around centres: norms and similarity to the own centre, in whole numbers."""
    d = sampling.clustered(spark, 2000, 32, 50, 0.5)
    return d.select("pos", "owner", F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm"))


_NAMES = """
npy_round_trip f32_round_trip matrix_shape evaluation_vectors run_summary artifact_verification retrieval_policies run_decisions vector_drift float_dot inventory_digest calibrate_midpoint
holdout_classes metric_counts unlabelled_candidates latency_scores bbox_clip_strict bbox_scale masked_area exact_exclusion dataset_counts train_list
train_list_union identity_batches batch_rules balanced_batches sampler_coverage row_remap cyclic_batches warmup_factor clustered_vectors
"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_SUMS = "SELECT vec_id AS pos, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings"
ORACLES = {
    "npy_round_trip": _SUMS,
    "f32_round_trip": _SUMS,
    "matrix_shape": "SELECT count(*) AS n, CAST(min(len(embedding)) AS BIGINT) AS dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings",
    "run_summary": f"WITH {sql.PAIRS} SELECT 'tables' AS model, '1.2.0' AS version, 'spark' AS provider, 0.35::DOUBLE AS threshold, 'cosine' AS retrieval, (SELECT count(*) FROM q) AS n_query, (SELECT count(*) FROM g) AS n_gallery, (SELECT count(*) FROM ranked WHERE rank = 1 AND score >= 0.35) AS accepted, 1::BIGINT AS batch_size",
    "evaluation_vectors": f"""WITH {sql.SIDES}, s AS (SELECT 'query' AS side, * FROM q UNION ALL SELECT 'gallery', * FROM g)
SELECT side, row_number() OVER (PARTITION BY side ORDER BY pos) - 1 AS at, image_id, round(list_sum(v) / sqrt(list_dot_product(v, v)), 5) AS total FROM s""",
    "artifact_verification": f"""{_DBA},
rv AS (SELECT pos, list(x ORDER BY i) AS v FROM ref GROUP BY pos),
b AS (SELECT q.pos AS qpos, max(list_dot_product(q.v, rv.v)) >= 0.45 AS accepted FROM q, rv GROUP BY q.pos),
n AS (SELECT 'img_' || qpos AS query_id, accepted, (row_number() OVER (ORDER BY qpos) - 1) % 7 AS fault FROM b)
SELECT query_id, CASE fault WHEN 0 THEN 'ranking' WHEN 2 THEN 'confidence' ELSE 'decision' END AS problem FROM n WHERE fault = 0 OR (fault IN (1, 2) AND accepted) OR (fault = 3 AND NOT accepted)""",
    "retrieval_policies": """WITH d AS (SELECT vec_id AS pos, CASE vec_id % 4 WHEN 0 THEN 'gallery_dba' WHEN 1 THEN 'cosine' WHEN 2 THEN 'cosine' ELSE CASE WHEN vec_id % 3 = 0 THEN 'other' ELSE 'gallery_dba' END END AS method,
4 - vec_id % 5 // 4 AS k, CASE WHEN vec_id % 7 <> 0 THEN vec_id / 1000 END AS t, CASE WHEN vec_id % 6 <> 5 THEN vec_id / 500 END AS u FROM embeddings),
e AS (SELECT pos, method = 'gallery_dba' AS refined, CASE WHEN method = 'gallery_dba' THEN t ELSE u END AS threshold, CASE WHEN method = 'other' THEN 'method' WHEN method = 'gallery_dba' AND k <> 4 THEN 'parameters' END AS p FROM d),
f AS (SELECT *, coalesce(p, CASE WHEN threshold IS NULL THEN 'no threshold' END) AS problem FROM e)
SELECT pos, CASE WHEN problem IS NULL THEN refined END AS refined, CASE WHEN problem IS NULL THEN threshold END AS threshold, problem FROM f""",
    "run_decisions": f"""{_DBA},
rv AS (SELECT pos, list(x ORDER BY i) AS v FROM ref GROUP BY pos),
b AS (SELECT q.pos AS qpos, rv.pos AS gpos, list_dot_product(q.v, rv.v) AS score FROM q, rv QUALIFY row_number() OVER (PARTITION BY q.pos ORDER BY list_dot_product(q.v, rv.v) DESC, rv.pos) = 1),
j AS (SELECT a.score >= 0.35 AS a, b.score >= 0.35 AS b, a.gpos = b.gpos AS same, abs(a.score - b.score) AS d FROM ranked a JOIN b USING (qpos) WHERE rank = 1)
SELECT count(*) AS n, count(*) FILTER (a = b) AS same_decision, count(*) FILTER (a AND b) AS both_accept, count(*) FILTER (a AND b AND same) AS same_candidate, round(max(d), 6) AS most_difference FROM j""",
    "vector_drift": f"""WITH {sql.BASE}, c AS (SELECT list_cosine_similarity(v, CASE WHEN pos % 7 = 0 THEN list_reverse(v) ELSE v END) AS c FROM base)
SELECT round(min(c), 6) AS least, round(quantile_cont(c, 0.5), 6) AS median, round(1 - avg(c), 6) AS shift FROM c""",
    "float_dot": f"WITH {sql.BASE}, n AS (SELECT pos, v AS a, lead(v) OVER (PARTITION BY vehicle_id ORDER BY pos) AS b FROM base) SELECT pos, round(list_dot_product(a, b), 4) AS score FROM n WHERE b IS NOT NULL",
    "inventory_digest": f"""WITH {sql.BASE} SELECT vehicle_id, count(*) AS n, sha256(string_agg('{{"pos":' || pos || ',"image_id":"' || image_id || '","camera_id":' || camera_id || '}}', chr(10) ORDER BY pos)) AS digest FROM base GROUP BY vehicle_id""",
    "calibrate_midpoint": f"""{_WITH}, {sql.DECIDED}, {sql.SWEEP}, {sql.RATES},
k AS (SELECT coalesce((lag(threshold) OVER (ORDER BY threshold) + threshold) / 2, threshold - 1e-3) AS cut, q FROM rq UNION ALL SELECT max(threshold) + 1e-3, max(CASE WHEN n_open > 0 THEN 0.3 ELSE 0.0 END) FROM rq),
f AS (SELECT cut, q, abs(q - max(q) OVER ()) <= 1e-8 AS best, row_number() OVER (ORDER BY cut) AS r FROM k),
i AS (SELECT min(cut) AS lo, max(cut) AS hi, max(q) AS q FROM (SELECT *, r - row_number() OVER (ORDER BY cut) AS g FROM f WHERE best) GROUP BY g)
SELECT round((lo + hi) / 2, 6) AS threshold, round(q, 6) AS q FROM i ORDER BY hi - lo DESC, lo LIMIT 1""",
    "holdout_classes": f"{_WITH}, {sql.DECIDED} SELECT CASE WHEN NOT has_match THEN 'absent' WHEN correct THEN 'correct' ELSE 'wrong' END AS class, count(*) AS n, count(*) FILTER (accepted) AS n_accepted FROM o GROUP BY 1",
    "metric_counts": f"WITH {sql.SIDES}, {sql.COUNTS} SELECT count(*) FILTER (n_pos > 0) AS n_scored, count(*) FILTER (n_pos = 0) AS n_openset_excluded, count(*) FILTER (n_pos > 0 AND qpos % 3 = 0) AS n_missing FROM counts",
    "unlabelled_candidates": f"WITH {sql.PAIRS} SELECT qpos, rank, CAST(CASE WHEN gpos % 4 <> 1 THEN gv ELSE -1 END AS BIGINT) AS gv FROM ranked WHERE rank <= 3",
    "latency_scores": "SELECT event_id, round(greatest(least((80 - value) / 40, 1.0), 0.0), 6) AS latency_score, round(greatest(least((value - 50) / 50, 1.0), 0.0), 6) AS throughput_score FROM events",
    "bbox_clip_strict": f"""WITH {sql.BASE}, s AS (SELECT pos, x - 300 AS x, y - 20 AS y, w, h FROM base)
SELECT pos, greatest(x, 0) AS cx, greatest(y, 0) AS cy, least(x + w, 1920) - greatest(x, 0) AS cw, least(y + h, 1080) - greatest(y, 0) AS ch, x < 0 OR y < 0 OR x + w > 1920 OR y + h > 1080 AS refused FROM s
WHERE least(x + w, 1920) > greatest(x, 0) AND least(y + h, 1080) > greatest(y, 0)""",
    "bbox_scale": f"""WITH {sql.BASE}, s AS (SELECT pos, x, y, w, CAST(round((y + h / 8.0::DOUBLE) / 3 * 3.0) AS INTEGER) - y AS h FROM base) SELECT pos, x, y, w, h, w >= 8 AND h >= 8 AS usable FROM s""",
    "masked_area": f"WITH {sql.BASE} SELECT count(*) AS n, count(*) FILTER (pos % 2 = 0) AS n_masked, round(avg(CASE WHEN pos % 2 = 0 THEN 0.25 ELSE 0.0 END), 6) AS mean_share FROM base",
    "exact_exclusion": "SELECT vec_id AS pos FROM embeddings WHERE vec_id % 12 <> 0",
    "dataset_counts": f"WITH {sql.BASE} SELECT count(*) AS images, count(DISTINCT vehicle_id) AS identities, count(DISTINCT camera_id) AS cameras FROM base",
    "train_list": f"WITH {sql.BASE} SELECT 'a/' || image_id AS path, 'v' || vehicle_id AS identity, CAST(camera_id AS VARCHAR) AS camera, CAST(vehicle_id // 2 AS BIGINT) AS label FROM base WHERE vehicle_id % 2 = 0",
    "train_list_union": f"""WITH {sql.BASE}, u AS (SELECT CASE vehicle_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS l, * FROM base)
SELECT l || '/' || image_id AS path, l || ':v' || vehicle_id AS identity, CAST(camera_id AS VARCHAR) AS camera, CAST(dense_rank() OVER (ORDER BY l || ':v' || vehicle_id) - 1 AS BIGINT) AS label FROM u""",
    "batch_rules": "SELECT CAST(i AS BIGINT) AS batch, CAST(3 AS BIGINT) AS identities, CAST(0 AS BIGINT) AS bad FROM range(20) t(i)",
    "row_remap": f"""WITH {sql.BASE}, o AS (SELECT 'v' || vehicle_id AS identity, sum(v[1]) AS moment FROM base WHERE pos % 2 = 0 GROUP BY 1),
i AS (SELECT DISTINCT unnest(['v' || vehicle_id, 'w' || vehicle_id]) AS identity FROM base)
SELECT row_number() OVER (ORDER BY identity) - 1 AS row, identity, round(coalesce(moment, 0.0), 5) AS moment FROM i LEFT JOIN o USING (identity)""",
    "cyclic_batches": "SELECT vec_id AS pos, CAST(vec_id // 32 AS BIGINT) AS batch, vec_id % 100 AS place FROM embeddings",
    "warmup_factor": "SELECT i AS step, round(least(1.0, (i + 1) / greatest(i % 4 * 10, 1)), 6) AS factor FROM range(60) t(i)",
    "clustered_vectors": "SELECT i AS pos, i % 50 AS owner, 1.0::DOUBLE AS norm FROM range(2000) t(i)",
}
_MD5 = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"
_DRAWN = f"""WITH {sql.BASE},
ids AS (SELECT b AS batch, vehicle_id FROM range(20) t(b), (SELECT DISTINCT vehicle_id FROM base) QUALIFY row_number() OVER (PARTITION BY b ORDER BY md5('7:' || b || ':' || vehicle_id), vehicle_id) <= 3),
m AS (SELECT batch, i.vehicle_id, pos, camera_id, md5('7:' || batch || ':row:' || pos) AS h, md5('7:' || batch || ':' || i.vehicle_id || ':' || camera_id) AS hc FROM ids i JOIN base USING (vehicle_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY batch, vehicle_id, camera_id ORDER BY h, pos) > 1 AS again FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY batch, vehicle_id ORDER BY again, CASE WHEN again THEN h ELSE hc END, pos) AS k, count(*) OVER (PARTITION BY batch, vehicle_id) AS n FROM o),
d AS (SELECT batch, vehicle_id, pos, slot FROM r, range(4) t(slot) WHERE k - 1 = slot % n)"""
ORACLES["identity_batches"] = f"{_DRAWN} SELECT batch, vehicle_id, slot, pos FROM d"
ORACLES["sampler_coverage"] = f"""{_DRAWN}, f AS (SELECT pos, vehicle_id, min(batch // 5) AS e FROM d GROUP BY ALL), v AS (SELECT vehicle_id, min(e) AS e FROM f GROUP BY 1)
SELECT CAST(x AS BIGINT) AS epoch, (SELECT count(*) FROM f WHERE e <= x) AS rows, (SELECT count(*) FROM v WHERE e <= x) AS identities FROM range(4) t(x)"""
_TWO = _DRAWN.replace("vec_id % 7 AS camera_id", "vec_id % 4 // 3 AS camera_id")
ORACLES["balanced_batches"] = f"""{_TWO}, c AS (SELECT vehicle_id FROM (SELECT vehicle_id, camera_id, count(*) AS n FROM base GROUP BY ALL) GROUP BY vehicle_id HAVING count(*) = 2 AND min(n) >= 2),
k AS (SELECT batch, vehicle_id, count(*) AS n, count(*) FILTER (camera_id = 0) AS first, count(*) FILTER (camera_id = 1) AS second FROM d JOIN base USING (pos, vehicle_id) GROUP BY ALL)
SELECT k.batch, k.vehicle_id, n, CASE WHEN abs(first - second) = 2 AND c.vehicle_id IS NOT NULL THEN 2 ELSE first END AS first, CASE WHEN abs(first - second) = 2 AND c.vehicle_id IS NOT NULL THEN 2 ELSE second END AS second FROM k LEFT JOIN c USING (vehicle_id)"""
