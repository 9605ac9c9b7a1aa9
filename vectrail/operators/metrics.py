"""Ranking, refusal and calibration metrics.

``ranked``: (qpos, gpos, score, rank, qv, gv, qc, gc) with vehicles and cameras of both
sides. A positive has the query's vehicle and another camera; junk has both the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.operators import ordered

POSITIVE, JUNK = "(qv = gv AND qc <> gc)", "(qv = gv AND qc = gc)"


def labelled(ranked: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Adds vehicle and camera of the query and of the gallery row; a row without a label keeps vehicle -1, which nothing matches."""
    side = lambda d, n: d.select(F.col("pos").alias(f"{n}pos"), F.col("vehicle_id").alias(f"{n}v"), F.col("camera_id").alias(f"{n}c"))
    return ranked.join(side(queries, "q"), "qpos").join(side(gallery, "g"), "gpos", "left").withColumn("gv", F.coalesce("gv", F.lit(-1)))


def positives(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(qpos, n_pos, n_junk) of every query: joins counts by vehicle and camera, not pairs."""
    by_both = gallery.groupBy("vehicle_id", "camera_id").agg(F.count("*").alias("n"))
    by_vehicle = by_both.groupBy(F.col("vehicle_id").alias("v")).agg(F.sum("n").alias("n_v"))
    same = by_both.select(F.col("vehicle_id").alias("v2"), F.col("camera_id").alias("c2"), "n")
    d = queries.select(F.col("pos").alias("qpos"), "vehicle_id", "camera_id")
    d = d.join(by_vehicle, F.col("vehicle_id") == F.col("v"), "left").join(same, F.expr("vehicle_id = v2 AND camera_id = c2"), "left")
    junk = F.coalesce("n", F.lit(0)).cast("long")
    return d.select("qpos", (F.coalesce("n_v", F.lit(0)) - junk).cast("long").alias("n_pos"), junk.alias("n_junk"))


def average_precision(ranked: DataFrame, counts: DataFrame, k: int | None = 10) -> DataFrame:
    """(qpos, n_pos, ap, inp, first_hit) of the queries with positives.

    Junk is stripped from the list, the rest is renumbered and cut to k. A query without a
    list scores 0. ``inp`` is n_pos over the rank of the last positive of the list.
    """
    w = Window.partitionBy("qpos").orderBy("rank")
    d = ranked.where(f"NOT {JUNK}").withColumn("r", F.row_number().over(w)).withColumn("hit", F.expr(f"cast({POSITIVE} AS int)"))
    d = d.withColumn("hits", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = d.where(F.col("r") <= k) if k else d
    per = cut.groupBy("qpos").agg(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("r"))).alias("s"), F.max(F.when(F.col("hit") == 1, F.col("r"))).alias("last"), F.min(F.when(F.col("hit") == 1, F.col("r"))).alias("first_hit"))
    top = F.least("n_pos", F.lit(k)) if k else F.col("n_pos")
    return counts.where("n_pos > 0").join(per, "qpos", "left").select("qpos", "n_pos", F.coalesce(F.col("s") / top, F.lit(0.0)).alias("ap"), F.coalesce(F.col("n_pos") / F.col("last"), F.lit(0.0)).alias("inp"), "first_hit")


def precision_of_ranks(ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """``average_precision`` over whole rankings from the ranks of the positives (qpos, gpos, rank) alone."""
    w = Window.partitionBy("qpos").orderBy("rank")
    d = ranks.withColumn("hits", F.row_number().over(w))
    return precision_of_sums(d.groupBy("qpos").agg(F.sum(F.col("hits") / F.col("rank")).alias("s"), F.max("rank").alias("last"), F.min("rank").alias("first_hit")), counts)


def precision_of_sums(per: DataFrame, counts: DataFrame) -> DataFrame:
    """``average_precision`` over whole rankings from each query's sum of hits over ranks, last and first rank (``ranking.ranked_sums``)."""
    return counts.where("n_pos > 0").join(per, "qpos", "left").select("qpos", "n_pos", F.coalesce(F.col("s") / F.col("n_pos"), F.lit(0.0)).alias("ap"), F.coalesce(F.col("n_pos") / F.col("last"), F.lit(0.0)).alias("inp"), "first_hit")


def decisions(top1: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(qpos, score, correct, has_match, accepted, outcome) of every query by its raw top candidate."""
    d = counts.join(top1.select("qpos", "score", F.expr("qv = gv").alias("correct")), "qpos", "left")
    d = d.select("qpos", "score", F.coalesce("correct", F.lit(False)).alias("correct"), (F.col("n_pos") > 0).alias("has_match"), F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("accepted"))
    outcome = F.expr("CASE WHEN accepted AND correct AND has_match THEN 'tp' WHEN accepted THEN 'fp' WHEN has_match THEN 'fn' ELSE 'tn' END")
    return d.withColumn("outcome", outcome)


def confusion(d: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, n_open (queries without a match)."""
    return d.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn", "tn")], F.count_if(~F.col("has_match")).alias("n_open"))


def rates(c: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 where undefined), tnr (null without open queries) and q = 0.7 f1 + 0.3 tnr."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    d = c.withColumn("precision", ratio(F.col("tp"), F.expr("tp + fp"))).withColumn("recall", ratio(F.col("tp"), F.expr("tp + fn")))
    d = d.withColumn("f1", ratio(F.expr("2 * precision * recall"), F.expr("precision + recall"))).withColumn("tnr", F.try_divide(F.col("tn").cast("double"), F.col("n_open")))
    return d.withColumn("q", F.expr("0.7D * f1 + 0.3D * coalesce(tnr, 0D)"))


def sweep(d: DataFrame) -> DataFrame:
    """Confusion and rates at every distinct top score as threshold, by running sums over ranges of distinct scores; equal scores move together."""
    by = d.where("score IS NOT NULL").groupBy(F.col("score").alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.expr("correct AND has_match")).alias("t"), F.count_if("has_match").alias("m"))
    total = d.agg(F.count_if("has_match").alias("all_m"), F.count_if(~F.col("has_match")).alias("n_open"))
    c = ordered.running(by, [F.desc("threshold")], {"accepted": F.col("n"), "tp": F.col("t"), "known": F.col("m")}).join(F.broadcast(total))
    return rates(c.selectExpr("threshold", "tp", "accepted - tp AS fp", "all_m - known AS fn", "n_open - (accepted - known) AS tn", "n_open"))


def pick(curve: DataFrame, objective: str = "q", min_tnr: float = 0.0) -> DataFrame:
    """The curve's row with the best (objective, threshold) among those with enough tnr; a null tnr passes.

    Fails where no row has enough.
    """
    enough = ~F.coalesce(F.col("tnr") < min_tnr, F.lit(False))
    # rows without enough sort last, so that one comes first only where there is no other
    best = curve.orderBy(F.desc(enough), F.desc(objective), F.desc("threshold")).limit(1)
    checked = F.when(enough, F.col("threshold")).otherwise(F.raise_error(F.lit(f"no threshold reaches a tnr of {min_tnr}")).cast("double"))
    return best.withColumn("threshold", checked)


def next_float(x: Column) -> Column:
    """The next single-precision number above a positive score, as a double."""
    low = x.cast("float").cast("double")
    return low + F.pow(F.lit(2.0), F.floor(F.log2(low)) - 23)


def calibrate(d: DataFrame) -> DataFrame:
    """The threshold with the best (q, tnr, threshold) among all scores and one just above the largest, which rejects all.

    Decisions of one class only (all with a match or none) fail: a threshold can't be told from them.
    """
    one = F.count_if("has_match")
    both = F.when((one == 0) | (one == F.count("*")), F.raise_error(F.lit("calibration needs queries with and without a match"))).otherwise(0)
    none = d.agg(next_float(F.max("score")).alias("threshold"), both.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), one.alias("fn"), F.count_if(~F.col("has_match")).alias("tn"), F.count_if(~F.col("has_match")).alias("n_open"))
    return sweep(d).unionByName(rates(none)).orderBy(F.desc("q"), F.desc("tnr"), F.desc("threshold")).limit(1)


def midpoint(curve: DataFrame) -> DataFrame:
    """One row (threshold, q): the middle of the widest plateau of best q over cuts half-way between neighbouring thresholds.

    ``curve``: the sweep. A cut's q is that of the threshold above it; the first cut lies 0.001 below the lowest, the last
    0.001 above the highest threshold, where all is rejected (null q there: given as ``q_none``).
    """
    c = ordered.with_neighbour(curve, [F.col("threshold")], F.col("threshold"), "below")
    c = c.withColumn("cut", F.coalesce((F.col("below") + F.col("threshold")) / 2, F.col("threshold") - 1e-3)).select("threshold", "cut", "q", "q_none")
    top = c.agg(F.max("threshold").alias("top"), F.max("q_none").alias("q_none"))
    c = c.select("cut", "q").unionByName(top.where("top IS NOT NULL").select((F.col("top") + 1e-3).alias("cut"), F.col("q_none").alias("q")))
    best = F.abs(F.col("q") - F.col("q_best")) <= 1e-8
    c = c.join(F.broadcast(c.agg(F.max("q").alias("q_best")))).withColumn("best", F.coalesce(best, F.lit(False)))
    # rows of one run of best ones have the same number of others before them
    c = ordered.running(c, [F.col("cut")], {"island": (~F.col("best")).cast("int")})
    runs = c.where("best").groupBy("island").agg(F.min("cut").alias("lo"), F.max("cut").alias("hi"), F.max("q").alias("q"))
    return runs.orderBy(F.desc(F.col("hi") - F.col("lo")), "lo").limit(1).select(((F.col("lo") + F.col("hi")) / 2).alias("threshold"), "q")


def pr_auc(d: DataFrame) -> DataFrame:
    """One row: area under precision-recall of has_match by confidence; refusals come last, in query order."""
    y = F.col("has_match").cast("int")
    order = [F.desc("accepted"), F.desc(F.expr("if(accepted, score, 0)")), F.col("qpos")]
    r = ordered.running(d.select("accepted", "score", "qpos", y.alias("y")), order, {"hits": F.col("y"), "r": F.lit(1)})
    return r.agg((F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("r"))) / F.sum("y")).alias("pr_auc"))


def grid_curve(d: DataFrame, start: float = 0.30, step: float = 0.005, points: int = 130) -> DataFrame:
    """Confusion and rates on a fixed grid; a precision without accepted rows is 1 here.

    Scores fall into grid cells, so the curve is a cumulative sum over the cells and the
    queries are read once.
    """
    cell = F.least(F.floor((F.col("score") - start) / step + 1e-9), F.lit(points - 1)).cast("int")
    by = d.where(F.col("score") >= start).groupBy(cell.alias("i")).agg(F.count("*").alias("n"), F.count_if(F.expr("correct AND has_match")).alias("t"), F.count_if("has_match").alias("m"))
    total = d.agg(F.count_if("has_match").alias("all_m"), F.count_if(~F.col("has_match")).alias("n_open"))
    grid = d.sparkSession.range(points).selectExpr("cast(id AS int) AS i")
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(by, "i", "left").select("i", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(n) for c, n in (("n", "accepted"), ("t", "tp"), ("m", "known"))]).join(F.broadcast(total))
    r = rates(full.selectExpr("i", "tp", "accepted - tp AS fp", "all_m - known AS fn", "n_open - (accepted - known) AS tn", "n_open"))
    return r.select(F.round(F.lit(start) + F.col("i") * step, 4).alias("t"), "tp", "fp", "fn", "tn", F.when(F.expr("tp + fp = 0"), 1.0).otherwise(F.col("precision")).alias("precision"), "f1", F.coalesce("tnr", F.lit(0.0)).alias("tnr"), "q")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs (qpos, gpos, score, rank) by query: same first, same set, same order, overlap, score shift."""
    lists = lambda d, n: d.groupBy("qpos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gpos"))), lambda s: s["gpos"]).alias(n), F.max("score").alias(f"{n}_top"))
    d = lists(a, "x").join(lists(b, "y"), "qpos", "full_outer")
    return d.select("qpos", (F.get("x", F.lit(0)) == F.get("y", F.lit(0))).alias("same_top1"), (F.array_sort("x") == F.array_sort("y")).alias("same_set"), (F.col("x") == F.col("y")).alias("same_order"), F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"), F.abs(F.col("x_top") - F.col("y_top")).alias("top_shift"))


def bootstrap(per_query: DataFrame, repetitions: int = 2000, level: float = 0.95) -> DataFrame:
    """(metric, low, high): percentile interval of the mean ap and of q, resampling vehicles.

    ``per_query``: vehicle_id, ap (null if unknown), outcome, has_match. A vehicle's weight
    in a repetition is the number of its draws: each of the n draws picks the vehicle with
    the matching remainder of an MD5. Only sums by (repetition, vehicle) move.
    """
    sums = per_query.groupBy("vehicle_id").agg(F.sum("ap").alias("ap"), F.count("ap").alias("n_ap"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn", "tn")], F.count_if(~F.col("has_match")).alias("n_open"))
    numbered = ordered.numbered(sums, [F.col("vehicle_id")], "i")
    n = numbered.agg(F.count("*").alias("n"))
    draws = per_query.sparkSession.range(repetitions).withColumnRenamed("id", "rep").join(F.broadcast(n)).select("rep", F.expr("explode(sequence(1, cast(n AS int))) AS draw"), "n")
    lot = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "draw")), 1, 8), 16, 10).cast("long")
    draws = draws.select("rep", (lot % F.col("n")).cast("int").alias("i"))
    c = draws.join(numbered, "i").groupBy("rep").agg((F.sum("ap") / F.sum("n_ap")).alias("map"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn", "n_open")])
    tail = (1 - level) / 2
    out = rates(c).select(F.explode(F.create_map(F.lit("map"), F.col("map"), F.lit("q"), F.col("q"))).alias("metric", "value"))
    return out.groupBy("metric").agg(F.expr(f"percentile(value, {tail})").alias("low"), F.expr(f"percentile(value, {1 - tail})").alias("high"))
