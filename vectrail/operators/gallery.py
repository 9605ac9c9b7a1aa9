"""Gallery and search service rules as DataFrame operations: cards, regions, plates, pages, inserts, import reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors
from vectrail.operators import ranking

#: Longest plate in characters; page sizes; candidates of a search; matches that are shown.
PLATE_CHARS, PAGE, MOST_PAGE, TOP_N, MOST_TOP_N, SHOWN = 32, 20, 200, 10, 100, 12
#: Where crops are stored and how the service shows them.
CROP_ROOT, CROP_URL = "s3://crops", "/files/crops/"


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A struct x, y, w, h if all four are there, else null."""
    whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(whole, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def plate_problem(plate: Column) -> Column:
    """'empty' or 'too_long' of a plate after trimming; null where it is fine. A null plate clears the old one."""
    trimmed = F.regexp_replace(plate, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, "empty").when(F.length(trimmed) > PLATE_CHARS, "too_long")


def page_of(page: int | None, size: int | None, total: int) -> tuple[int, int, int]:
    """(offset, limit, pages) of a page request: pages from 1, 1 to 200 rows, 20 unless said."""
    limit = min(max(PAGE if size is None else size, 1), MOST_PAGE)
    return (max(page or 1, 1) - 1) * limit, limit, math.ceil(total / limit)


def page_columns(page: Column, size: Column, total: Column) -> list[Column]:
    """``page_of`` on columns: offset, limit, pages."""
    limit = F.least(F.greatest(F.coalesce(size, F.lit(PAGE)), F.lit(1)), F.lit(MOST_PAGE))
    at = (F.greatest(F.coalesce(page, F.lit(1)), F.lit(1)) - 1) * limit
    return [at.alias("offset"), limit.alias("limit"), F.ceil(total / limit).alias("pages")]


def top_n(asked: Column) -> Column:
    """How many candidates a search returns: 1 to 100, 10 unless said."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(TOP_N)), F.lit(1)), F.lit(MOST_TOP_N))


def crop_url(uri: Column) -> Column:
    """The public address of a stored crop; null for anything outside the crop root."""
    root = f"{CROP_ROOT}/"
    return F.when(uri.startswith(root), F.concat(F.lit(CROP_URL), F.substr(uri, F.lit(len(root) + 1))))


def inserted(items: DataFrame, version: str) -> DataFrame:
    """New gallery rows: a blank or missing image_id becomes a random one, the version is stamped, tags are empty."""
    own = F.when(F.trim("image_id") != "", F.col("image_id"))
    return items.withColumns({"image_id": F.coalesce(own, F.expr("uuid()")), "model_version": F.lit(version), "tags": F.array().cast("array<string>")})


def search(queries: DataFrame, gallery: DataFrame, cards: DataFrame, threshold: float, k: int = TOP_N, alpha: float | None = None) -> DataFrame:
    """A search from vectors to cards: (qpos, place, gpos, score, confidence, accepted, and the columns of ``cards``).

    Nearest k by score; with ``alpha`` the confidence blends in the local score of mutual patch matches, else it is the
    score. Candidates are put in order of confidence, ties in that of the search. A candidate without a card (pos, ...)
    keeps its row with nulls.
    """
    top = ranking.top_k(queries, gallery, k)
    if alpha is None:
        d = top.withColumn("confidence", F.col("score"))
    else:
        local = ranking.local_scores(top, ranking.tokens(queries), ranking.tokens(gallery))
        d = top.join(local, ["qpos", "gpos"]).withColumn("confidence", vectors.blend(F.col("score"), F.col("local_score"), alpha)).drop("local_score")
    place = F.row_number().over(Window.partitionBy("qpos").orderBy(F.desc("confidence"), "rank"))
    d = d.withColumn("place", place.cast("long")).withColumn("accepted", F.col("confidence") >= threshold).drop("rank")
    return d.join(cards.withColumnRenamed("pos", "gpos"), "gpos", "left")


def export_lines(found: DataFrame) -> DataFrame:
    """(qpos, place, line) of a search as CSV lines gallery_id,score,confidence,plate; a null plate is empty."""
    line = F.concat_ws(",", F.concat(F.lit("img_"), "gpos"), F.format_string("%.6f", "score"), F.format_string("%.6f", "confidence"), F.coalesce("plate", F.lit("")))
    return found.select("qpos", "place", line.alias("line"))


def import_report(items: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Each item's import status: the batch is embedded first, then rows fail one by one.

    'no_image' where nothing could be embedded, then the box's problem, then 'repeated' for all but the first row of an id.
    """
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))
    status = (
        F.when(F.col("embedding").isNull(), "no_image").when(F.expr("w = 0 OR h = 0"), "empty")
        .when(F.col("x") + F.col("w") > frame_w, "out_of_frame").when(F.col("y") + F.col("h") > frame_h, "out_of_frame").when(F.col("_n") > 1, "repeated").otherwise("imported")
    )
    return items.withColumn("_n", first).withColumn("status", status).drop("_n")
