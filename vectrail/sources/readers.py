"""Readers and writers of box tables, submitted lists and candidates, and a resumable import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.operators import ordered

BOXES = "image_id string, x int, y int, w int, h int"
#: Ids are one plain file name.
UNSAFE_ID = r"^$|^\.\.?$|[/\\\x00]"


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box rows of CSV files with this header; negative corners count as 0; a malformed row fails the job."""
    d = spark.read.schema(BOXES).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return d.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in "xywh"})


def read_boxes_by_name(spark: SparkSession, path: str, optional: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Box rows of CSV files whose columns come in any order, with other columns left out.

    ``optional`` string columns (such as vehicle_id) are null where a file hasn't got them. A header that misses or repeats
    a column fails, and with ``strict`` so does a null, unsafe or repeated id, a number that is no 32-bit integer, an empty
    size or a table without rows. Ids stay strings.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    header = [c.strip().lstrip("\ufeff") for c in spark.read.text(path).first()[0].split(",")] if raw.columns else []
    twice = sorted({c for c in header if header.count(c) > 1})
    missing = sorted({"image_id", *"xywh"} - set(header))
    if twice or missing:
        raise ValueError(f"columns repeated: {twice}, missing: {missing}")
    number = {c: F.col(c).try_cast("int") for c in "xywh"}
    d = raw.select("image_id", *[number[c].alias(c) for c in "xywh"], *[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in optional])
    if strict:
        bad = box_problems(d).limit(3).collect()
        if bad or d.isEmpty():
            raise ValueError(f"bad rows: {[tuple(r) for r in bad]}" if bad else "no rows")
    return d


def read_truth(spark: SparkSession, path: str, required: tuple[str, ...] = ("image_id", "vehicle_id", "camera_id")) -> DataFrame:
    """Ground-truth rows as strings; a missing column fails."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in required if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return d.select(*required)


def parse_train_list(lines: DataFrame) -> DataFrame:
    """(path, identity, camera, label) of list lines ``path identity camera label`` parted by blanks, commas or semicolons.

    A header (whose label is no number) and blank lines are left out; paths lose "./" and back slashes. Fails if a path
    comes twice, if labels aren't 0 .. n - 1 or if labels and identities don't match one to one.
    """
    f = F.split(F.trim(F.regexp_replace("line", "\ufeff", "")), r"[\s,;]+")
    d = lines.select(f.alias("f")).where(F.size("f") >= 4).select(F.regexp_replace(F.regexp_replace(F.col("f")[0], r"\\", "/"), r"^(\./)+", "").alias("path"), F.col("f")[1].alias("identity"), F.col("f")[2].alias("camera"), F.col("f")[3].try_cast("long").alias("label"))
    d = d.where("label IS NOT NULL")
    n = d.agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.countDistinct("label").alias("labels"), F.countDistinct("identity").alias("ids"), F.countDistinct("label", "identity").alias("pairs"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if n["n"] and (n["paths"] < n["n"] or n["low"] != 0 or n["high"] != n["labels"] - 1 or not n["labels"] == n["ids"] == n["pairs"]):
        raise ValueError(f"inconsistent list: {n.asDict()}")
    return d


def union_lists(parts: dict[str, DataFrame]) -> DataFrame:
    """Lists under one numbering: identities get their list's name in front, a path in two lists fails, labels go by identity.

    Identities are numbered over their distinct values only.
    """
    d = None
    for name, part in parts.items():
        one = part.select("path", F.concat(F.lit(f"{name}:"), "identity").alias("identity"), "camera")
        d = one if d is None else d.unionByName(one)
    clash = d.groupBy("path").count().where("count > 1").limit(3).collect()
    if clash:
        raise ValueError(f"paths in two lists: {[r['path'] for r in clash]}")
    number = ordered.numbered(d.select("identity").distinct(), [F.col("identity")], "label")
    return d.join(number, "identity").select("path", "identity", "camera", "label")


def box_problems(boxes: DataFrame) -> DataFrame:
    """Ids with what is wrong: null or unsafe id, missing number, empty size, id seen more than once."""
    bad = (
        F.when(F.col("image_id").isNull() | F.col("image_id").rlike(UNSAFE_ID), "unsafe_id")
        .when(F.greatest(*[F.col(c).isNull().cast("int") for c in "xywh"]) == 1, "missing").when((F.col("w") <= 0) | (F.col("h") <= 0), "empty")
    )
    twice = boxes.groupBy("image_id").count().where("count > 1 AND image_id IS NOT NULL").select("image_id", F.lit("repeated").alias("problem"))
    return boxes.select("image_id", bad.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` and ``line`` of one text file; numbers rise in file order, with gaps."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    return d.select(F.struct("at", "id").alias("line_no"), "line")


def parse_submission(lines: DataFrame, query_ids: DataFrame, gallery_ids: DataFrame) -> DataFrame:
    """Ranked pairs of headerless lines (query, then gallery ids).

    Byte-order marks and blanks are stripped, unknown ids dropped; of a repeated query the last line counts, of a repeated id
    the first place. Null and empty lines give nothing. The ranks are renumbered from 1.
    """
    ids = F.transform(F.split(F.regexp_replace("line", "\ufeff", ""), ","), lambda x: F.trim(x))
    d = lines.select("line_no", ids.alias("ids")).select("line_no", F.col("ids")[0].alias("query_id"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))).alias("ids"))
    d = d.join(query_ids.select(F.col("image_id").alias("query_id")).distinct(), "query_id", "left_semi")
    d = d.groupBy("query_id").agg(F.max_by("ids", "line_no").alias("ids")).select("query_id", F.posexplode("ids").alias("at", "gallery_id"))
    d = d.join(gallery_ids.select(F.col("image_id").alias("gallery_id")).distinct(), "gallery_id", "left_semi")
    d = d.groupBy("query_id", "gallery_id").agg(F.min("at").alias("at"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long")).drop("at")


def parse_candidates(rows: DataFrame) -> DataFrame:
    """Candidate rows without null or blank gallery ids, ranked by confidence per query; ties by id."""
    d = rows.where(F.length(F.trim("gallery_id")) > 0)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("confidence"), "gallery_id")).cast("long"))


def write_submission(ranked: DataFrame, path: str) -> None:
    """One line per query: its id, then gallery ids by rank. Fails if the folder exists."""
    d = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "gallery_id"))).alias("r"))
    d.select(F.concat_ws(",", "query_id", F.transform("r", lambda x: x["gallery_id"])).alias("value")).write.mode("errorifexists").text(path)


def import_boxes(spark: SparkSession, folder: str, target: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Append the usable rows of new CSV files in ``folder`` to the Parquet table ``target``, each file once.

    Progress is kept in ``checkpoint`` (a shared folder), so a stopped import goes on where it was. Rows with a null or unsafe id or an
    empty box are left out. Stops when all present files are read.
    """
    new = spark.readStream.schema(BOXES).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)
    usable = new.where(~F.col("image_id").rlike(UNSAFE_ID) & (F.col("w") > 0) & (F.col("h") > 0)).withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in "xy"})
    return usable.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
