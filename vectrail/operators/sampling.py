"""Training samplers by hash order, exclusions, coverage and synthetic vectors.

Draws are ranks of MD5 values over (seed, batch, ...), so they need no state and come out the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lot(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def identity_batches(rows: DataFrame, identities: int, per_identity: int, batches: int, seed: int = 7) -> DataFrame:
    """(batch, vehicle_id, slot, pos): every batch draws distinct identities and rows of each: one of every camera first, then
    others, then the same ones again where an identity has too few.

    ``rows``: pos, vehicle_id, camera_id. Batches meet distinct identities, and only the drawn ones meet their rows. Fewer
    than two identities in a batch or in all fail.
    """
    if identities < 2 or per_identity < 2:
        raise ValueError("a batch needs two identities with two rows each at least")
    batch, who = F.col("batch"), F.col("vehicle_id").cast("string")
    ids = rows.select("vehicle_id").distinct()
    by = Window.partitionBy("batch").orderBy(_lot(seed, batch, who), "vehicle_id")
    drawn = ids.select("vehicle_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))
    drawn = drawn.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= identities).drop("_k")
    d = drawn.join(rows, "vehicle_id").withColumn("_h", _lot(seed, batch, "row", F.col("pos").cast("string"))).withColumn("_c", _lot(seed, batch, who, F.col("camera_id").cast("string")))
    group = ["batch", "vehicle_id"]
    d = d.withColumn("_again", F.row_number().over(Window.partitionBy(*group, "camera_id").orderBy("_h", "pos")) > 1)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("_again", F.when(F.col("_again"), F.col("_h")).otherwise(F.col("_c")), "pos")))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*group))).where(F.col("_k") <= per_identity)
    slots = F.sequence((F.col("_k") - 1).cast("long"), F.lit(per_identity - 1).cast("long"), F.col("_n"))
    return d.select("batch", "vehicle_id", F.explode(slots).alias("slot"), "pos")


def balanced(drawn: DataFrame, rows: DataFrame, seed: int = 7) -> DataFrame:
    """``drawn`` (4 rows an identity) with camera_id, where blocks of 3 + 1 rows of two cameras become 2 + 2.

    Eligible are identities with just two cameras of two rows each at least. One row of the camera that has three, by hash,
    gives way to one of the other camera that is not in the block.
    """
    cams = rows.groupBy("vehicle_id", "camera_id").agg(F.count("*").alias("n")).groupBy("vehicle_id").agg(F.count("*").alias("cams"), F.min("n").alias("least"))
    fit = cams.where("cams = 2 AND least >= 2").select("vehicle_id", F.lit(True).alias("_fit"))
    group = Window.partitionBy("batch", "vehicle_id")
    d = drawn.join(rows.select("pos", "camera_id"), "pos").join(fit, "vehicle_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("batch", "vehicle_id", "camera_id")))
    d = d.withColumn("_off", F.max("_n").over(group) == 3).withColumn("_go", F.coalesce("_fit", F.lit(False)) & F.col("_off") & (F.col("_n") == 3))
    lot = F.when(F.col("_go"), _lot(seed, F.col("batch"), "out", F.col("slot")))
    d = d.withColumn("_out", F.col("_go") & (F.row_number().over(group.orderBy(F.asc_nulls_last(lot), "slot")) == 1))
    few = d.where("_off AND _fit AND _n = 1").select("batch", "vehicle_id", F.col("pos").alias("_own"), F.col("camera_id").alias("_cam"))
    new = few.join(rows.select("vehicle_id", F.col("camera_id").alias("_cam"), F.col("pos").alias("_pos")), ["vehicle_id", "_cam"]).where("_pos <> _own")
    new = new.groupBy("batch", "vehicle_id").agg(F.min(F.struct(_lot(seed, F.col("batch"), "in", F.col("_pos")), "_pos", "_cam")).alias("_x"))
    d = d.join(new, ["batch", "vehicle_id"], "left")
    return d.select("batch", "vehicle_id", "slot", F.when(F.col("_out"), F.col("_x._pos")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("_out"), F.col("_x._cam")).otherwise(F.col("camera_id")).alias("camera_id"))


def coverage(drawn: DataFrame, epoch: str) -> DataFrame:
    """(epoch, rows, identities): how many have been drawn by the end of each epoch; sums run over epochs only."""
    first = drawn.groupBy("pos", "vehicle_id").agg(F.min(epoch).alias("e"))
    rows = first.groupBy("e").agg(F.count("*").alias("rows"))
    ids = first.groupBy("vehicle_id").agg(F.min("e").alias("e")).groupBy("e").agg(F.count("*").alias("identities"))
    up = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    d = drawn.select(F.col(epoch).alias("epoch")).distinct().join(rows, F.col("epoch") == rows["e"], "left").join(ids, F.col("epoch") == ids["e"], "left")
    return d.select("epoch", *[F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in ("rows", "identities")])


def excluded(rows: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without those that ``names`` gives by all columns of ``key``; each name must match exactly one row."""
    n = names.join(rows.groupBy(*key).agg(F.count("*").alias("_n")), key, "left").where("_n IS NULL OR _n <> 1").limit(1).collect()
    if n:
        raise ValueError(f"not exactly one row: {n[0].asDict()}")
    return rows.join(names, key, "left_anti")


def clustered(spark: SparkSession, n: int, dim: int, centres: int, noise: float, seed: int = 1) -> DataFrame:
    """(pos, owner, embedding): unit vectors around random centres, row i at centre i mod n; each row by its own seed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.random.default_rng(seed).normal(size=(centres, dim))
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
        for batch in batches:
            pos = batch.column(0).to_numpy()
            rows = middle[pos % centres] + noise / np.sqrt(dim) * np.stack([np.random.default_rng([seed, p]).normal(size=dim) for p in pos.tolist()]) if len(pos) else np.zeros((0, dim))
            rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(pos % centres), pa.array(list(rows), pa.list_(pa.float64()))], names=["pos", "owner", "embedding"])

    return spark.range(n).withColumnRenamed("id", "pos").mapInArrow(make, "pos long, owner long, embedding array<double>")
