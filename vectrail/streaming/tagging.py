"""Tagging as a stream: items that arrive as files get their tags from a back end and replace the item's tag set.

The queue is a folder; progress is kept in a checkpoint, so a stopped run goes on where it was and no item is lost or tagged
twice. A back end that fails on an item is noted in the item's ``error`` and the item gets no tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ITEM = "item_id long, crop binary"
TAGGED = "item_id long, tags array<struct<tag: string, confidence: double>>, error string"
Backend = Callable[[bytes], list[tuple[str, float]]]


def no_tags(crop: bytes) -> list[tuple[str, float]]:
    """The back end without a model: no tags for anything."""
    return []


def tag_items(items: DataFrame, backend: Backend = no_tags) -> DataFrame:
    """(item_id, tags, error) of items (item_id, crop), in Arrow batches. A null crop has no tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for crop in batch.column(1).to_pylist():
                try:
                    out.append(([{"tag": t, "confidence": c} for t, c in backend(crop)] if crop is not None else [], None))
                except Exception as e:  # one item's failure must not stop the queue
                    out.append(([], f"{type(e).__name__}: {e}"))
            kind = pa.list_(pa.struct([("tag", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], kind), pa.array([e for _, e in out], pa.string())], names=["item_id", "tags", "error"])

    return items.select("item_id", "crop").mapInArrow(run, TAGGED)


def tag_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, backend: Backend = no_tags, files_at_once: int = 1000) -> StreamingQuery:
    """Tag the items of new Parquet files in ``folder`` and append them to ``target`` by batch; stops when all are done.

    A batch that runs again overwrites its own part of the target, so results count once.
    """

    def put(batch: DataFrame, number: int) -> None:
        tag_items(batch, backend).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    new = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_tags(tagged: DataFrame) -> DataFrame:
    """(item_id, tag, confidence): each item's tags by its last batch; an item without tags has no rows."""
    last = tagged.groupBy("item_id").agg(F.max_by("tags", "batch").alias("tags"))
    return last.select("item_id", F.explode("tags").alias("t")).select("item_id", "t.tag", "t.confidence")
