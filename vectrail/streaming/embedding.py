"""Embedding of crops by a model that is plugged in, and a reindex that resumes where it stopped.

A worker loads a model once and keeps it for all its tasks. Crops go through in batches; if a batch fails its items are tried
one by one, so that a bad crop costs its own row and no other. A reindex queues the stale items as files, embeds them as a
stream and commits each micro-batch to the gallery's store under a name of its own: a batch that was committed before it was
noted as done is recognised when the stream runs again, and nothing is embedded into the gallery twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.operators import catalogue
from vectrail.sources.versioned import Store

Model = Callable[[Sequence[bytes]], Sequence[Sequence[float]]]
EMBEDDED = "pos long, embedding array<float>, error string"
QUEUED = "pos long, crop binary"
#: Crops of a batch.
BATCH = 32

#: Models that this worker has loaded, by name.
_loaded: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The model of that name, loaded on first use in this process."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _embedded(model: Model, crops: Sequence[bytes]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, error) of each crop."""
    try:
        found = [[float(x) for x in v] for v in model(crops)]
        if len(found) != len(crops):
            raise ValueError(f"{len(found)} vectors for {len(crops)} crops")
        return [(v, None) for v in found]
    except Exception as e:  # a model may fail in any way; the batch's other items must not
        if len(crops) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [x for crop in crops for x in _embedded(model, [crop])]


def embed(items: DataFrame, name: str, load: Callable[[], Model], batch: int = BATCH) -> DataFrame:
    """(pos, embedding, error) of items (pos, crop). A null crop is an error; ``name`` tells models apart, such as by version."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in parts:
            crops = part.column(1).to_pylist()
            there = [i for i, c in enumerate(crops) if c is not None]
            out: list[tuple[list[float] | None, str | None]] = [(None, "no crop")] * len(crops)
            for k in range(0, len(there), batch):
                model = model or loaded(name, load)
                some = there[k : k + batch]
                for i, x in zip(some, _embedded(model, [crops[i] for i in some]), strict=True):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([e for _, e in out], pa.string())], names=["pos", "embedding", "error"])

    return items.select("pos", "crop").mapInArrow(run, EMBEDDED)


def queue_stale(store: Store, crops: DataFrame, version: str, folder: str, only: str | None = None, files: int = 8) -> int:
    """Write the items that another model than ``version`` (or just ``only``) has embedded, with their crops (pos, crop), as files below ``folder``.

    Returns how many. An existing folder is left as it is: its reindex goes on.
    """
    spark = store.spark
    path = store._at(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stale = store.read("items").where((F.col("model_version") != version) if only is None else (F.col("model_version") == only) & (F.col("model_version") != version))
        stale.select("pos").join(crops, "pos", "left").select("pos", "crop").repartition(files).write.parquet(folder)
    return spark.read.parquet(folder).count()


def reindex(store: Store, folder: str, checkpoint: str, version: str, load: Callable[[], Model], files_at_once: int = 1, batch: int = BATCH) -> StreamingQuery:
    """Embed the queued items and commit their vectors, with the model's version, batch by batch; stops when all are done.

    Failed items keep their old vector and version, so they stay stale; ``failures`` lists them.
    """

    def put(part: DataFrame, number: int) -> None:
        name = f"{folder}:{number}"
        if name in dict(map(tuple, store.manifest()["names"])):
            return
        done = embed(part, version, load, batch)
        done.write.mode("overwrite").parquet(f"{folder}-embedded/batch={number}")
        done = part.sparkSession.read.schema(EMBEDDED).parquet(f"{folder}-embedded/batch={number}")
        catalogue.update_vectors(store, done.where("error IS NULL"), version, name)

    new = store.spark.readStream.schema(QUEUED).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, error) of the items that a reindex could not embed."""
    return spark.read.schema(f"{EMBEDDED}, batch int").parquet(f"{folder}-embedded").where("error IS NOT NULL").select("pos", "error")
