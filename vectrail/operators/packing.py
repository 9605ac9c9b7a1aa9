"""Batches of frames in order, each filled until the next frame would be one too many or too large.

Where a batch ends depends on where it began, so a plain loop passes its state from frame to frame. Here rows are numbered in
order and cut into segments. From any frame at which a batch begins its end is fixed, and it lies at most ``most`` frames
ahead. So a segment is a function: for each of the ``most`` places at which the first batch to begin in it can begin, where the
first batch beyond it begins and how many begin within. Segments compute their functions apart, one pass over these small tables composes
them in order, and each segment then knows its own entry and marks its batches. Only ``most`` numbers a segment meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.operators import ordered
from vectrail.sources.shared import stored

#: Frames and bytes of a batch; bytes of a frame; frames of a segment.
FRAMES, BATCH_BYTES, FRAME_BYTES, SEGMENT = 64, 3 << 20, 3 << 20, 100_000


def _follow(sizes: np.ndarray, frames: int, most: int) -> np.ndarray:
    """For each frame, where the batch that begins there ends: the first frame that isn't in it."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    end = np.searchsorted(total, total[:-1] + most, side="right") - 1
    at = np.arange(len(sizes))
    return np.clip(end, at + 1, at + frames)  # a frame alone is a batch whatever its size


def _segment(table: pa.Table, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, sizes in order with those looked ahead at, how many frames are the segment's own)."""
    n, size = table.column("n").to_numpy(), table.column("size").to_numpy()
    by = np.argsort(n)
    return n[by], size[by], int((n // segment == table.column("segment")[0].as_py()).sum())


def packed(frames: DataFrame, order: list[Column], size: Column, most_frames: int = FRAMES, most_bytes: int = BATCH_BYTES, largest: int = FRAME_BYTES, segment: int = SEGMENT) -> DataFrame:
    """``frames`` with ``batch`` (from 0), ``place`` (from 0 within it) and ``refused``.

    Frames go into batches in ``order``, which must tell all apart. One of more than ``largest`` bytes, or of unknown size, is
    refused: its batch and place are null and it doesn't count. A batch ends before a frame that would be its ``most_frames`` + 1st
    or bring it over ``most_bytes``.
    """
    if most_frames < 1 or segment < most_frames:
        raise ValueError("a segment holds at least one batch")
    d = frames.withColumn("_size", size.cast("long"))
    fits = F.coalesce(F.col("_size") <= largest, F.lit(False))
    d = stored(ordered.running(d.withColumn("_fits", fits), order, {"_n": F.col("_fits").cast("long")}).withColumn("_n", F.when(F.col("_fits"), F.col("_n") - 1)), "frames")
    own = F.expr(f"_n DIV {segment}")
    # a segment also sees the first frames of the next one, in which its last batches end
    ahead = F.when((F.col("_n") % segment < most_frames) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = d.where("_fits").select(F.col("_n").alias("n"), F.col("_size").alias("size"), F.explode(ahead).alias("segment"))

    def function(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, sizes, mine = _segment(table, segment)
        follow = _follow(sizes, most_frames, most_bytes)
        leaves, begun = np.arange(len(sizes) + most_frames) - mine, np.zeros(len(sizes) + most_frames, np.int64)
        for i in range(mine - 1, -1, -1):
            leaves[i], begun[i] = leaves[follow[i]], begun[follow[i]] + 1
        k = min(most_frames, mine)
        # an entry beyond a short last segment begins nothing
        pad = np.zeros(most_frames - k, np.int64)
        return pa.table({"segment": pa.array([key[0].as_py()]), "leaves": pa.array([[*leaves[:k].tolist(), *pad.tolist()]], pa.list_(pa.int64())), "begun": pa.array([[*begun[:k].tolist(), *pad.tolist()]], pa.list_(pa.int64()))})

    functions = dealt.groupBy("segment").applyInArrow(function, "segment long, leaves array<long>, begun array<long>")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, batch = 0, 0
        for part in batches:
            out = []
            for s, leaves, begun in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out.append((s, entry, batch))
                entry, batch = leaves[entry], batch + begun[entry]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["segment", "entry", "first"])

    entries = functions.coalesce(1).sortWithinPartitions("segment").mapInArrow(compose, "segment long, entry long, first long")

    def mark(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, sizes, mine = _segment(table, segment)
        entry, batch = table.column("entry")[0].as_py(), table.column("first")[0].as_py()
        follow = _follow(sizes, most_frames, most_bytes)
        begins, i = [], entry
        while i < mine:
            begins.append(i)
            i = int(follow[i])
        of = np.searchsorted(begins, np.arange(len(sizes)), side="right") - 1
        keep = (of >= 0) & (np.arange(len(sizes)) < (i if begins else 0))
        of = of[keep]
        start = np.array(begins, np.int64)[of] if begins else np.zeros(0, np.int64)
        return pa.table({"_at": pa.array(n[keep]), "batch": pa.array(batch + of), "place": pa.array(np.arange(len(sizes))[keep] - start)})

    marked = dealt.join(F.broadcast(entries), "segment").groupBy("segment").applyInArrow(mark, "_at long, batch long, place long")
    return d.join(marked, F.col("_n") == F.col("_at"), "left").withColumn("refused", ~F.col("_fits")).drop("_size", "_fits", "_n", "_at")
