"""Which anchors of a document occur elsewhere: count-min sketches merged by hash range.

Every batch of documents sketches its anchors. The sketch travels in pieces by hash range;
a range's task merges the pieces of all batches by saturating addition, so that a cell is
never less than the count of any anchor it stands for, and tells each batch which of its
anchors may occur twice. No sketch is broadcast or collected, so there is no bound on the
corpus, and a cell range has ``CELLS`` cells per anchor it gets, whatever the size.

An anchor that occurs several times in a batch is known to be repeated there and sent on
once, so an anchor that is everywhere costs its range one entry per batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.packing import mix, pack, unpack

#: Cells per anchor, rows of the sketch, characters of text that a hash range stands for.
CELLS, ROWS, RANGE_CHARS, LEAST_RANGES = 4, 2, 32 << 20, 12
#: Documents of a batch.
BATCH = 2000

#: Finds the anchors of a text: their hashes in order of position.
Finder = Callable[[bytes], np.ndarray]


#: Places in documents on their way back: ``keys`` names the documents of a packed row.
MARKS = "batch long, keys binary, data binary"


def marks(batch: int, keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """At most one packed row: places ``at`` in the documents ``doc`` (indices of ``keys``)."""
    if not len(doc):
        return []
    by = np.lexsort((at, doc))
    own, local = np.unique(doc[by], return_inverse=True)
    return [(batch, keys[own].astype("<i8").tobytes(), pack(local, at[by]))]


def batch_ids() -> Iterator[int]:
    """Numbers that no other batch of the stage has."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def mark_rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["batch", "keys", "data"])


def packed_rows(batch: pa.RecordBatch, keep: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(batch, keys, data) of some rows."""
    part = batch.filter(pa.array(keep))
    return list(zip(*[part.column(c).to_pylist() for c in ("batch", "keys", "data")], strict=True))


def range_or_batch(ranges: int) -> Column:
    """The task of a row: that of its hash range, or one by batch for finished marks (-1)."""
    return F.when(F.col("range") >= 0, F.col("range")).otherwise(F.pmod("batch", F.lit(ranges)).cast("int")).alias("by")


def _by_key(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a batch."""
    keys, places = [], []
    for part in stream:
        for names, data in zip(part.column("keys").to_pylist(), part.column("data").to_pylist(), strict=True):
            local, at = unpack(data)
            keys.append(np.frombuffer(names, "<i8")[local.astype(np.int64)])
            places.append(at.astype("<i4"))
    key, at = np.concatenate(keys), np.concatenate(places)
    by = np.argsort(key, kind="stable")
    key, at = key[by], at[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array([p.tobytes() for p in np.split(at, first[1:])], pa.binary())], names=["key", "at"])


def by_document(packed: DataFrame, column: str) -> DataFrame:
    """(key, ``column``) of packed rows (MARKS): per document an array of pieces.

    A piece holds little-endian 32-bit places. Rows go back to the batch that they came
    from before they are unpacked, so there are as many rows as documents and not one for
    each document and hash range.
    """
    found = packed.select("batch", "keys", "data").groupBy("batch").applyInArrow(_by_key, "key long, at binary")
    return found.groupBy("key").agg(F.collect_list("at").alias(column))


def repeated_anchors(docs: DataFrame, finder: Callable[[], Finder]) -> DataFrame:
    """(key, flagged) of ``docs`` (key, text): ordinals of anchors that may occur twice.

    ``flagged`` is an array of pieces, little-endian 32-bit ordinals each. Nothing that
    occurs twice is missing; an anchor whose cells others share may be there too.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_CHARS))

    def sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids = finder(), batch_ids()
        for whole in stream:
            for i in range(0, whole.num_rows, BATCH):
                yield piece_of(whole.slice(i, BATCH), next(ids), find)

    def piece_of(batch: pa.RecordBatch, number: int, find: Finder) -> pa.RecordBatch:
        keys = batch.column(0).to_numpy()
        parts = [find(t) for t in batch.column(1).to_pylist()]
        n = np.array([len(p) for p in parts], np.int64)
        h = mix(np.concatenate(parts), 11)
        doc, ordinal = np.repeat(np.arange(len(n)), n), np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        # the same document twice in a batch is one
        _, same = np.unique(keys, return_index=True)
        once = np.isin(doc, same)
        h, doc, ordinal = h[once], doc[once], ordinal[once]
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        often = times[back] > 1
        rows = [(-1, *row) for row in marks(number, keys, doc[often], ordinal[often])]
        first = np.zeros(len(h), bool)
        first[np.unique(h, return_index=True)[1]] = True
        at = (h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)
        at[~first] = ranges
        by = np.lexsort((doc, at))
        cuts = np.searchsorted(at[by], np.arange(ranges + 1))
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                i = by[a:b]
                own, local = np.unique(doc[i], return_inverse=True)
                data = pack(local, h[i] & np.uint64((1 << 48) - 1), ordinal[i] * 2 + often[i])
                rows.append((r, number, keys[own].astype("<i8").tobytes(), data))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], names=["range", "batch", "keys", "data"])

    def merge(_: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in stream:
            own = batch.column("range").to_numpy() < 0
            yield mark_rows(packed_rows(batch, own))
            parts += packed_rows(batch, ~own)
        entries = sum(len(unpack(d)[0]) for _, _, d in parts)
        cells = 1 << max(10, (CELLS * entries).bit_length())
        total = np.zeros((ROWS, cells), np.uint8)
        place = lambda h, row: (mix(h, 30 + row) >> np.uint64(8)) & np.uint64(cells - 1)
        for _, _, data in parts:
            _, h, about = unpack(data)
            for row in range(ROWS):
                own = np.zeros(cells, np.uint8) if len(h) * 16 > cells else None
                c = place(h, row)
                weight = 1 + (about & np.uint64(1)).astype(np.uint8)
                if own is None:
                    c, back = np.unique(c, return_inverse=True)
                    total[row, c] = np.minimum(total[row, c] + np.minimum(np.bincount(back, weight), 2).astype(np.uint8), 2)
                else:
                    own += np.minimum(np.bincount(c.astype(np.int64), weight, cells), 2).astype(np.uint8)
                    total[row] = np.minimum(total[row] + own, 2)
        for number, keys, data in parts:
            doc, h, about = unpack(data)
            likely = np.all([total[row, place(h, row)] >= 2 for row in range(ROWS)], axis=0) & (about & np.uint64(1) == 0)
            yield mark_rows(marks(number, np.frombuffer(keys, "<i8"), doc[likely].astype(np.int64), (about[likely] >> np.uint64(1)).astype(np.int64)))

    rows = docs.select("key", "text").mapInArrow(sketch, f"range int, {MARKS}")
    return by_document(rows.groupBy(range_or_batch(ranges)).applyInArrow(merge, MARKS), "flagged")


def ordinals(flagged: list[bytes]) -> np.ndarray:
    """The distinct ordinals of all pieces, sorted."""
    return np.unique(np.frombuffer(b"".join(flagged), "<i4"))
