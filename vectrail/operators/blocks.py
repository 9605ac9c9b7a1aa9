"""Blocks of queries against all blocks of a gallery, neither of which is shuffled pair by pair.

The gallery is written once, a row of it being a block: positions, vectors and other columns of many rows. Queries are dealt to
partitions of one block each. Spark's cartesian product reads the written gallery, in ``segments`` pieces, again for each block
of queries; a task folds its piece block by block into what it keeps of its queries, so it holds a block of either side and the
kept rows. What is written and shuffled grows with the rows (times ``segments`` for the results), not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from vectrail.sources.shared import stored

#: Rows of a block; pieces of the gallery per core where few blocks of queries would leave cores idle.
BLOCK, WAVES = 4096, 8
#: Rows of queries that are scored at once; pairs whose exact score is summed at once.
STEP, PAIRS = 512, 2048
#: No position.
NONE = np.iinfo(np.int64).max

Solve = Callable[[list[np.ndarray], Iterator[list[np.ndarray]]], Iterator[list[np.ndarray]]]


def _pack(held: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    out = []
    for name in names:
        values = table.column(name).combine_chunks()
        if name == "v":
            if len(pa.compute.unique(pa.compute.list_value_length(values))) != 1:
                raise ValueError("vectors of unequal lengths")
            out.append(pa.array([values.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()))
        else:
            out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(out, names=names)


def packed(rows: DataFrame, size: int | None) -> DataFrame:
    """Blocks of at most ``size`` rows of a partition, or of a whole partition: ``v`` as bytes, every other column as an array."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n) if size else batch
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield _pack(held, names)
                    held, n = [], 0
        if n:
            yield _pack(held, names)

    return rows.mapInArrow(run, StructType([StructField(f.name, BinaryType() if f.name == "v" else ArrayType(f.dataType)) for f in rows.schema]))


def kind(rows: DataFrame) -> str:
    """The numbers of ``v``: f4 or f8."""
    return {"array<float>": "<f4", "array<double>": "<f8"}[dict(rows.dtypes)["v"]]


def _block(batch: pa.RecordBatch, row: int, first: int, names: list[str], number: str) -> list[np.ndarray]:
    out = []
    for i, name in enumerate(names, first):
        value = batch.column(i)[row]
        plain = hasattr(value, "values") and not pa.types.is_nested(value.values.type)
        out.append(np.frombuffer(value.as_buffer(), number) if name == "v" else value.values.to_numpy(zero_copy_only=False) if plain else value)
    at = names.index("v") if "v" in names else None
    if at is not None:
        out[at] = out[at].reshape(len(out[names.index("pos")]), -1)
    return out


def kept_blocks(gallery: DataFrame, pieces: int) -> DataFrame:
    """The gallery's blocks, written and read back."""
    return stored(packed(gallery, BLOCK).repartition(pieces), "blocks")


def pieces(gallery: DataFrame, blocks: int) -> int:
    """Pieces of the gallery for so many blocks of queries: some tasks per core, however many blocks there are."""
    cores = gallery.sparkSession.sparkContext.defaultParallelism
    return -(-WAVES * cores // min(blocks, cores))


def against(queries: DataFrame, gallery: DataFrame, solve: Solve, schema: str, size: int = BLOCK, whole: bool = False, condition: Column | None = None, number: str | None = None, rows: int | None = None) -> DataFrame:
    """What ``solve(queries' columns, blocks of the gallery's columns)`` yields for blocks of ``size`` queries and pieces of the gallery.

    Both sides have pos, v (an array) and others; ``v`` comes as a matrix. ``whole``: a task reads the whole gallery. ``number``: the
    gallery consists of blocks already, with vectors of this kind. ``condition`` on blocks of both sides (query columns begin with
    ``q_``) leaves out pairs of blocks. ``rows`` is the number of queries, which are counted where it isn't given.
    """
    blocks = max(1, -(-(queries.count() if rows is None else rows) // size))
    n = 1 if whole else pieces(gallery, blocks)
    names, own, of_q = gallery.columns, queries.columns, kind(queries)
    of_g = number or kind(gallery)
    g = (gallery if number else kept_blocks(gallery, pieces(gallery, 1))).coalesce(n)
    q = packed(queries.repartition(blocks), None).toDF(*[f"q_{c}" for c in own])
    g = g.hint("shuffle_replicate_nl")
    both = g.crossJoin(q) if condition is None else g.join(q, condition)
    # a task has one block of queries, which only its first row takes along to Python
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    both = both.select(*names, *[F.when(first, F.col(c)).alias(c) for c in q.columns])
    out = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        left = [x.copy() if isinstance(x, np.ndarray) else x for x in _block(first, 0, len(names), own, of_q)]

        def rights(batch: pa.RecordBatch | None) -> Iterator[list[np.ndarray]]:
            while batch is not None:
                for row in range(batch.num_rows):
                    yield _block(batch, row, 0, names, of_g)
                batch = next(batches, None)

        for found in solve(left, rights(first)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=out)

    return both.mapInArrow(run, schema)


def dots(q: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of pairs (i, j), summed from the first dimension to the last in the vectors' precision."""
    out = np.zeros(len(i), np.result_type(q, rows))
    for at in range(0, len(i), PAIRS):
        a, b = q[i[at : at + PAIRS]].T, rows[j[at : at + PAIRS]].T
        total = out[at : at + PAIRS]
        for x, y in zip(a, b, strict=True):
            total += x * y
    return out


class Best:
    """The k best gallery rows of n queries so far: by score, ties by position."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.pos = k, np.full((n, k), -np.inf), np.full((n, k), NONE)

    def least(self, at: slice) -> np.ndarray:
        """Scores below these don't enter; -inf where k rows aren't there yet."""
        last = self.score[at, -1]
        return np.where(np.isnan(last) | (self.pos[at, -1] == NONE), -np.inf, last)

    def add(self, row: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        own, k = np.unique(row), self.k
        rows, poss = np.concatenate((np.repeat(own, k), row)), np.concatenate((self.pos[own].ravel(), pos))
        scores = np.concatenate((self.score[own].ravel(), score))
        order = np.lexsort((poss, -scores, poss == NONE, rows))
        rows = rows[order]
        start = np.searchsorted(rows, own)
        pick = order[(start[:, None] + np.arange(k)).ravel()]
        self.pos[own], self.score[own] = poss[pick].reshape(-1, k), scores[pick].reshape(-1, k)

    def rows(self, pos: np.ndarray) -> list[np.ndarray]:
        """(query's position, gallery row's, score)."""
        i, j = np.nonzero(self.pos != NONE)
        return [pos[i], self.pos[i, j], self.score[i, j]]


def _length(v: np.ndarray) -> np.ndarray:
    x = np.sqrt(np.sum(np.square(v, dtype=float), axis=1))
    return np.where(np.isfinite(x), x, 0.0)


def hits(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a matrix that hold, as nonzero gives them; quicker where few rows have any."""
    some = np.flatnonzero(there.any(axis=1))
    i, j = np.nonzero(there[some])
    return some[i], j


def room(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What products in single precision of each query with any row, and their sums in any order, can be off: two sums of d products differ by at most 2 d 2**-24 times both lengths."""
    return 1.01 * (2 * q.shape[1] + 16) * 2.0**-24 * _length(q) * _length(rows).max(initial=0.0) + 1e-36


def add_best(best: Best, q: np.ndarray, pos: np.ndarray, rows: np.ndarray) -> None:
    """Adds a block of the gallery to what is best.

    Products in single precision leave out pairs that can't enter. The others are summed from the first dimension to the last, so
    equal vectors have equal scores.
    """
    with np.errstate(all="ignore"):
        single, k = rows.astype(np.float32).T, best.k
        spare = room(q, rows)
        for i in range(0, len(q), STEP):
            at = slice(i, i + STEP)
            near = q[at].astype(np.float32) @ single
            odd = ~np.isfinite(near)
            least = best.least(at)
            if np.isneginf(least).any() and near.shape[1] > k:
                known = np.where(odd, -np.inf, near) if odd.any() else near
                least = np.maximum(least, np.partition(known, near.shape[1] - k, axis=1)[:, near.shape[1] - k].astype(float) - spare[at])
            least = np.nextafter((least - spare[at]).astype(np.float32), np.float32(-np.inf))
            a, b = hits((near >= least[:, None]) | odd)
            if len(a):
                best.add(a + i, pos[b], dots(q[at], rows, a, b).astype(float))
