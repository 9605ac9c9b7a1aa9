"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Vectors are rounded to whole numbers, x = floor(SCALE * c) + OFFSET, and each distinct x is
fitted once. A partition keeps (n, sums, singular values, right singular vectors) of its
centred rows, all dimensions of them. To merge such states, their singular vectors scaled by
the singular values are stacked, for each a row for the difference of the means is appended,
sqrt(n1 n2 / (n1 + n2)) * (mean1 - mean2), and the stack is decomposed again: the result is the
decomposition of all rows about their common mean, and nothing is left out. Sums are whole
numbers, so means and counts are exact. A state has d * d numbers, whatever the corpus; merges
go level by level (``merge_states``), and only the last state reaches the driver.

Eigenvalues of the covariance are s * s / n. A second pass over the fit list decomposes the
whitened vectors in the same way, which gives the distance of their covariance from identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table
from vectrail.llm.merging import merge_states

#: x = floor(SCALE * c) + OFFSET; entries of at most LARGEST / SCALE have such a long.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**62
#: Components at most; singular values of under this share of the first count as zero.
COMPONENTS, ZERO = 16, 1e-11
#: Numbers of a block of rows that is decomposed at once.
BLOCK = 1 << 21


class Factors(NamedTuple):
    """The decomposition of rows about their mean: count, exact column sums, singular values, right singular vectors."""

    n: int
    sums: list[int] | np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([x / self.n for x in self.sums])


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors of a stack of rows, as many as there are."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def factors_of(rows: np.ndarray) -> Factors:
    """Of a block of rows; whole numbers are summed exactly."""
    whole = np.issubdtype(rows.dtype, np.integer)
    bound = int(np.abs(rows, dtype=float).max(initial=0)) * len(rows)
    sums = [int(x) for x in (rows if bound < 1 << 62 else rows.astype(object)).sum(axis=0)] if whole else rows.sum(axis=0)
    mean = np.array([x / len(rows) for x in sums])
    return Factors(len(rows), sums, *decompose(rows - mean))


def merged(a: Factors, b: Factors) -> Factors:
    """The factors of the rows of both about their common mean."""
    if len(a.sums) != len(b.sums):
        raise ValueError(f"vectors of {len(a.sums)} and of {len(b.sums)} dimensions")
    correction = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    sums = a.sums + b.sums if isinstance(a.sums, np.ndarray) else [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    return Factors(a.n + b.n, sums, *decompose(np.vstack((a.s[:, None] * a.vt, b.s[:, None] * b.vt, correction))))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column as a matrix; vectors of unequal lengths fail."""
    lengths = pa.compute.unique(pa.compute.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {' and of '.join(map(str, lengths.to_pylist()[:2]))} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // max(1, rows.shape[1]))
    yield from (rows[i : i + step] for i in range(0, len(rows), step))


class Whitening(NamedTuple):
    """What whitening needs: count and exact sums of x - OFFSET, directions by falling eigenvalue, and what it reached."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of y = x - OFFSET."""
        mean = np.array([s / self.n for s in self.sums])
        return (y - mean) @ (self.directions / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n * x - S) ** 2; None beyond 64 bits."""
        largest = self.n * int(np.abs(y, dtype=float).max(initial=0) + 1) + max(map(abs, self.sums), default=0)
        if largest * largest * max(1, y.shape[1]) < 1 << 63:
            d = self.n * y - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        found = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in y.tolist())
        return [x if x < 1 << 63 else None for x in found]


def rounded(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, y) of the usable rows, y = x - OFFSET.

    Rows are dropped whose vector is null or empty, or holds an entry that is null, not finite
    or so large that 64 times it is no long.
    """
    c = F.col(embedding).cast("array<double>")
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(LARGEST / SCALE)))
    y = F.transform(c, lambda x: F.floor(x * F.lit(SCALE)).cast("long"))
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding)).where((F.size(c) > 0) & ~F.coalesce(odd, F.lit(True))).select("vec_id", y.alias("y"))


def _factors(fit: DataFrame, project: Whitening | None = None) -> Factors | None:
    """The merged factors of the vectors of ``fit`` (y), or of their whitened vectors."""
    sent = fit.sparkSession.sparkContext.broadcast(project)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, number = None, 0
        for batch in batches:
            if batch.num_rows:
                number = batch.column(1)[0].as_py()
                for rows in blocks(matrix(batch.column(0))):
                    found = factors_of(rows if sent.value is None else sent.value.project(rows))
                    state = merged(state, found) if state else found
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(tuple(state))], pa.binary())], names=["part", "state"])

    def merge(states: list[bytes]) -> bytes:
        total = Factors(*pickle.loads(states[0]))
        for s in states[1:]:
            total = merged(total, Factors(*pickle.loads(s)))
        return pickle.dumps(tuple(total))

    found = merge_states(fit.select("y", F.spark_partition_id().cast("long").alias("part")).mapInArrow(of_partition, "part long, state binary"), merge)
    return Factors(*pickle.loads(found)) if found else None


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (vec_id, y); None if there are none.

    Directions of no variance are left out, so there may be fewer than ``components``. A
    direction's largest entry is positive.
    """
    fit = materialize(rows.select("y").distinct(), "fit-list")
    found = _factors(fit)
    if found is None:
        return None
    eigenvalues = found.s**2 / found.n
    keep = int((found.s > found.s[0] * ZERO).sum()) if len(found.s) else 0
    vt = found.vt[: min(keep, components)]
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    w = Whitening(found.n, list(found.sums), vt, eigenvalues[: len(vt)], float(eigenvalues.sum()))
    if not len(vt):
        return w
    reached = _factors(fit, w)
    covariance = reached.vt.T @ (reached.s[:, None] ** 2 / reached.n * reached.vt)
    return w._replace(identity_error=float(np.abs(covariance - np.eye(len(vt))).max()))


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Unusable vectors are dropped (``rounded``), vectors of unequal dimensions fail. Repeated rows
    count once in the fit and are rows each in the result; ids may be null, of any type, and
    repeat. An empty table, or vectors without variance, give no rows. A deviation
    beyond 64 bits is null. Other columns are left out, so their names don't matter.
    """
    usable = rounded(rows, vec_id, embedding)
    schema = usable.select("vec_id", F.lit(0).alias("component"), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).schema
    w = fit_whitening(usable, components)
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            if w is None or not batch.num_rows or not len(w.directions):
                continue
            at, k = 0, len(w.directions)
            for y in blocks(matrix(batch.column(1))):
                n = len(y) * k
                each = pa.array(np.repeat(np.arange(at, at + len(y)), k))
                columns = [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(n, w.n)),
                    pa.array(w.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), k))), pa.array(w.project(y).ravel()),
                    pa.array(np.tile(w.eigenvalues / w.trace, len(y))), pa.array(np.full(n, w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(y)

    return usable.mapInArrow(apply, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding; odd vectors, repeats and empty tables as in ``whiten``."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
