"""Vector matrices as array files: .npy (version 1) and raw float32 with a JSON sidecar, in parts.

A matrix is a folder of part files, one per Spark partition, each a complete array of its rows with their positions in the
file name's order. Tasks stream their rows to a file of their attempt in a ``.partial`` folder and rename it when it is whole;
the driver renames the folder when all parts are there. An existing target is refused.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY\x01\x00"
#: Bytes that are copied at once.
COPY = 8 << 20


def npy_head(rows: int, dim: int, align: int = 64) -> bytes:
    """What stands before the numbers of a float32 matrix; padded so that they start at a multiple of ``align``."""
    head = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {dim}), }}"
    pad = -(len(MAGIC) + 2 + len(head) + 1) % align
    head = head + " " * pad + "\n"
    return MAGIC + struct.pack("<H", len(head)) + head.encode()


def npy_bytes(rows: np.ndarray, align: int = 64) -> bytes:
    """A float32 matrix as .npy."""
    return npy_head(*rows.shape, align) + np.ascontiguousarray(rows, "<f4").tobytes()


def _rows_of(column: pa.Array) -> np.ndarray:
    """An array column as a matrix; rows of unequal lengths fail."""
    if len(pa.compute.unique(pa.compute.list_value_length(column))) != 1:
        raise ValueError("rows of unequal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def parse_npy(data: bytes) -> np.ndarray:
    """The matrix of .npy bytes; anything but a two-dimensional number array fails."""
    if data[:6] != MAGIC[:6]:
        raise ValueError("not an array file")
    long = data[6] > 1
    (size,) = struct.unpack_from("<I" if long else "<H", data, 8)
    start = (12 if long else 10) + size
    head = data[start - size : start].decode("latin1")
    kind = np.dtype(head.split("'descr':")[1].split("'")[1])
    shape = [int(x) for x in head.split("'shape':")[1].split("(")[1].split(")")[0].split(",") if x.strip()]
    if len(shape) != 2 or "True" in head.split("'fortran_order':")[1].split(",")[0]:
        raise ValueError(f"not a matrix by rows: {head.strip()}")
    if len(data) - start != shape[0] * shape[1] * kind.itemsize:
        raise ValueError("the array file is cut short")
    return np.frombuffer(data, kind, offset=start).reshape(shape)


def f32_bytes(rows: np.ndarray, image_ids: list[str] | None = None) -> dict[str, bytes]:
    """A matrix as raw float32 and its sidecar."""
    about = {"shape": list(rows.shape), "dtype": "float32", "byte_order": "little", "layout": "ND", "image_ids": image_ids or []}
    return {".f32": np.ascontiguousarray(rows, "<f4").tobytes(), ".json": json.dumps(about).encode()}


def write_matrix(vectors: DataFrame, target: str, kind: str = "npy", align: int = 64) -> int:
    """Write ``vectors`` (pos, embedding), in its order within each partition, as parts of ``kind`` (npy or f32); returns the rows.

    Each part's positions lie beside it as ``.ids``. Rows of unequal lengths fail.
    """
    fs, path = pa.fs.FileSystem.from_uri(target)
    if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
        raise FileExistsError(target)
    partial = f"{path}.partial"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["n"])
            return
        # a file name of its own, so that two attempts don't write into each other; the last one to end stays
        context, out = TaskContext.get(), pa.fs.FileSystem.from_uri(target)[0]
        name = f"{partial}/part-{context.partitionId():05d}"
        own = f"{partial}/_{context.partitionId():05d}-{context.taskAttemptId()}"
        out.create_dir(partial, recursive=True)
        n, dim, ids, heads = 0, None, [], b""
        suffix = ".npy" if kind == "npy" else ".f32"
        with out.open_output_stream(f"{own}.data") as f:
            for batch in itertools.chain([first], batches):
                rows = _rows_of(batch.column(1))
                if dim not in (None, rows.shape[1]):
                    raise ValueError("rows of unequal lengths")
                n, dim = n + len(rows), rows.shape[1]
                ids.append(batch.column(0).to_numpy())
                f.write(np.ascontiguousarray(rows, "<f4").tobytes())
        if kind == "npy":
            heads = npy_head(n, dim, align)
        with out.open_output_stream(f"{own}{suffix}") as f, out.open_input_stream(f"{own}.data") as data:
            f.write(heads)
            while block := data.read(COPY):
                f.write(block)
        out.delete_file(f"{own}.data")
        files = {suffix: None, ".ids": np.concatenate(ids).astype("<i8").tobytes()}
        if kind != "npy":
            about = {"shape": [n, dim], "dtype": "float32", "byte_order": "little", "layout": "ND", "image_ids": []}
            files[".json"] = json.dumps(about).encode()
        for ending, data in files.items():
            if data is not None:
                with out.open_output_stream(f"{own}{ending}") as f:
                    f.write(data)
            out.move(f"{own}{ending}", f"{name}{ending}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    n = vectors.select("pos", F.col("embedding").cast("array<float>")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    fs.create_dir(partial, recursive=True)
    fs.move(partial, path)
    return n


def read_matrix(spark: SparkSession, path: str, kind: str = "npy") -> DataFrame:
    """(pos, embedding) of a folder that ``write_matrix`` made; a part whose rows and positions differ in number fails."""
    files = spark.read.format("binaryFile").load(path).where(~F.col("path").endswith(".crc")).select(F.regexp_extract("path", r"(part-\d+)\.", 1).alias("part"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("suffix"), "content")

    def parse(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        data = dict(zip(parts.column("suffix").to_pylist(), parts.column("content").to_pylist(), strict=True))
        ids = np.frombuffer(data["ids"], "<i8")
        if kind == "npy":
            matrix = parse_npy(data["npy"])
        else:
            about = json.loads(data["json"])
            matrix = np.frombuffer(data["f32"], "<f4").reshape(about["shape"])
        if len(ids) != len(matrix):
            raise ValueError(f"{len(matrix)} rows for {len(ids)} positions")
        return pa.table({"pos": pa.array(ids), "embedding": pa.array(list(matrix.astype(np.float32)), pa.list_(pa.float32()))})

    return files.groupBy("part").applyInArrow(parse, "pos long, embedding array<float>")


def write_summary(spark: SparkSession, target: str, summary: dict) -> None:
    """A run's summary as one JSON file; an existing one is refused."""
    fs, path = pa.fs.FileSystem.from_uri(target)
    if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
        raise FileExistsError(target)
    with fs.open_output_stream(f"{path}.partial") as f:
        f.write(json.dumps(summary, sort_keys=True).encode())
    fs.move(f"{path}.partial", path)
