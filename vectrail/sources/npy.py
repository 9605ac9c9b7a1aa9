"""One large array file as a Spark source: ``spark.read.format("npy").load(path)``, and what is evaluated from it.

A matrix file is read in stretches of rows, one task each: the header tells where the numbers start, and a task seeks to its
rows and reads them alone. Versions 1 to 3 of the format and floats of 2, 4 and 8 bytes in either byte order are understood;
matrices by columns, other numbers of dimensions and files of the wrong length fail before any task starts.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vectrail.functions.vectors import l2_normalize
from vectrail.operators import ordered

#: Bytes of numbers of a task, and rows of a batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path within it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def header(path: str) -> tuple[np.dtype, int, int, int]:
    """(number type, rows, dimensions, where the numbers start) of a matrix file.

    A raw file (.f32) has its shape in the JSON file beside it, which must say little-endian float32.
    """
    fs, place = opened(path)
    if place.endswith(".f32"):
        with fs.open_input_file(f"{place.removesuffix('.f32')}.json") as f:
            about = json.loads(f.read())
        if about.get("dtype") != "float32" or about.get("byte_order", "little") != "little" or len(about.get("shape", ())) != 2:
            raise ValueError(f"not a matrix of little-endian float32: {path}")
        kind, shape, at, length = np.dtype("<f4"), about["shape"], 0, fs.get_file_info(place).size
    else:
        with fs.open_input_file(place) as f:
            start = f.read(12)
            if start[:6] != b"\x93NUMPY":
                raise ValueError(f"not an array file: {path}")
            wide = start[6] > 1
            (size,) = struct.unpack_from("<I" if wide else "<H", start, 8)
            f.seek(12 if wide else 10)
            about = ast.literal_eval(f.read(size).decode("utf-8" if start[6] > 2 else "latin1"))
            at, length = f.tell(), f.size()
        kind, shape = np.dtype(about["descr"]), about["shape"]
        if len(shape) != 2 or kind.kind != "f" or about["fortran_order"] and min(shape) > 1:
            raise ValueError(f"not a matrix of floats by rows: {about}")
    if length - at != shape[0] * shape[1] * kind.itemsize:
        raise ValueError(f"{path} has {length - at} bytes of numbers, {shape[0]} x {shape[1]} need {shape[0] * shape[1] * kind.itemsize}")
    return kind, *shape, at


def files_of(path: str) -> list[str]:
    """The file itself, or the matrix files of a folder in order of their names."""
    fs, place = opened(path)
    if fs.get_file_info(place).type != pa.fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(place)))
    return [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "_." and n.endswith((".npy", ".f32"))]


def shape(path: str) -> tuple[int, int]:
    """(rows, dimensions) of a file or folder; files of unequal dimensions fail."""
    shapes = [header(f)[1:3] for f in files_of(path)]
    if len({d for _, d in shapes}) > 1:
        raise ValueError(f"files of unequal dimensions in {path}")
    return sum(n for n, _ in shapes), shapes[0][1] if shapes else 0


@dataclass
class Rows(InputPartition):
    """Some rows of a file, and the number of its first one among all rows."""

    path: str
    first: int
    count: int
    number: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.files = files_of(options["path"])
        self.part_bytes = int(options.get("partitionBytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        out, before = [], 0
        for path in self.files:
            kind, rows, dim, _ = header(path)
            each = max(1, self.part_bytes // max(1, dim * kind.itemsize))
            out += [Rows(path, i, min(each, rows - i), before + i) for i in range(0, rows, each)]
            before += rows
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        kind, _, dim, start = header(partition.path)
        fs, place = opened(partition.path)
        width = dim * kind.itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        with fs.open_input_file(place) as f:
            f.seek(start + partition.first * width)
            for at in range(0, partition.count, step):
                n = min(step, partition.count - at)
                x = np.frombuffer(f.read(n * width), kind).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
                number = np.arange(partition.number + at, partition.number + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.ListArray.from_arrays(ends, pa.array(x))], names=["row", "embedding"])


class MatrixFile(DataSource):
    """(row, embedding) of a .npy file; ``partitionBytes`` sets the bytes of numbers of a task."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(self.options)


def read_npy(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, embedding) of a matrix file, or of a folder of them, rows numbered from 0 in order of the files' names."""
    shape(path)  # a bad file fails here, in the driver
    spark.dataSource.register(MatrixFile)
    return spark.read.format("npy").option("partitionBytes", part_bytes).load(path)


def file_order(spark: SparkSession, path: str, column: str = "image_id") -> DataFrame:
    """(at, ``column``) of a CSV file with a header, or a folder of them: rows numbered from 0 in the files' order."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    if column not in d.columns:
        raise ValueError(f"{path} has no column {column}")
    d = d.select(column, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return ordered.numbered(d, [F.col("_f"), F.col("_b"), F.col("_i")], "at").select("at", column)


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a text file or a folder of them, numbered from 0 in order of the files' names."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return ordered.numbered(d, [F.col("_f"), F.col("_b"), F.col("_i")], "at").select("at", "line")


def sidecar_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row, image_id) that the JSON file beside a raw file lists."""
    d = spark.read.schema("image_ids array<string>").json(f"{path.removesuffix('.f32')}.json", multiLine=True)
    return d.select(F.posexplode("image_ids").alias("row", "image_id")).withColumn("row", F.col("row").cast("long"))


def evaluation_vectors(spark: SparkSession, npy: str, query_csv: str, gallery_csv: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(side, at, image_id, embedding) of a run: the array's rows are the queries of one CSV file, then the gallery of the other.

    Vectors are normalised with a floor of 1e-12 for the norm. A row count other than that of both files together fails.
    """
    q, g = file_order(spark, query_csv), file_order(spark, gallery_csv)
    n_q, n_g, rows = q.count(), g.count(), shape(npy)[0]
    if rows != n_q + n_g:
        raise ValueError(f"{rows} vectors for {n_q} queries and {n_g} gallery rows")
    ids = q.select(F.lit("query").alias("side"), "at", "image_id", F.col("at").alias("row")).unionByName(g.select(F.lit("gallery").alias("side"), "at", "image_id", (F.col("at") + n_q).alias("row")))
    return read_npy(spark, npy, part_bytes).join(ids, "row").select("side", "at", "image_id", l2_normalize("embedding").alias("embedding"))
