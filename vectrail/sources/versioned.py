"""Keyed tables that are changed by commits: immutable Parquet layers and one manifest per version.

A commit writes its rows as new layers and then publishes the next version's manifest by a rename that fails if another
writer was first, so several tables change together or not at all; a writer that dies before leaves unreferenced files and
the old version. A layer puts rows (replacing those with the same key) or drops rows by the values of a column. Reading
unions the layers of a version and joins, for each such column, the newest layer that replaces or drops a value: rows
of older layers with it are gone. Layers of edits are small beside the first one, so Spark broadcasts them where their
size allows, and ``compact`` folds them in. A version that was read stays as it is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of commits that a manifest remembers, so that a retried one counts once.
REMEMBERED = 1000


class Conflict(Exception):
    """Another commit came first."""


@dataclass(frozen=True)
class Put:
    """Rows that are added to ``table``, or replace those with the same key. The key must not repeat."""

    table: str
    rows: DataFrame


@dataclass(frozen=True)
class Drop:
    """Rows of ``table`` go whose ``column`` has one of the values in the first column of ``values``."""

    table: str
    column: str
    values: DataFrame


class Store:
    """Tables below one folder that all tasks see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def create(self, tables: dict[str, tuple[DataFrame, str]]) -> int:
        """A new store of tables by name, each with its key column; an existing one fails."""
        if self._files.exists(self._at(f"{self.path}/versions")):
            raise FileExistsError(self.path)
        layers = {n: [{"path": self._written(df), "column": key, "rows": True}] for n, (df, key) in tables.items()}
        return self._publish({"version": 1, "keys": {n: key for n, (_, key) in tables.items()}, "schemas": {n: df.schema.json() for n, (df, _) in tables.items()}, "layers": layers, "next": dict.fromkeys(tables, 1), "names": []})

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the last, consists of."""
        if version is None:
            names = [f.getPath().getName() for f in self._files.listStatus(self._at(f"{self.path}/versions"))]
            version = max(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        stream = self._files.open(self._at(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of ``table`` at a version."""
        m = self.manifest(version)
        schema = self._schema(m, table)
        layers = list(enumerate(m["layers"][table]))
        parts = [self.spark.read.schema(schema).parquet(x["path"]).withColumn("_layer", F.lit(i)) for i, x in layers if x["rows"]]
        d = reduce(DataFrame.unionByName, parts)
        for column in sorted({x["column"] for _, x in layers[1:]}):
            gone = [self.spark.read.parquet(x["path"]).select(F.col(column).alias("_value"), F.lit(i).alias("_newest")) for i, x in layers[1:] if x["column"] == column]
            newest = reduce(DataFrame.unionByName, gone).groupBy("_value").agg(F.max("_newest").alias("_newest"))
            d = d.join(newest, F.col(column) == F.col("_value"), "left").where(F.col("_newest").isNull() | (F.col("_newest") <= F.col("_layer"))).drop("_value", "_newest")
        return d.drop("_layer")

    def commit(self, changes: list[Put | Drop], name: str | None = None, expected: int | None = None, numbered: dict[str, int] | None = None) -> int:
        """Publish ``changes``, in order, as the next version and return its number.

        A commit whose ``name`` is remembered was done before: its version is returned and nothing is written. ``expected`` is
        the version that the changes were made from; where that isn't the last one any more, ``Conflict`` is raised.
        Without it they go on top of whatever is there. ``numbered`` moves tables' next ids on.
        """
        if done := self._done(self.manifest(), name):
            return done
        layers = [(c.table, {"path": self._written(c.rows), "rows": True} if isinstance(c, Put) else {"path": self._written(c.values.select(F.col(c.values.columns[0]).alias(c.column)).distinct()), "rows": False, "column": c.column}) for c in changes]
        while True:
            m = self.manifest()
            if done := self._done(m, name):
                return done
            if expected is not None and m["version"] != expected:
                raise Conflict(f"made from version {expected}, the last is {m['version']}")
            for table, layer in layers:
                m["layers"][table] = [*m["layers"][table], {"column": m["keys"][table]} | layer]
            m["version"] += 1
            m["next"] |= numbered or {}
            m["names"] = [*m["names"], *([[name, m["version"]]] if name else [])][-REMEMBERED:]
            try:
                return self._publish(m)
            except Conflict:
                if expected is not None:
                    raise

    def compact(self, table: str) -> int:
        """Fold the layers of ``table`` into one; fails with ``Conflict`` if a commit comes in between."""
        m = self.manifest()
        m["layers"][table] = [{"path": self._written(self.read(table, m["version"])), "column": m["keys"][table], "rows": True}]
        m["version"] += 1
        return self._publish(m)

    def next_id(self, table: str) -> tuple[int, int]:
        """(the next free id of ``table``, the version that says so)."""
        m = self.manifest()
        return m["next"][table], m["version"]

    def _done(self, manifest: dict, name: str | None) -> int | None:
        return dict(map(tuple, manifest["names"])).get(name)

    def _schema(self, manifest: dict, table: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schemas"][table]))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:020d}.json"

    def _written(self, df: DataFrame) -> str:
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _publish(self, manifest: dict) -> int:
        """Write the manifest under a name of its own and rename it to its version's, unless that is there."""
        draft, final = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._at(self._manifest(manifest["version"]))
        self._files.mkdirs(final.getParent())
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, final, plain)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {manifest['version']} is taken") from None
            raise
        return manifest["version"]
