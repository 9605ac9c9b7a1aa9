"""Hierarchical merging of one bounded state per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import materialize

#: States that one task merges.
FAN_IN = 32


def merge_states(states: DataFrame, merge: Callable[[list[bytes]], bytes], fan_in: int = FAN_IN) -> bytes | None:
    """The merged state of all rows of ``states`` (part, state); None if there are none.

    ``part`` numbers the partitions that the states come from. A task holds ``fan_in`` states
    at most, a level has that many times fewer rows than the one before, and only the last
    state reaches the driver. ``merge`` gets its states in order of ``part``, so reruns agree.
    """
    states = materialize(states, "states")
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, s) for part in parts for p, s in zip(part.column("part").to_pylist(), part.column("state").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([merge([s for _, s in rows])], pa.binary())], names=["part", "state"])

    while True:
        states = states.groupBy(F.expr(f"part DIV {fan_in}").alias("to")).applyInArrow(run, "part long, state binary")
        last //= fan_in
        if last == 0:
            return bytes(states.first()["state"])
