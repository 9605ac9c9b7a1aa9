"""Tracks of entities as their sightings arrive, late ones included.

A keyed state holds an entity's sightings, in parts as ``tracks.greedy_track`` cuts them: between two parts lies so long a gap that
no trip conflicts across it. New sightings, however late, fall into parts or join neighbouring ones, and only these are
walked again; their decisions replace the former ones. So after any order of arrival the last decisions are those of the
whole walk.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from vectrail.functions import places
from vectrail.operators import tracks

#: What the state machine gets of a sighting: its order in the walk, then ``tracks.SIGHT``.
INPUT = ("entity_id", "rank", "trust", *tracks.SIGHT)
DECIDED = f"{tracks.TRACK}, walk long"


def parts_of(known: list[tuple], enough: float) -> list[list[tuple]]:
    """Sightings (rank, trust, us, id, ..., dwell) in order of time, cut where the last one's stay ended ``enough`` microseconds before."""
    out: list[list[tuple]] = []
    ended = float("-inf")
    for s in known:
        if s[2] - ended > enough or not out:
            out.append([])
        out[-1].append(s)
        ended = max(ended, s[2] + s[8] * 60e6)
    return out


def arrive(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, enough: float) -> Iterator[pd.DataFrame]:
    """Add an entity's new sightings to its state and decide the parts that they touch; a repeated id is no new one."""
    known, walks = pickle.loads(state.get[0]) if state.exists else ([], 0)
    seen = {s[3] for s in known}
    new = {}
    for frame in frames:
        for row in frame[list(INPUT[1:])].itertuples(index=False, name=None):
            if row[3] not in seen:
                new.setdefault(int(row[3]), (int(row[0]), float(row[1]), int(row[2]), int(row[3]), int(row[4]), *row[5:8], float(row[8])))
    if not new:
        return
    known = sorted([*known, *new.values()], key=lambda s: (s[2], s[3]))
    walks += 1
    state.update((pickle.dumps((known, walks)),))
    rows = []
    for part in parts_of(known, enough):
        if any(s[3] in new for s in part):
            rows += [(sid, key[0], *decision, walks) for sid, decision in tracks.decided(sorted(part, key=lambda s: (s[0], -s[1], s[2], s[3])))]
    columns = [c.split()[0] for c in DECIDED.split(", ")]
    yield pd.DataFrame(rows, columns=columns).astype({"conflict_with": "Int64"})


def track_stream(located: DataFrame, reach: float, target: str, checkpoint: str) -> StreamingQuery:
    """Append decisions on the sightings of the stream ``located`` to ``target``; stops when all present ones are read.

    ``checkpoint`` keeps progress and state, so a stopped run goes on. An entity's state grows with its sightings.
    """
    enough = reach / min(places.HOME_KMH, places.OPEN_KMH) * 60 * 60e6
    rows = tracks.walk_rows(located).select(*INPUT)
    decided = rows.groupBy("entity_id").applyInPandasWithState(lambda k, f, s: arrive(k, f, s, enough), DECIDED, "data binary", "append", GroupStateTimeout.NoTimeout)
    return decided.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_decisions(decided: DataFrame) -> DataFrame:
    """The newest decision on each sighting."""
    place = F.row_number().over(Window.partitionBy("entity_id", "sighting_id").orderBy(F.desc("walk")))
    return decided.withColumn("_place", place).where("_place = 1").drop("_place", "walk")
