"""Tracks of a stream of late sightings against those of the whole walk."""

from pyspark.sql import functions as F

from vectrail.operators import tracks
from vectrail.sources import tables
from vectrail.streaming import journeys


def test_stream_equals_batch(spark, sf, tmp_path):
    located = tables.located(spark, sf)
    schema, folder = located.schema, f"{tmp_path}/in"
    located.withColumn("f", F.pmod(F.xxhash64("sighting_id"), F.lit(5))).write.partitionBy("f").parquet(folder)  # arrival in no order of time
    reach = 30.0
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/*")
    for _ in range(2):  # the second run finds nothing new
        journeys.track_stream(source, reach, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    decided = spark.read.parquet(f"{tmp_path}/out")
    show = lambda d: sorted((r["sighting_id"], r["accepted"], r["conflict_with"], None if r["km"] is None else round(r["km"], 6)) for r in d.collect())
    assert show(journeys.last_decisions(decided)) == show(tracks.greedy_track(located, reach))
    assert decided.agg(F.max("walk")).first()[0] >= 2


def test_only_the_touched_part_is_walked_again():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    row = lambda i, us, rank=1: (7, rank, 0.5, us, i, i % 3, 55.0 + i % 3, 37.0, "home", 0.0)
    frame = lambda *rows: iter([pd.DataFrame(list(rows), columns=list(journeys.INPUT))])
    state, hour = State(), 3_600_000_000
    first = next(journeys.arrive((7,), frame(row(1, 0), row(2, hour), row(3, 100 * hour), row(4, 101 * hour)), state, 20 * hour))
    assert sorted(first["sighting_id"]) == [1, 2, 3, 4]
    late = next(journeys.arrive((7,), frame(row(5, 2 * hour), row(1, 0)), state, 20 * hour))
    assert sorted(late["sighting_id"]) == [1, 2, 5] and set(late["walk"]) == {2}
    assert list(journeys.arrive((7,), frame(row(5, 2 * hour)), state, 20 * hour)) == []
    bridge = next(journeys.arrive((7,), frame(*(row(10 + i, (20 + 16 * i) * hour) for i in range(5))), state, 20 * hour))
    assert sorted(bridge["sighting_id"]) == [1, 2, 3, 4, 5, 10, 11, 12, 13, 14]  # two parts become one
