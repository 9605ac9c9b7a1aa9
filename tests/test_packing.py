"""Batches of frames against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from vectrail.operators import packing


def plain(sizes, frames, most, largest):
    out, batch, place, total = {}, -1, 0, 0
    for i, s in enumerate(sizes):
        if s is None or s > largest:
            out[i] = (None, None, True)
            continue
        if batch < 0 or place >= frames or total + s > most:
            batch, place, total = batch + 1, 0, 0
        out[i] = (batch, place, False)
        place, total = place + 1, total + s
    return out


@pytest.mark.parametrize("frames,most,largest,segment,seed", [(5, 100, 100, 5, 1), (5, 100, 60, 17, 2), (64, 3000, 2500, 100_000, 3), (3, 10, 200, 9, 4), (1, 50, 50, 4, 5), (7, 10**9, 10**9, 11, 6)])
def test_equals_a_plain_loop(spark, frames, most, largest, segment, seed):
    r = random.Random(seed)
    sizes = [r.choice([None, 0, 1, r.randint(0, 30), r.randint(0, 120)]) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(sizes)), "i int, s int").repartition(6)
    got = packing.packed(d, [F.col("i")], F.col("s"), frames, most, largest, segment).collect()
    assert {x["i"]: (x["batch"], x["place"], x["refused"]) for x in got} == plain(sizes, frames, most, largest)


def test_few_frames(spark):
    d = spark.createDataFrame([(1, 5)], "i int, s int")
    assert [(x["batch"], x["place"]) for x in packing.packed(d, [F.col("i")], F.col("s")).collect()] == [(0, 0)]
    assert packing.packed(d.limit(0), [F.col("i")], F.col("s")).collect() == []
    assert [x["refused"] for x in packing.packed(d, [F.col("i")], F.lit(1 << 40)).collect()] == [True]
