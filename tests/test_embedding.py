"""Plugged-in models: batches, failures of single items, a reindex that is interrupted."""

import os

import pytest
from pyspark.sql import functions as F

from vectrail.operators import catalogue
from vectrail.streaming import embedding


def toy():
    """A model that counts its loads and batches in files, and can't take some crops."""

    def model(crops):
        if any(c.startswith(b"bad") for c in crops):
            raise OSError("unreadable")
        return [[float(len(c)), float(c[-1])] for c in crops]

    return model


def test_batches_and_failures(spark, tmp_path):
    marks = str(tmp_path / "loads")

    def load():
        with open(marks, "a") as f:
            f.write(f"{os.getpid()}\n")
        return toy()

    crops = [b"a", b"bad1", None, b"ccc", b"", b"bad2", *(b"x" * i for i in range(1, 60))]
    d = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(crops)], "pos long, crop binary").repartition(3)
    got = {r["pos"]: (r["embedding"], r["error"]) for r in embedding.embed(d, "toy-1", load, 7).collect()}
    embedding.embed(d, "toy-1", load, 7).collect()
    for i, c in enumerate(crops):
        if c is None:
            assert got[i] == (None, "no crop")
        elif c.startswith(b"bad"):
            assert got[i] == (None, "OSError: unreadable")
        elif not c:
            assert got[i][0] is None and got[i][1].startswith("IndexError")
        else:
            assert got[i] == ([float(len(c)), float(c[-1])], None)
    loads = open(marks).read().split()
    assert len(loads) == len(set(loads))  # no process loaded it twice


def test_interrupted_reindex_goes_on(spark, tmp_path):
    items = spark.createDataFrame([(i, f"i{i}", None, "2" if i % 3 == 0 else "1", [0.0, 0.0]) for i in range(60)], "pos long, image_id string, plate string, model_version string, embedding array<float>")
    store = catalogue.opened(spark, f"file://{tmp_path}/store", items, spark.createDataFrame([(1, "a")], "item_id long, tag string"))
    crops = items.select("pos", F.encode(F.expr("if(pos = 7, 'bad', image_id)"), "utf-8").alias("crop"))
    folder = f"file://{tmp_path}/queue"
    assert embedding.queue_stale(store, crops, "2", folder, files=4) == 40
    commit, calls = store.commit, []

    def lost(*args, **kw):
        version = commit(*args, **kw)
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("lost after the commit")
        return version

    store.commit = lost
    with pytest.raises(Exception, match="lost after the commit"):
        embedding.reindex(store, folder, f"file://{tmp_path}/progress", "2", toy).awaitTermination()
    assert store.manifest()["version"] == 3 and 0 < store.read("items").where("model_version = '1'").count() < 40
    assert embedding.queue_stale(store, crops, "2", folder) == 40  # the same queue
    embedding.reindex(store, folder, f"file://{tmp_path}/progress", "2", toy).awaitTermination()
    assert store.manifest()["version"] == 5 and calls == [2, 3, 4, 5]
    got = {r["pos"]: (r["model_version"], r["embedding"]) for r in store.read("items").collect()}
    assert all(got[i] == ("2", [0.0, 0.0] if i % 3 == 0 else [float(len(f"i{i}")), float(f"i{i}".encode()[-1])]) for i in range(60) if i != 7)
    assert got[7] == ("1", [0.0, 0.0]) and [tuple(r) for r in embedding.failures(spark, folder).collect()] == [(7, "OSError: unreadable")]
