"""Matrix files read in stretches, and numbers and sums over all rows in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import ordered
from vectrail.sources import npy


@pytest.mark.parametrize("kind,part", [("<f4", 64), ("<f8", 1000), (">f4", 7), ("<f2", 1 << 20)])
def test_reads_numpys_file(spark, tmp_path, kind, part):
    x = np.random.default_rng(1).normal(size=(57, 5)).astype(kind)
    np.save(tmp_path / "x.npy", x)
    d = npy.read_npy(spark, f"file://{tmp_path}/x.npy", part)
    assert d.rdd.getNumPartitions() == -(-57 // max(1, part // (5 * x.itemsize)))
    got = {r["row"]: r["embedding"] for r in d.collect()}
    assert [got[i] for i in range(57)] == x.astype(np.float32).tolist()
    assert npy.read_npy(spark, str(tmp_path / "x.npy")).count() == 57


def test_versions_and_odd_shapes(spark, tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    for version in ((1, 0), (2, 0), (3, 0)):
        with open(tmp_path / "v.npy", "wb") as f:
            np.lib.format.write_array(f, x, version=version)
        assert npy.header(str(tmp_path / "v.npy"))[1:3] == (2, 3)
        assert sorted(map(tuple, npy.read_npy(spark, f"{tmp_path}/v.npy").collect()))[1][1] == [3.0, 4.0, 5.0]
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    assert npy.read_npy(spark, f"{tmp_path}/none.npy").collect() == []
    for name, bad in (("flat", np.zeros(3)), ("ints", np.zeros((2, 2), int)), ("columns", np.asfortranarray(np.ones((3, 2))))):
        np.save(tmp_path / f"{name}.npy", bad)
        with pytest.raises(ValueError):
            npy.read_npy(spark, f"{tmp_path}/{name}.npy")
    (tmp_path / "short.npy").write_bytes((tmp_path / "v.npy").read_bytes()[:-1])
    (tmp_path / "text.npy").write_text("id,x")
    for name in ("short", "text"):
        with pytest.raises(ValueError):
            npy.read_npy(spark, f"{tmp_path}/{name}.npy")


def test_rows_follow_the_csv_files(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 4)).astype(np.float32)
    x[7] = 0
    np.save(tmp_path / "e.npy", x)
    names = [f"{i:03d}" for i in r.permutation(30)]
    (tmp_path / "q.csv").write_text("x,image_id\n" + "".join(f"1,{n}\n" for n in names[:11]))
    (tmp_path / "g.csv").write_text("image_id\n" + "".join(f"{n}\n" for n in names[11:]))
    files = [f"file://{tmp_path}/{n}" for n in ("e.npy", "q.csv", "g.csv")]
    got = {(d["side"], d["at"]): (d["image_id"], d["embedding"]) for d in npy.evaluation_vectors(spark, *files, part_bytes=50).collect()}
    assert len(got) == 30
    for i in range(30):
        name, v = got["query", i] if i < 11 else got["gallery", i - 11]
        assert name == names[i] and np.allclose(v, x[i] / max(np.linalg.norm(x[i]), 1e-12), atol=1e-6)
    np.save(tmp_path / "f.npy", x[1:])
    with pytest.raises(ValueError, match="29 vectors"):
        npy.evaluation_vectors(spark, f"{tmp_path}/f.npy", *files[1:])


def test_file_order_over_many_splits(spark, tmp_path):
    lines = [f"{i % 7},name {i}" for i in range(4000)]
    (tmp_path / "long.csv").write_text("k,image_id\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = npy.file_order(spark, f"file://{tmp_path}/long.csv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["at"], r["image_id"]) for r in got) == [(i, f"name {i}") for i in range(4000)]


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_running_sums_and_numbers(spark, ranges):
    r = random.Random(5)
    rows = [(i, r.choice([1, 1, 2, 5]), r.choice([None, 3, -2])) for i in range(500)]
    d = spark.createDataFrame(rows, "i int, k int, v int").repartition(5)
    order = [F.desc("k"), F.col("i")]
    want, total = {}, 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))):
        total += v or 0
        want[i] = (n + 1, total)
    got = ordered.running(ordered.numbered(d, order, "n", 1, ranges), order, {"total": F.col("v")}, ranges).collect()
    assert {x["i"]: (x["n"], x["total"]) for x in got} == want
    assert ordered.running(d.limit(0), order, {"total": F.col("v")}, ranges).count() == 0


@pytest.mark.parametrize("ranges", [None, 11])
def test_neighbours(spark, ranges):
    rows = [(i * 37 % 101, i) for i in range(101)]
    got = ordered.with_neighbour(spark.createDataFrame(rows, "k int, v int").repartition(4), [F.col("k")], F.col("v"), "before", ranges).collect()
    by = dict(rows)
    assert {x["k"]: x["before"] for x in got} == {k: by.get(k - 1) for k in by}


def test_raw_files_and_folders(spark, tmp_path):
    from vectrail.sources import arrays

    x = np.random.default_rng(3).normal(size=(40, 6)).astype(np.float32)
    for suffix, data in arrays.f32_bytes(x[:9], [f"i{i}" for i in range(9)]).items():
        (tmp_path / f"raw{suffix}").write_bytes(data)
    path = f"file://{tmp_path}/raw.f32"
    assert [r["embedding"] for r in npy.read_npy(spark, path, 30).orderBy("row").collect()] == x[:9].tolist()
    assert sorted(map(tuple, npy.sidecar_ids(spark, path).collect())) == [(i, f"i{i}") for i in range(9)]
    (tmp_path / "raw.json").write_text('{"shape": [9, 6], "dtype": "float32", "byte_order": "big"}')
    with pytest.raises(ValueError):
        npy.read_npy(spark, path)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, embedding array<float>").repartitionByRange(5, "pos").sortWithinPartitions("pos")
    for kind in ("npy", "f32"):
        assert arrays.write_matrix(d, f"file://{tmp_path}/{kind}", kind) == 40
        assert npy.shape(f"file://{tmp_path}/{kind}") == (40, 6)
        assert [r["embedding"] for r in npy.read_npy(spark, f"file://{tmp_path}/{kind}", 60).orderBy("row").collect()] == x.tolist()
        assert not [p for p in (tmp_path / kind).iterdir() if p.name.startswith("_")]
    assert np.load(sorted((tmp_path / "npy").glob("*.npy"))[0]).shape[1] == 6
