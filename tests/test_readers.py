"""Readers, writers and the resumable import on small files."""

import pytest

from vectrail.plans.splits import split_roles
from vectrail.sources import readers


def test_boxes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("image_id,x,y,w,h\na,-2,3,10,5\nb/c,1,1,0,4\na,1,1,1,1\n")
    d = readers.read_boxes(spark, f"file://{path}")
    assert sorted(map(tuple, d.collect())) == [("a", 0, 3, 10, 5), ("a", 1, 1, 1, 1), ("b/c", 1, 1, 0, 4)]
    assert sorted(map(tuple, readers.box_problems(d).collect())) == [("a", "repeated"), ("b/c", "unsafe_id")]


def test_submission_round_trip(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("\ufeffq1,g1, g2 ,g1,nobody\n\nq2,g2\nq1,g2,,g1\nq9,g1\n", encoding="utf-8")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    d = readers.parse_submission(readers.read_lines(spark, f"file://{path}"), ids("q1", "q2", "q3"), ids("g1", "g2"))
    want = [("q1", "g1", 2), ("q1", "g2", 1), ("q2", "g2", 1)]
    assert sorted(d.select("query_id", "gallery_id", "rank").toPandas().itertuples(index=False, name=None)) == want
    out = f"file://{tmp_path}/out"
    readers.write_submission(d, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["q1,g2,g1", "q2,g2"]
    with pytest.raises(Exception, match="exist"):
        readers.write_submission(d, out)


def test_candidates(spark):
    d = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", " ", 0.9), ("q", None, 0.9), ("q", "c", None)], "query_id string, gallery_id string, confidence double")
    assert [r.gallery_id for r in readers.parse_candidates(d).orderBy("rank").collect()] == ["a", "b", "c"]


def test_import_goes_on(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    go = lambda: readers.import_boxes(spark, f"file://{inbox}", f"file://{tmp_path}/t", f"file://{tmp_path}/c", 1).awaitTermination()
    (inbox / "1.csv").write_text("image_id,x,y,w,h\na,-1,0,9,9\n../b,0,0,9,9\n")
    go()
    (inbox / "2.csv").write_text("image_id,x,y,w,h\nc,1,0,9,9\nd,1,0,0,9\n")
    go()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").collect())) == [("a", 0, 0, 9, 9), ("c", 1, 0, 9, 9)]


def test_split_needs_two_cameras(spark):
    d = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "pos long, vehicle_id long, camera_id long")
    with pytest.raises(Exception, match="one camera only"):
        split_roles(d, 2, 0.0).collect()
