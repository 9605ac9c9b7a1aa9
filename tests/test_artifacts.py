"""Array files, readers by column name, training lists and the sampler's rules."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.operators import gallery, metrics, ranking, sampling
from vectrail.sources import arrays, readers, tables


@pytest.mark.parametrize("align", [16, 64])
def test_npy_equals_numpy(tmp_path, align):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    data = arrays.npy_bytes(x, align)
    (tmp_path / "x.npy").write_bytes(data)
    assert (np.load(tmp_path / "x.npy") == x).all() and (len(data) - x.nbytes) % align == 0
    np.save(tmp_path / "y.npy", x.astype(np.float64))
    assert (arrays.parse_npy((tmp_path / "y.npy").read_bytes()) == x).all()
    for bad in (b"no array", data[:-1]):
        with pytest.raises(ValueError):
            arrays.parse_npy(bad)
    np.save(tmp_path / "z.npy", np.zeros(3))
    with pytest.raises(ValueError):
        arrays.parse_npy((tmp_path / "z.npy").read_bytes())


def test_matrix_is_published_once(spark, tmp_path):
    d = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "pos long, embedding array<float>")
    target = f"file://{tmp_path}/m"
    assert arrays.write_matrix(d, target, "f32") == 2
    assert {r["pos"]: r["embedding"] for r in arrays.read_matrix(spark, target, "f32").collect()} == {2: [1.0, 2.0], 1: [3.0, 4.0]}
    with pytest.raises(FileExistsError):
        arrays.write_matrix(d, target)


def _csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_boxes_by_name(spark, tmp_path):
    good = _csv(tmp_path, "a.csv", "h,w,extra,image_id,y,x\n4,3,?,007,2,1\n")
    d = readers.read_boxes_by_name(spark, good, ("vehicle_id",)).collect()
    assert [tuple(r) for r in d] == [("007", 1, 2, 3, 4, None)]
    for text in ("image_id,x,y,w\na,1,1,1\n", "image_id,x,y,w,h,x\na,1,1,1,1,1\n", "image_id,x,y,w,h\na,1,1,0,1\n", "image_id,x,y,w,h\na,1,1,99999999999,1\n", "image_id,x,y,w,h\n../a,1,1,1,1\n", "image_id,x,y,w,h\na,1,1,1,1\na,1,1,1,1\n", "image_id,x,y,w,h\n"):
        with pytest.raises(ValueError):
            readers.read_boxes_by_name(spark, _csv(tmp_path, "b.csv", text))
    with pytest.raises(ValueError):
        readers.read_truth(spark, good)
    truth = _csv(tmp_path, "truth.csv", "split,camera_id,image_id,vehicle_id\nquery,07,a,1\ngallery,7,b,01\n")
    assert [tuple(r) for r in readers.read_truth(spark, truth).collect()] == [("a", "1", "07"), ("b", "01", "7")]


def test_train_list_rules(spark):
    parse = lambda *x: readers.parse_train_list(spark.createDataFrame([(v,) for v in x], "line string"))
    ok = parse("path id cam label", "./a\\b.jpg v1 c1 0", "x.jpg;v2;c1;1", "")
    assert sorted(map(tuple, ok.collect())) == [("a/b.jpg", "v1", "c1", 0), ("x.jpg", "v2", "c1", 1)]
    for bad in (("a v1 c 0", "a v2 c 1"), ("a v1 c 1",), ("a v1 c 0", "b v2 c 0"), ("a v1 c 0", "b v1 c 1")):
        with pytest.raises(ValueError):
            parse(*bad)
    with pytest.raises(ValueError):
        readers.union_lists({"a": ok, "b": ok})


def test_blocks_of_three_and_one_become_two_and_two(spark):
    rows = spark.range(80).selectExpr("id AS pos", "id DIV 8 AS vehicle_id", "if(id % 8 < 6, 0, 1) AS camera_id")
    drawn = sampling.identity_batches(rows, 3, 4, 30)
    out = sampling.balanced(drawn, rows)
    before = drawn.join(rows.select("pos", "camera_id"), "pos").groupBy("batch", "vehicle_id").agg(F.sum(1 - F.col("camera_id")).alias("n"))
    after = out.groupBy("batch", "vehicle_id").agg(F.count("*").alias("all"), F.countDistinct("pos").alias("own"), F.sum(1 - F.col("camera_id")).alias("n"))
    assert {r["n"] for r in before.collect()} >= {3}
    assert {(r["all"], r["own"], r["n"]) for r in after.collect()} == {(4, 4, 2)}
    assert out.join(rows.selectExpr("pos", "camera_id AS own"), "pos").where("camera_id <> own").count() == 0


def test_calibration_needs_both_classes(spark):
    d = spark.createDataFrame([(1, 0.5, True, True, True, "tp")], "qpos long, score double, correct boolean, has_match boolean, accepted boolean, outcome string")
    with pytest.raises(Exception, match="with and without"):
        metrics.calibrate(d).collect()
    x = spark.range(1).select(metrics.next_float(F.lit(0.75)).alias("x")).first()["x"]
    assert x == float(np.nextafter(np.float32(0.75), np.float32(2)))


def test_query_sides_beyond_a_block(spark, sf):
    """Block pairs on Spark give what one broadcast block gives."""
    q, g = tables.queries(spark, sf), tables.gallery(spark, sf)
    show = lambda d: sorted((r["qpos"], r["rank"], r["gpos"], round(r["score"], 9)) for r in d.collect())
    rank = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("qpos").orderBy(F.desc("score"), "gpos"))).where("rank <= 5")
    assert show(rank(ranking.scored(q, g, 5, block=7))) == show(rank(ranking.scored(q, g, 5)))


def test_page_requests():
    assert gallery.page_of(None, None, 41) == (0, 20, 3) and gallery.page_of(3, 500, 401) == (400, 200, 3) and gallery.page_of(-1, 0, 0) == (0, 1, 0)


def test_a_summary_counts_accepted_queries(spark, sf):
    from vectrail import catalog

    got = catalog.queries()["run_summary"](spark, sf).first()
    exported = catalog.queries()["candidates_export"](spark, sf).count()
    assert got["accepted"] == exported > 0 and got["n_query"] > got["accepted"]
