"""Commits to versioned tables: edits read back, old versions, lost and competing writers."""

import pytest
from pyspark.sql import functions as F

from vectrail.operators import catalogue
from vectrail.sources.versioned import Conflict, Drop, Put, Store

ITEMS = "pos long, image_id string, plate string, model_version string, embedding array<float>"


def items(spark, *pos, version="1", plate=None):
    return spark.createDataFrame([(p, f"i{p}", plate, version, [float(p)]) for p in pos], ITEMS)


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, tag string")


def ids(spark, *pos):
    return spark.createDataFrame([(p,) for p in pos], "pos long")


@pytest.fixture
def store(spark, tmp_path):
    return catalogue.opened(spark, f"file://{tmp_path}/store", items(spark, 1, 2, 3), tags(spark, (1, "a"), (2, "a"), (2, "b"), (3, "c")))


def rows(d, *columns):
    return sorted(tuple(r[c] for c in columns) for r in d.collect())


def test_edits_and_old_versions(spark, store):
    assert catalogue.add_items(store, items(spark, 4).drop("model_version"), "2") == 2
    catalogue.set_plates(store, spark.createDataFrame([(1, "\t A1\n"), (4, "B"), (9, "unknown")], "pos long, plate string"))
    catalogue.update_vectors(store, spark.createDataFrame([(2, [9.0])], "pos long, embedding array<float>"), "3")
    catalogue.replace_tags(store, ids(spark, 2, 3), tags(spark, (2, "z")))
    catalogue.delete_items(store, ids(spark, 1))
    last = catalogue.set_plates(store, spark.createDataFrame([(4, None)], "pos long, plate string"))
    assert last == 7
    assert rows(store.read("items"), "pos", "image_id", "model_version", "embedding") == [(2, "i2", "3", [9.0]), (3, "i3", "1", [3.0]), (4, "i4", "2", [4.0])]
    assert {r["plate"] for r in store.read("items").collect()} == {None}
    assert rows(store.read("items", 3), "pos", "embedding") == [(1, [1.0]), (2, [2.0]), (3, [3.0]), (4, [4.0])]
    assert {r["pos"]: r["plate"] for r in store.read("items", 3).collect()} == {1: "A1", 2: None, 3: None, 4: "B"}
    assert rows(store.read("tags"), "item_id", "tag") == [(2, "z")] and len(rows(store.read("tags", 4), "tag")) == 4
    before = rows(store.read("items"), "pos", "image_id")
    assert store.compact("items") == 8 and len(store.manifest()["layers"]["items"]) == 1
    assert rows(store.read("items"), "pos", "image_id") == before and rows(Store(spark, store.path).read("tags", 1), "tag") == [("a",), ("a",), ("b",), ("c",)]
    catalogue.add_items(store, items(spark, 1).drop("model_version"), "2")  # a deleted key may come back
    assert rows(store.read("items"), "pos") == [(1,), (2,), (3,), (4,)]


def test_bad_plate_changes_nothing(spark, store):
    for bad in ("  ", "x" * 33):
        with pytest.raises(Exception, match="plate"):
            catalogue.set_plates(store, spark.createDataFrame([(1, "OK"), (2, bad)], "pos long, plate string"))
    assert store.manifest()["version"] == 1 and {r["plate"] for r in store.read("items").collect()} == {None}


def test_a_lost_writer_leaves_the_old_version(spark, store):
    fails = ids(spark, 1).select(F.when(F.col("pos") > 0, F.raise_error(F.lit("lost")).cast("long")).alias("pos"))
    with pytest.raises(Exception, match="lost"):
        store.commit([Drop("items", "pos", ids(spark, 1)), Drop("tags", "item_id", fails)])
    assert store.manifest()["version"] == 1 and len(rows(store.read("items"), "pos")) == 3


def test_retries_and_competing_writers(spark, store):
    assert catalogue.add_items(store, items(spark, 4).drop("model_version"), "2", "import-7") == 2
    assert catalogue.delete_items(store, ids(spark, 4)) == 3
    assert catalogue.add_items(store, items(spark, 4).drop("model_version"), "2", "import-7") == 2  # done before: 4 stays deleted
    assert rows(store.read("items"), "pos") == [(1,), (2,), (3,)]
    with pytest.raises(Conflict):
        store.commit([Put("items", items(spark, 5))], expected=2)
    taken = store.manifest()
    with pytest.raises(Conflict):
        store._publish(taken)
    # another writer's version appears after this one looked: without an expected version it goes on top
    seen, publish = [], store._publish

    def late(m):
        if not seen:
            seen.append(Store(spark, store.path).commit([Put("items", items(spark, 8))]))
        return publish(m)

    store._publish = late
    assert store.commit([Put("items", items(spark, 9))]) == 5 and seen == [4]
    assert rows(store.read("items"), "pos") == [(1,), (2,), (3,), (8,), (9,)]
    with pytest.raises(FileExistsError):
        store.create({"items": (items(spark, 1), "pos")})


def test_searches_get_ids(spark, store):
    found = spark.createDataFrame([(q, r, 10 * q + r, 1.0 / r - q / 10) for q in (5, 3, 4) for r in (1, 2)], "qpos long, rank int, gpos long, score double")
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    first = catalogue.save_searches(store, found, 0.6, at, "morning")
    assert rows(first, "id", "qpos", "accepted") == [(1, 3, True), (2, 4, True), (3, 5, False)]
    assert '"gpos":32' in first.where("id = 1").first()["result"]
    again = catalogue.save_searches(store, found, 0.6, at, "morning")
    assert rows(again, "id", "qpos") == [(1, 3), (2, 4), (3, 5)] and store.read("searches").count() == 3
    more = catalogue.save_searches(store, found.where("qpos > 3"), 0.6, at)
    assert rows(more, "id", "qpos") == [(4, 4), (5, 5)] and rows(store.read("searches"), "id") == [(i,) for i in range(1, 6)]
