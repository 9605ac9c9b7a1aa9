"""Writes of the gallery and the search service, as commits to a versioned store.

Tables: ``items`` (key pos), ``tags`` (key tag_id, with item_id) and ``searches`` (key id). Each function makes one
commit, so an item and its tags, or all ids of a batch of searches, change together. ``name`` makes a retry count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators import ordered
from vectrail.operators.gallery import inserted, plate_problem
from vectrail.sources.versioned import Drop, Put, Store

SEARCHES = "id long, qpos long, result string, accepted boolean, created_at timestamp"


def opened(spark: SparkSession, path: str, items: DataFrame, tags: DataFrame) -> Store:
    """A new store with these items and tags and no searches. Tags get ids by item and name."""
    store = Store(spark, path)
    store.create({"items": (items, "pos"), "tags": (tag_rows(tags), "tag_id"), "searches": (spark.createDataFrame([], SEARCHES), "id")})
    return store


def tag_rows(tags: DataFrame) -> DataFrame:
    """Tags with their key; an item has a tag once."""
    return tags.withColumn("tag_id", F.concat_ws("\x1f", F.col("item_id").cast("string"), "tag"))


def add_items(store: Store, items: DataFrame, version: str, name: str | None = None) -> int:
    """New items: a blank id becomes a random one, the model version is stamped."""
    columns = store.read("items").columns
    return store.commit([Put("items", inserted(items, version).select(*columns))], name)


def set_plates(store: Store, plates: DataFrame, name: str | None = None) -> int:
    """Set or, where ``plate`` is null, clear plates by (pos, plate); an empty or too long one fails all."""
    checked = F.when(plate_problem(F.col("plate")).isNotNull(), F.raise_error(F.concat(F.lit("plate "), plate_problem(F.col("plate")))).cast("string")).otherwise(F.regexp_replace("plate", r"(?U)^\s+|\s+$", ""))
    return _overlay(store, plates.select("pos", checked.alias("plate")), name)


def update_vectors(store: Store, vectors: DataFrame, version: str, name: str | None = None) -> int:
    """New vectors by (pos, embedding), stamped with their model's version."""
    return _overlay(store, vectors.select("pos", "embedding", F.lit(version).alias("model_version")), name)


def _overlay(store: Store, changes: DataFrame, name: str | None) -> int:
    """Items by pos with the columns of ``changes`` in place of their own; unknown ones are left out."""
    m = store.manifest()
    new = [c for c in changes.columns if c != "pos"]
    items = store.read("items", m["version"])
    rows = items.drop(*new).join(changes, "pos").select(*items.columns)
    return store.commit([Put("items", rows)], name, expected=None if name and dict(map(tuple, m["names"])).get(name) else m["version"])


def delete_items(store: Store, ids: DataFrame, name: str | None = None) -> int:
    """Items and their tags go."""
    return store.commit([Drop("items", "pos", ids), Drop("tags", "item_id", ids)], name)


def replace_tags(store: Store, ids: DataFrame, tags: DataFrame, name: str | None = None) -> int:
    """The items' tag sets become those of ``tags``, all at once; an item without any has none."""
    columns = store.read("tags").columns
    return store.commit([Drop("tags", "item_id", ids), Put("tags", tag_rows(tags).select(*columns))], name)


def save_searches(store: Store, found: DataFrame, threshold: float, created_at: Column, name: str | None = None) -> DataFrame:
    """Keep searches (qpos, rank, gpos, score) as records and return them with their new ids, in order of qpos.

    A record has its candidates as JSON, whether the first one reaches ``threshold``, and its time. Ids follow those that
    the store gave out before; a retried ``name`` gets the records of the first time.
    """
    done = dict(map(tuple, store.manifest()["names"])).get(name)
    if done is None:
        first, version = store.next_id("searches")
        rows = found.groupBy("qpos").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "gpos", "score")))).alias("result"), (F.max("score") >= threshold).alias("accepted"))
        rows = ordered.numbered(rows.withColumn("created_at", created_at), [F.col("qpos")], "id", first).select("id", "qpos", "result", "accepted", "created_at")
        n = found.select("qpos").distinct().count()
        done = store.commit([Put("searches", rows)], name, version, {"searches": first + n})
    new, old = store.manifest(done), store.manifest(done - 1)
    return store.read("searches", done).where(F.col("id").between(old["next"]["searches"], new["next"]["searches"] - 1))
