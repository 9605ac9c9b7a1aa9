"""Domain views over the input tables: gallery and queries, sightings, cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The service's current model, and the frame that boxes lie in.
CURRENT_VERSION, FRAME_W, FRAME_H = "1.2.0", 1920, 1080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a gallery row: position, ids, box, version, plate, vector."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS pos", "concat('img_', vec_id) AS image_id", "label AS vehicle_id", "vec_id % 7 AS camera_id",
        "cast((vec_id * 37) % 1900 AS int) AS x", "cast((vec_id * 53) % 1060 AS int) AS y",
        "cast(40 + (vec_id * 11) % 400 AS int) AS w", "cast(30 + (vec_id * 13) % 300 AS int) AS h",
        "if(vec_id % 11 = 0, '1.1.0', '1.2.0') AS model_version", "if(vec_id % 3 = 0, concat('P', vec_id), NULL) AS plate", "embedding",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query rows: every fifth embedding."""
    return gallery_base(spark, sf_dir).where("pos % 5 = 0")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery rows; vehicles 8 and 9 are left out, which makes their queries open-set."""
    return gallery_base(spark, sf_dir).where("pos % 5 <> 0 AND vehicle_id NOT IN (8, 9)")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic tags of the gallery rows: one or two per item, some without a region."""
    base = gallery_base(spark, sf_dir)
    one = "struct(concat('kind_', pos % 4) AS tag, cast(0.5 + (pos % 5) / 10.0 AS double) AS confidence, if(pos % 2 = 0, x, NULL) AS box_x, y AS box_y, w AS box_w, h AS box_h)"
    two = "struct(concat('colour_', pos % 6) AS tag, cast(0.9 AS double) AS confidence, cast(NULL AS int) AS box_x, cast(NULL AS int) AS box_y, cast(NULL AS int) AS box_w, cast(NULL AS int) AS box_h)"
    return base.selectExpr("pos AS item_id", f"explode(if(pos % 3 = 0, array({one}, {two}), array({one}))) AS t").select("item_id", "t.*")


def cameras(spark: SparkSession, count: int = 100) -> DataFrame:
    """The camera registry."""
    return spark.range(count).selectExpr(
        "id AS camera_id", "55.50D + ((id * 37) % 97) * 0.005D AS lat", "37.30D + ((id * 53) % 89) * 0.008D AS lon",
        "if(id < 80, 'home', concat('city_', id % 5)) AS city", "if(id % 4 = 0, 'parking', 'road') AS kind",
        "CASE WHEN id % 4 <> 0 THEN NULL WHEN id % 3 = 0 THEN 'residential' WHEN id % 3 = 1 THEN 'business' ELSE 'leisure' END AS zone",
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as camera sightings of entities."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS sighting_id", "user_id AS entity_id", "cast(get_json_object(props, '$.k') AS bigint) AS camera_id", "cast(ts AS timestamp) AS ts",
        "CASE event_type WHEN 'purchase' THEN 'real' WHEN 'error' THEN 'lookalike' ELSE 'sim' END AS kind", "value / 600 AS confidence",
        "if(event_type = 'signup', floor(value * 3), NULL) AS dwell_min",
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with their camera's place; unknown cameras drop out. The registry is a fixed 100 rows."""
    return sightings(spark, sf_dir).join(F.broadcast(cameras(spark).withColumnRenamed("kind", "camera_kind")), "camera_id")
