"""Annotation-shaped tables derived from the driver's event tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One star-shaped ring of eight corners in each box, so that areas and crossings are exact.
_RING = (
    "array(array(x, y + h * 0.25, x + w * 0.25, y, x + w * 0.75, y, x + w, y + h * 0.25,"
    " x + w, y + h * 0.75, x + w * 0.75, y + h, x + w * 0.25, y + h, x, y + h * 0.75))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, supercategory): the event types in alphabetical order, from 1; a handful of rows."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    # the codes come from a self join of the few names, not from a window without partitions
    other = names.select(F.col("name").alias("o"))
    coded = names.join(F.broadcast(other), F.col("o") <= F.col("name")).groupBy("name").agg(F.count("*").alias("id"))
    return coded.select("id", "name", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("supercategory"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image_id, category_id, category_name, x, y, w, h, bbox, segmentation, area, iscrowd, score, extra)."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "user_id AS image_id",
        "event_type AS category_name",
        "CAST((event_id * 37) % 600 AS DOUBLE) AS x",
        "CAST((event_id * 53) % 440 AS DOUBLE) AS y",
        "CAST((event_id * 7) % 90 + 1 AS DOUBLE) AS w",
        "CAST((event_id * 11) % 70 + 1 AS DOUBLE) AS h",
        "value AS score",
        "props AS extra",
    )
    c = categories(spark, sf_dir).select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return e.join(F.broadcast(c), "category_name").selectExpr(
        "id", "image_id", "category_id", "category_name", "x", "y", "w", "h", "array(x, y, w, h) AS bbox", f"{_RING} AS segmentation", "w * h AS area", "CAST(id % 10 = 0 AS INT) AS iscrowd", "score", "extra"
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, width, height, file_name)."""
    return table(spark, sf_dir, "events").select("user_id").distinct().selectExpr("user_id AS id", "CAST(640 + 320 * (user_id % 3) AS INT) AS width", "CAST(480 + 240 * (user_id % 2) AS INT) AS height", "concat('img_', user_id, '.jpg') AS file_name")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image_id, x0, y0, x1, y1, area): the boxes in corner form."""
    return annotations(spark, sf_dir).selectExpr("id", "image_id", "x AS x0", "y AS y0", "x + w AS x1", "y + h AS y1", "area")


#: Pixels of a task, about.
PIXELS = 1 << 19


def pixels(spark: SparkSession, sf_dir: str, per_image: int = 400) -> DataFrame:
    """(image_id, y, x, r, g, b): a small synthetic colour grid for each image.

    Images are dealt before they are spread over their pixels, to as many tasks as their number needs,
    so that what follows by image finds an image's pixels together.
    """
    side = int(per_image**0.5)
    ids = images(spark, sf_dir).select(F.col("id").alias("image_id"))
    parts = max(spark.sparkContext.defaultParallelism, -(-ids.count() * side * side // PIXELS))
    # with the session's own number of partitions, Spark takes this for the exchange of the distinct ids and lets tasks be merged
    parts += parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = ids.repartition(parts, "image_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return grid.selectExpr("image_id", "y", "x", "CAST((x * 31 + y * 17 + image_id) % 256 AS INT) AS r", "CAST((x * 13 + y * 29 + image_id * 3) % 256 AS INT) AS g", "CAST((x * 7 + y * 11 + image_id * 5) % 256 AS INT) AS b")


#: DuckDB twins of the above.
SQL = {
    "categories": "categories AS (SELECT count(*) AS id, a.name, CASE WHEN count(*) % 2 = 0 THEN 'even' ELSE 'odd' END AS supercategory FROM (SELECT DISTINCT event_type AS name FROM events) a JOIN (SELECT DISTINCT event_type AS o FROM events) b ON b.o <= a.name GROUP BY a.name)",
    "ann": """ann AS (SELECT *, x0 AS x, y0 AS y, x0 + w AS x1, y0 + h AS y1, w * h AS area,
  [x0, y0 + h * 0.25, x0 + w * 0.25, y0, x0 + w * 0.75, y0, x0 + w, y0 + h * 0.25, x0 + w, y0 + h * 0.75, x0 + w * 0.75, y0 + h, x0 + w * 0.25, y0 + h, x0, y0 + h * 0.75] AS seg
  FROM (SELECT event_id AS id, user_id AS image_id, c.id AS category_id, event_type AS category_name,
  CAST((event_id * 37) % 600 AS DOUBLE) AS x0, CAST((event_id * 53) % 440 AS DOUBLE) AS y0,
  CAST((event_id * 7) % 90 + 1 AS DOUBLE) AS w, CAST((event_id * 11) % 70 + 1 AS DOUBLE) AS h,
  CAST(event_id % 10 = 0 AS INT) AS iscrowd, value AS score, props AS extra
  FROM events JOIN categories c ON c.name = events.event_type))""",
    "images": "images AS (SELECT DISTINCT user_id AS id, CAST(640 + 320 * (user_id % 3) AS INT) AS width, CAST(480 + 240 * (user_id % 2) AS INT) AS height, 'img_' || user_id || '.jpg' AS file_name FROM events)",
    "pixels": """pixels AS (SELECT image_id, y, x, CAST((x * 31 + y * 17 + image_id) % 256 AS INT) AS r, CAST((x * 13 + y * 29 + image_id * 3) % 256 AS INT) AS g, CAST((x * 7 + y * 11 + image_id * 5) % 256 AS INT) AS b
  FROM (SELECT id AS image_id FROM images), (SELECT unnest(range(20)) AS y), (SELECT unnest(range(20)) AS x))""",
}


def sql(body: str, *more: str) -> str:
    """A DuckDB query over the CTEs that its text names; `more` are further CTEs."""
    need = {k for k in SQL if f" {k}" in f" {body} {' '.join(more)}"}
    if "ann" in need:
        need.add("categories")
    if "pixels" in need:
        need.add("images")
    ctes = [SQL[k] for k in SQL if k in need] + list(more)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
