"""Queries over whole analyses, files and round trips, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clustering, ids
from ..sources import coco, files
from ..sources import views as V
from ..sources.views import sql
from ..storage import shared_folder
from . import analyses
from .annotation_queries import rounded
from .dataset_queries import _GRAY, _LIT, _LUM, FEATURES, _lit_pixels, _vectors

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@query("src01_coco_round_trip", sql("SELECT id, image_id, category_id, area, x, w AS width, iscrowd, len(seg) AS corners, (SELECT count(*) FROM images) AS images, 5 AS categories FROM ann WHERE image_id % 10 = 0"))
def coco_round_trip(spark, sf):
    # a document for each tenth image's annotations, which is what one client would load
    a = V.annotations(spark, sf).where("image_id % 10 = 0").select("id", "image_id", "category_id", "segmentation", "area", "bbox", "iscrowd")
    path = f"{shared_folder(spark, 'document')}.json"
    coco.save_document(path, V.images(spark, sf), a, V.categories(spark, sf))
    d = coco.read_document(spark, path)
    n = d["images"].agg(F.count("*").alias("images")).crossJoin(d["categories"].agg(F.count("*").cast("int").alias("categories")))
    rows = d["annotations"].selectExpr("id", "image_id", "category_id", "area", "bbox[0] AS x", "bbox[2] AS width", "iscrowd", "CAST(size(segmentation[0]) AS BIGINT) AS corners")
    return rows.crossJoin(F.broadcast(n))


@query("joi01_feature_table", sql("SELECT a.id, a.image_id, round(w / h, 9) AS aspect_ratio, w * h AS box_area, round(x / i.width, 9) AS relative_x, round((y + h / 2) / i.height, 9) AS vertical_position FROM ann a JOIN images i ON a.image_id = i.id"))
def feature_table(spark, sf):
    table, _ = analyses.feature_table(V.images(spark, sf), V.annotations(spark, sf))
    return rounded(table.select("id", "image_id", "aspect_ratio", "box_area", "relative_x", "vertical_position"), 9)


@query("prj12_transform_rings", sql("SELECT id, CAST(len(seg) AS INT) AS corners, round(list_min(list_transform(range(1, 17, 2), lambda i: greatest(0, least(seg[i] * 0.5 + seg[i + 1] * 0.125 + 3, 320 - 1)))), 6) AS least_x, round(list_max(list_transform(range(1, 17, 2), lambda i: greatest(0, least(seg[i + 1] * 0.75 - 2, 240 - 1)))), 6) AS largest_y FROM ann"))
def transform_rings(spark, sf):
    m = "array(0.5D, 0.125D, 3D, 0D, 0.75D, -2D, 0D, 0D, 1D)"
    a = V.annotations(spark, sf).withColumn("m", F.expr(m)).select("id", G.transform_ring("m", "segmentation[0]", "320D", "240D").alias("r"))
    even = "filter(r, (v, i) -> i % 2 = {})"
    return rounded(a.selectExpr("id", "size(r) AS corners", f"array_min({even.format(0)}) AS least_x", f"array_max({even.format(1)}) AS largest_y"))


@query("flt03_class_slice", sql("SELECT category_name, count(*) AS n, round(avg(area), 6) AS mean FROM ann WHERE category_id = 2 GROUP BY 1"))
def class_slice(spark, sf):
    wanted = V.categories(spark, sf).where("id = 2").select(F.col("id").alias("category_id"))
    a = coco.of_categories(V.annotations(spark, sf), wanted)
    return rounded(a.groupBy("category_name").agg(F.count("*").alias("n"), F.avg("area").alias("mean")))


@query("snk14_filter_state", sql("SELECT count(*) AS present, count(*) AS found, 200000 AS capacity, count(*) AS items FROM orders"))
def filter_state(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    path, n = shared_folder(spark, "filter"), orders.count()
    ids.bloom_export(ids.bloom_build(orders, "id", 200_000, double=False), path, 200_000, n, double=False)
    bits, about = ids.bloom_import(spark, path)
    hit = ids.bloom_might_contain(orders, "id", bits, about["capacity"], about["rate"], about["double"])
    return hit.agg(F.count("*").alias("present"), F.count_if("might_exist").alias("found")).withColumns({"capacity": F.lit(about["capacity"]).cast("int"), "items": F.lit(about["items"])})


@query("mlo25_image_quality", sql(f"SELECT image_id, round(avg({_LUM}), 8) AS mean, round(avg(({_GRAY} >= 240)::INT) * 100, 8) AS over_pct, CASE WHEN avg(({_GRAY} < 85)::INT) > 0.5 THEN 'shadows-heavy' WHEN avg(({_GRAY} >= 171)::INT) > 0.5 THEN 'highlights-heavy' ELSE 'balanced' END AS tone, (max({_GRAY}) - min({_GRAY}))::DOUBLE AS range_full FROM lit GROUP BY 1", _LIT))
def image_quality(spark, sf):
    return rounded(analyses.image_quality(_lit_pixels(spark, sf)).select("image_id", "mean", "over_pct", "tone", "range_full"), 8)


@query("mlo26_statistics", sql("SELECT category_name, count(*) AS count, round(avg(area), 6) AS mean, round(quantile_cont(area, 0.5), 6) AS p50, round(count(*) FILTER (iscrowd = 1) * 100.0 / count(*), 6) AS crowd_percentage FROM ann GROUP BY 1"))
def statistics(spark, sf):
    found = analyses.annotation_statistics(V.annotations(spark, sf), V.categories(spark, sf), ["area"], ["iscrowd"])
    crowd = found["categorical_iscrowd"].where("iscrowd = 1").select("category_name", F.col("percentage").alias("crowd_percentage"))
    out = found["numerical_area"].select("category_name", "count", "mean", "p50").join(crowd, "category_name", "left").fillna(0.0, ["crowd_percentage"])
    return rounded(out)


@query("ent04_split_files", sql("SELECT i.width, i.height, count(*) AS annotations, count(DISTINCT a.image_id) AS images FROM ann a JOIN images i ON a.image_id = i.id GROUP BY 1, 2"))
def split_files(spark, sf):
    path = shared_folder(spark, "by-resolution")
    analyses.split_by_resolution(V.images(spark, sf), V.annotations(spark, sf).select("id", "image_id", "category_id", "bbox"), path)
    return spark.read.json(f"{path}/annotations").groupBy(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).agg(F.count("*").alias("annotations"), F.count_distinct("image_id").alias("images"))


@query("ent05_density", sql("SELECT 'grid' AS name, count(*)::DOUBLE AS total FROM (SELECT (x + w / 2) / 32 AS cx, (y + h / 2) / 48 AS cy FROM ann) WHERE cx BETWEEN 0 AND 20 AND cy BETWEEN 0 AND 10 UNION ALL SELECT 'sigma_1', count(*)::DOUBLE FROM (SELECT (x + w / 2) / 32 AS cx, (y + h / 2) / 48 AS cy FROM ann) WHERE cx BETWEEN 0 AND 20 AND cy BETWEEN 0 AND 10"))
def density(spark, sf):
    # smoothing with reflected edges keeps the sum
    a = V.annotations(spark, sf).selectExpr("x / 32 AS x", "y / 48 AS y", "w / 32 AS w", "h / 48 AS h")
    found = analyses.density(a, sigmas=(1.0,))
    one = lambda n, c: found[n].agg(F.round(F.sum(c).cast("double"), 3).alias("total")).select(F.lit(n).alias("name"), "total")
    return one("grid", "count").union(one("sigma_1", "density"))


@query("spa05_tile_plan", sql("SELECT width, height, true AS inside, true AS covers_corner FROM (SELECT DISTINCT width, height FROM images)"))
def tile_plan(spark, sf):
    t = analyses.tile_plan(V.images(spark, sf))
    inside = F.bool_and(F.expr("x1 >= 0 AND y1 >= 0 AND x1 < x2 AND y1 < y2 AND x2 <= width AND y2 <= height")).alias("inside")
    return t.groupBy("width", "height").agg(inside, F.bool_or(F.expr("x1 = 0 AND y1 = 0")).alias("covers_corner"))


@query("snk08_keypoint_files", sql("SELECT 'img_' || image_id || '_normalized_keypoints' AS file, count(*) AS n, round(sum(x), 3) AS total_x, sum(id % 256)::BIGINT AS total_descriptor FROM ann GROUP BY 1"))
def keypoint_files(spark, sf):
    path = shared_folder(spark, "keypoints")
    k = V.annotations(spark, sf).selectExpr("concat('img_', image_id) AS image_name", "id AS keypoint_id", "x AS x_coord", "y AS y_coord", "array(id % 256, 7) AS descriptor")
    files.save_keypoints(k, path, descriptors=2)
    back = files.read_keypoints(spark, path)
    return back.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x_coord").cast("double")), 3).alias("total_x"), F.sum(F.col("descriptor_0").cast("long")).alias("total_descriptor"))


@query("mlo04_hierarchical")
def hierarchical(spark, sf):
    x = clustering.scaled(_vectors(spark, sf).drop("label"), FEATURES)
    return clustering.cluster(x, FEATURES, "hierarchical", 5).groupBy("label").agg(F.count("*").alias("n"))
