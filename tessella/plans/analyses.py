"""Whole analyses as functions over tables: what the command-line entry points of such tools do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clustering, pixels, stats, tiles
from ..sources import coco


def feature_table(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, list[str]]:
    """Box, segmentation and place features of annotations (with x, y, w, h) whose image is known, and their names."""
    size = images.select(F.col("id").alias("image_id"), "width", "height")
    groups = (G.box_features(), G.segmentation_features(), G.spatial_features())
    columns = {n: c for g in groups for n, c in g.items()}
    # the image's size and the box's width and height share names, so places are computed first
    place = annotations.join(size, "image_id").select("*", *[c.alias(f"_{n}") for n, c in G.spatial_features().items()]).drop("width", "height")
    own = {n: (F.col(f"_{n}") if n in groups[2] else c) for n, c in columns.items()}
    return place.select("id", "image_id", "category_id", *[c.cast("double").alias(n) for n, c in own.items()]), list(columns)


def clustering_analysis(images: DataFrame, annotations: DataFrame, max_k: int = 10, algorithms: tuple[str, ...] = ("kmeans", "gaussian_mixture", "hierarchical")) -> dict[str, DataFrame]:
    """Best clustering of the feature table with its scores, centres, importance, and advice."""
    table, names = feature_table(images, annotations)
    found = clustering.best_k(table, names, algorithms, max_k)
    best = found[0]
    scaled = clustering.scaled(table, names)
    labels = clustering.cluster(scaled, names, best["algorithm"], best["k"]).select("id", "label")
    rows = table.join(labels, "id")
    scores = clustering.importance(rows, names)
    spark = images.sparkSession
    centers = clustering.centers(rows, names)
    return {
        "searched": spark.createDataFrame([(r["algorithm"], r["k"], float(r["silhouette"])) for r in found], "algorithm string, k int, silhouette double"),
        "clustered": rows,
        "indexes": clustering.index_scores(scaled.drop("label").join(labels, "id"), names),
        "centers": centers,
        "importance": scores,
        "distinctive": clustering.distinctive(rows, names),
        "anchors": clustering.anchors(centers.select(F.col("label").alias("id"), F.col("width").alias("w"), F.col("height").alias("h"))),
        "augmentations": clustering.augmentations(scores),
        "hard_features": clustering.hard_features(scores),
    }


def annotation_statistics(annotations: DataFrame, categories: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, DataFrame]:
    """Basics, property profile, category breakdown and one table per property."""
    a = annotations.drop("category_name").join(F.broadcast(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))), "category_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit("Unknown")))
    out = {"basics": stats.basics(a), "profile": stats.profile(a, numeric, categorical), "breakdown": stats.breakdown(a)}
    out |= {f"numerical_{c}": stats.numerical(a, c, "category_name") for c in numeric}
    return out | {f"categorical_{c}": stats.categorical(a, c, "category_name") for c in categorical}


def split_by_resolution(images: DataFrame, annotations: DataFrame, path: str) -> DataFrame:
    """Writes a dataset per resolution below path; returns how many images each has."""
    coco.write_by_resolution(images, annotations, path)
    return tiles.by_resolution(images).select("width", "height", "n")


def tile_plan(images: DataFrame, tile_w: int = 640, tile_h: int = 640) -> DataFrame:
    """Tiles of each resolution, overlapping by what is left over at the edges."""
    return tiles.tiles(tiles.overlap_ratios(tiles.resolutions(images), tile_w, tile_h), tile_w, tile_h)


def density(annotations: DataFrame, options: coco.Options | None = None, sigmas: tuple[float, ...] = (0.5, 1.0, 2.0)) -> dict[str, DataFrame]:
    """The grid of box centres and its smoothed forms."""
    o = options or coco.Options()
    grid = stats.heatmap(annotations.selectExpr("x + w / 2 AS cx", "y + h / 2 AS cy"), o.canvas_width, o.canvas_height, o.bin_size)
    nx, ny = round(o.canvas_width / o.bin_size), round(o.canvas_height / o.bin_size)
    return {"grid": grid} | {f"sigma_{s:g}": stats.smoothed(grid, nx, ny, s) for s in sigmas}


def image_quality(pixel_rows: DataFrame) -> DataFrame:
    """One row per image: luminance, exposure, tones and dynamic range."""
    parts = [pixels.luminance(pixel_rows), pixels.exposure(pixel_rows), pixels.tones(pixel_rows), pixels.dynamic_range(pixel_rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "image_id")
    return out


def result_document(**tables: DataFrame) -> DataFrame:
    """(document): small result tables as one JSON object, each an array of its rows; for reports of a few hundred rows."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in sorted(t.columns)]))).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*tables)).alias("document"))
