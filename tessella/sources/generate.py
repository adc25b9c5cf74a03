"""Synthetic annotation data, the same for the same seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area, ring_box


def _share(*parts: str) -> str:
    """SQL text of a number from 0 to 1 that depends on these columns only, so that a repeated task makes the same rows."""
    return f"(pmod(xxhash64({', '.join(parts)}), 1000003) / 1000003D)"


def dataset(spark: SparkSession, images: int, most_polygons: int = 5, categories: int = 4, supercategories: int = 2, width: int = 640, height: int = 480, variation: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    """images, annotations and categories: star-shaped polygons with even, jittered angles inside images of varying size."""
    s = f"{seed}"
    img = spark.range(1, images + 1).selectExpr("id", f"CAST({width} + floor(({_share('id', s, '1')} * 2 - 1) * {variation}) AS INT) AS width", f"CAST({height} + floor(({_share('id', s, '2')} * 2 - 1) * {variation}) AS INT) AS height", "concat('image_', lpad(id, 5, '0'), '.png') AS file_name", "1 AS license", "CAST(NULL AS STRING) AS date_captured")
    each = img.selectExpr("id AS image_id", "width", "height", f"explode(sequence(1, 1 + CAST(floor({_share('id', s, '3')} * {most_polygons}) AS INT))) AS k")
    shape = each.selectExpr("*", f"3 + CAST(floor({_share('image_id', 'k', s, '4')} * 8) AS INT) AS n", f"(0.05D + 0.1D * {_share('image_id', 'k', s, '5')}) * least(width, height) AS radius", f"{_share('image_id', 'k', s, '6')} AS u", f"{_share('image_id', 'k', s, '7')} AS v")
    angle = f"(2 * pi() * (i + 0.4D * {_share('image_id', 'k', 'i', s, '8')}) / n)"
    reach = f"(radius * (0.5D + 0.5D * {_share('image_id', 'k', 'i', s, '9')}))"
    ring = f"flatten(transform(sequence(0, n - 1), i -> array(radius + u * (width - 2 * radius) + {reach} * cos({angle}), radius + v * (height - 2 * radius) + {reach} * sin({angle}))))"
    ann = shape.selectExpr("image_id * 1000 + k AS id", "image_id", f"CAST(1 + floor({_share('image_id', 'k', s, '10')} * {categories}) AS BIGINT) AS category_id", f"{ring} AS ring")
    ann = ann.select("id", "image_id", "category_id", F.array("ring").alias("segmentation"), polygon_area("ring").alias("area"), ring_box("ring").alias("bbox"), F.lit(0).alias("iscrowd"))
    cat = spark.range(1, categories + 1).selectExpr("id", "concat('category_', id) AS name", f"concat('super_', (id - 1) % {supercategories} + 1) AS supercategory")
    return {"images": img, "annotations": ann, "categories": cat}


def expected_annotations(images: int, least: int, most: int) -> float:
    """Images times the mean number of polygons."""
    return images * (least + most) / 2


def nested_rectangles(spark: SparkSession, groups: int, depth: int) -> DataFrame:
    """(id, image_id, x0, y0, x1, y1, area): in each group `depth` boxes, each inside the one before; groups lie apart."""
    r = spark.range(groups).selectExpr("id AS g", f"explode(sequence(0, {depth - 1})) AS d")
    side = 4 * depth
    r = r.selectExpr(f"g * {depth} + d AS id", "0L AS image_id", f"CAST(g * {2 * side} + d AS DOUBLE) AS x0", "CAST(d AS DOUBLE) AS y0", f"CAST(g * {2 * side} + {side} - d AS DOUBLE) AS x1", f"CAST({side} - d AS DOUBLE) AS y1")
    return r.withColumn("area", F.expr("(x1 - x0) * (y1 - y0)"))


def ring_image(size: int = 256, shift: int = 3) -> np.ndarray:
    """Planes red, green, blue of a ring pattern, red and blue shifted apart along x."""
    y, x = np.indices((size, size), float) - size / 2
    plane = lambda dx: np.exp(-((np.hypot(x - dx, y) % 32 - 16) ** 2) / 50)
    return np.stack([plane(shift), plane(0), plane(-shift)])


def apart_shapes() -> dict[str, list[float]]:
    """A rectangle, a right triangle and a hexagon that don't meet, as flat rings."""
    hexagon = [float(v) for a in range(6) for v in (20 + 3 * np.cos(a * np.pi / 3), 5 + 3 * np.sin(a * np.pi / 3))]
    return {"rectangle": [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0], "triangle": [8.0, 0.0, 12.0, 0.0, 8.0, 5.0], "hexagon": hexagon}
