"""Tiles of images by resolution, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def resolutions(images: DataFrame) -> DataFrame:
    return images.select("width", "height").distinct()


def overlap_ratios(resolution: DataFrame, tile_w: int = 640, tile_h: int = 640) -> DataFrame:
    return resolution.withColumns({"ratio_x": F.expr(f"pmod(width, {tile_w}) / {tile_w}"), "ratio_y": F.expr(f"pmod(height, {tile_h}) / {tile_h}")})


def tiles(resolution: DataFrame, tile_w: int | None = None, tile_h: int | None = None) -> DataFrame:
    """(width, height, x1, y1, x2, y2) for rows (width, height, ratio_x, ratio_y): overlapping tiles, shifted at the far edges.

    Overlaps are held within 0 to 0.99. Without a tile size each axis has max(2, int(1 / (1 - o)))
    tiles. A row of tiles ends with the first tile that would pass the right edge: if a whole
    stride is left it is moved back to the edge, else it stays and is cut off. The last row is
    moved up likewise and ends before the first tile that reaches the right edge.
    """
    size = lambda side, o, given: F.lit(given) if given else F.expr(f"greatest(1, CAST({side} / (greatest(2, CAST(1 / (1 - {o}) AS INT)) * (1 - {o})) AS INT))")
    r = resolution.withColumns({"ox": F.expr("least(greatest(ratio_x, 0D), 0.99D)"), "oy": F.expr("least(greatest(ratio_y, 0D), 0.99D)")})
    r = r.withColumns({"tw": size("width", "ox", tile_w).cast("int"), "th": size("height", "oy", tile_h).cast("int")})
    r = r.withColumns({"sx": F.expr("greatest(1, CAST(tw * (1 - ox) AS INT))"), "sy": F.expr("greatest(1, CAST(th * (1 - oy) AS INT))")})

    def starts(side: str, step: str, tile: str) -> F.Column:
        # (start, shifted): every stride below the side; the first that is reached with the edge in the next tile and a stride to spare is replaced and ends the run
        every = f"sequence(0, {side} - 1, {step})"
        shift = f"filter({every}, s -> s + {tile} >= {side} AND s < {side} - {step} AND s > 0)"
        return F.expr(f"IF(size({shift}) = 0, transform({every}, s -> struct(s AS at, false AS moved)), concat(transform(filter({every}, s -> s < {shift}[0]), s -> struct(s AS at, false AS moved)), array(struct(greatest(0, {side} - {tile}) AS at, true AS moved))))")

    r = r.withColumn("ys", starts("height", "sy", "th")).withColumn("xs", starts("width", "sx", "tw"))
    rows = r.withColumn("yy", F.explode("ys")).select("*", F.posexplode("xs").alias("k", "xx"))
    # a moved row ends before the first tile that reaches the right edge, but for its first one
    first = F.expr("array_position(transform(xs, s -> s.at + tw >= width), true) - 1")
    rows = rows.where(~F.col("yy.moved") | (first < 0) | (F.col("k") < first) | (F.col("k") == 0))
    cut = rows.selectExpr("width", "height", "xx.at AS x1", "yy.at AS y1", "least(xx.at + tw, width) AS x2", "least(yy.at + th, height) AS y2")
    return cut.distinct()


def by_resolution(images: DataFrame) -> DataFrame:
    """(width, height, n, ids): the images of each resolution."""
    return images.groupBy("width", "height").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def split_rows(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with the resolution of their image, for one output folder each."""
    return annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")


def stitch_or_split(annotations: DataFrame, low: float, high: float) -> DataFrame:
    """split if all boxes are under low, stitch if all are over high, else mixed; none for no boxes."""
    a = annotations.agg(F.max("w").alias("mw"), F.max("h").alias("mh"), F.min("w").alias("nw"), F.min("h").alias("nh"), F.count("*").alias("n"))
    return a.select(F.when(F.col("n") == 0, "none").when((F.col("mw") < low) & (F.col("mh") < low), "split").when((F.col("nw") > high) & (F.col("nh") > high), "stitch").otherwise("mixed").alias("decision"))


