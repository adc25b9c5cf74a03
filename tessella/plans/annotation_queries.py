"""Queries over boxes, rings, ids and statistics, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clustering, ids, polygons, rects, stats, tiles
from ..sources import views as V
from ..sources.views import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that the last bits of sums don't matter."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BOX = "width height box_area aspect_ratio center_x center_y perimeter diagonal compactness elongation rectangularity".split()
PLACE = "relative_x relative_y relative_width relative_height relative_area distance_from_center edge_proximity corner_distance_tl corner_distance_br horizontal_position vertical_position".split()
#: Those with roots are rounded; the others are exact quotients.
ROOTS = {n for n in PLACE if "distance" in n}

_BOX_SQL = """w AS width, h AS height, w * h AS box_area, CASE WHEN h > 0 THEN w / h ELSE 0 END AS aspect_ratio, x + w / 2 AS center_x, y + h / 2 AS center_y,
 2 * (w + h) AS perimeter, round(sqrt(w * w + h * h), 6) AS diagonal, round(4 * pi() * w * h / pow(2 * (w + h), 2), 6) AS compactness,
 greatest(w, h) / least(w, h) AS elongation, w * h / pow((w + h) / 2, 2) AS rectangularity"""


def _box(spark: SparkSession, sf: str) -> DataFrame:
    a = V.annotations(spark, sf)
    return a.select("id", "image_id", "category_id", *[c.alias(n) for n, c in G.box_features().items()])


@query("prj01_box_features", sql(f"SELECT id, image_id, category_id, {', '.join(f'round({n}, 6) AS {n}' for n in BOX)} FROM (SELECT id, image_id, category_id, {_BOX_SQL} FROM ann)"))
def box_features(spark, sf):
    return rounded(_box(spark, sf))


_PLACE_SQL = """SELECT a.id, a.image_id, x / width AS relative_x, y / height AS relative_y, w / width AS relative_width, h / height AS relative_height, w * h / (width * height) AS relative_area,
 sqrt(pow(x + w / 2 - width / 2.0, 2) + pow(y + h / 2 - height / 2.0, 2)) / sqrt(width * width + height * height) AS distance_from_center,
 least(x, y, width - (x + w), height - (y + h)) / least(width, height) AS edge_proximity,
 sqrt(pow(x + w / 2, 2) + pow(y + h / 2, 2)) / sqrt(width * width + height * height) AS corner_distance_tl,
 sqrt(pow(width - (x + w / 2), 2) + pow(height - (y + h / 2), 2)) / sqrt(width * width + height * height) AS corner_distance_br,
 (x + w / 2) / width AS horizontal_position, (y + h / 2) / height AS vertical_position
 FROM ann a JOIN images i ON a.image_id = i.id"""


@query("prj05_spatial_features", sql(f"SELECT id, image_id, {', '.join(f'round({n}, 6) AS {n}' if n in ROOTS else n for n in PLACE)} FROM ({_PLACE_SQL})"))
def spatial_features(spark, sf):
    size = V.images(spark, sf).select(F.col("id").alias("image_id"), "width", "height")
    a = V.annotations(spark, sf).join(size, "image_id")
    return a.select("id", "image_id", *[(F.round(c, 6) if n in ROOTS else c).alias(n) for n, c in G.spatial_features().items()])


@query("prj02_segmentation_features", sql("""SELECT id, 8 AS segmentation_points, round(w * h * 0.875, 6) AS segmentation_area, round(1 / 0.875, 6) AS bbox_to_seg_ratio,
 round(w + h + 4 * sqrt(w * w / 16 + h * h / 16), 6) AS segmentation_perimeter,
 round(4 * pi() * w * h * 0.875 / pow(w + h + 4 * sqrt(w * w / 16 + h * h / 16), 2), 6) AS segmentation_circularity FROM ann"""))
def segmentation_features(spark, sf):
    return rounded(V.annotations(spark, sf).select("id", *[c.alias(n) for n, c in G.segmentation_features().items()]))


_AREA = "abs(list_sum([seg[2*i+1]*seg[2*((i+1)%8)+2]-seg[2*((i+1)%8)+1]*seg[2*i+2] for i in range(8)]))/2"


@query("prj03_polygon_area", sql(f"SELECT id, {_AREA} AS polygon_area, round(list_sum([sqrt(pow(seg[2*((i+1)%8)+1]-seg[2*i+1],2)+pow(seg[2*((i+1)%8)+2]-seg[2*i+2],2)) for i in range(8)]), 6) AS polygon_perimeter FROM ann"))
def polygon_area(spark, sf):
    return rounded(V.annotations(spark, sf).select("id", G.polygon_area("segmentation[0]").alias("polygon_area"), G.polygon_perimeter("segmentation[0]").alias("polygon_perimeter")))


@query("prj06_flat_annotations", sql("SELECT id, image_id, category_id, coalesce(category_name, 'Unknown') AS category_name, x, y, w, h, w * h AS box_area, CASE WHEN h > 0 THEN round(w / h, 6) ELSE 0 END AS aspect_ratio, iscrowd, CAST(json_extract(extra, '$.k') AS BIGINT) AS extra_k FROM ann"))
def flat_annotations(spark, sf):
    a = V.annotations(spark, sf).drop("category_name").join(F.broadcast(V.categories(spark, sf).select(F.col("id").alias("category_id"), "name")), "category_id", "left")
    return a.select("id", "image_id", "category_id", F.coalesce("name", F.lit("Unknown")).alias("category_name"), "x", "y", "w", "h", F.expr("w * h").alias("box_area"), F.expr("IF(h > 0, round(w / h, 6), 0D)").alias("aspect_ratio"), "iscrowd", F.expr("try_variant_get(try_parse_json(extra), '$.k', 'bigint')").alias("extra_k"))


@query("prj07_centers_normalized", sql("SELECT id, (x + x1) / 2 AS cx, (y + y1) / 2 AS cy, least(x, x1) AS x0, least(y, y1) AS y0, greatest(x, x1) AS x1, greatest(y, y1) AS y1 FROM ann"))
def centers_normalized(spark, sf):
    swapped = V.rects(spark, sf).select("id", F.col("x1").alias("a0"), F.col("y1").alias("b0"), F.col("x0").alias("a1"), F.col("y0").alias("b1"))
    return swapped.select("id", F.expr("(a0 + a1) / 2").alias("cx"), F.expr("(b0 + b1) / 2").alias("cy"), *[c.alias(n) for n, c in G.normalized_rect("a0", "b0", "a1", "b1").items()])


_M = "array(1.1D, 0.05D, 3D, -0.02D, 0.95D, 5D, 0.0001D, 0D, 1D)"


def _pt(x: str, y: str) -> tuple[str, str]:
    d = f"(0.0001 * ({x}) + 1)"
    return f"((1.1 * ({x}) + 0.05 * ({y}) + 3) / {d})", f"((-0.02 * ({x}) + 0.95 * ({y}) + 5) / {d})"


def _hull_sql() -> str:
    pts = [_pt(cx, cy) for cx in ("x", "x1") for cy in ("y", "y1")]
    xs = ", ".join(f"greatest(0, least({p[0]}, 639))" for p in pts)
    ys = ", ".join(f"greatest(0, least({p[1]}, 479))" for p in pts)
    return f"SELECT id, least({xs}) AS ax, least({ys}) AS ay, greatest({xs}) AS bx, greatest({ys}) AS b_y FROM ann"


@query("prj11_transform_boxes", sql(f"SELECT id, round(ax, 6) AS nx, round(ay, 6) AS ny, round(bx - ax, 6) AS nw, round(b_y - ay, 6) AS nh FROM ({_hull_sql()}) WHERE bx - ax > 1 AND b_y - ay > 1"))
def transform_boxes(spark, sf):
    a = V.annotations(spark, sf).withColumn("m", F.expr(_M)).withColumn("b", G.transform_box("m", "640D", "480D")).where("b IS NOT NULL")
    return rounded(a.selectExpr("id", "b[0] AS nx", "b[1] AS ny", "b[2] AS nw", "b[3] AS nh"))


@query("prj14_transform_keypoints", sql(f"SELECT id, round(greatest(0, least({_pt('x', 'y')[0]}, 639)), 6) AS kx, round(greatest(0, least({_pt('x', 'y')[1]}, 479)), 6) AS ky, 2.0::DOUBLE AS kv, x1 AS hx, y1 AS hy, 0.0::DOUBLE AS hv FROM ann"))
def transform_keypoints(spark, sf):
    a = V.annotations(spark, sf).withColumn("m", F.expr(_M)).withColumn("p", F.expr("array(x, y, 2D, x + w, y + h, 0D)")).withColumn("k", G.transform_keypoints("m", "p", "640D", "480D"))
    return rounded(a.selectExpr("id", "k[0] AS kx", "k[1] AS ky", "k[2] AS kv", "k[3] AS hx", "k[4] AS hy", "k[5] AS hv"))


@query("prj15_ring_box", sql("SELECT id, x AS bx, y AS by, w AS bw, h AS bh FROM ann"))
def ring_box(spark, sf):
    return V.annotations(spark, sf).withColumn("b", G.ring_box("segmentation[0]")).selectExpr("id", "b[0] AS bx", "b[1] AS by", "b[2] AS bw", "b[3] AS bh")


@query("prj17_overlap_ratios", sql("SELECT DISTINCT width, height, (width % 640) / 640.0::DOUBLE AS ratio_x, (height % 640) / 640.0::DOUBLE AS ratio_y FROM images"))
def overlap_ratios(spark, sf):
    return tiles.overlap_ratios(tiles.resolutions(V.images(spark, sf)))


@query("prj18_fractions", sql("SELECT id, round(CASE WHEN id % 4 = 0 THEN (id % 7 + 1) / 10.0 WHEN id % 4 = 1 THEN 1 + (id % 7 + 1) / 10.0 WHEN id % 4 = 2 THEN -(id % 7 + 1) END, 6)::DOUBLE AS value FROM ann"))
def fractions(spark, sf):
    text = F.expr("CASE id % 4 WHEN 0 THEN concat(id % 7 + 1, '/10') WHEN 1 THEN concat('1 ', id % 7 + 1, '/10') WHEN 2 THEN concat('-', id % 7 + 1) ELSE 'n/a' END")
    return rounded(V.annotations(spark, sf).select("id", text.alias("s")).select("id", G.fraction("s").alias("value")))


@query("prj19_values", sql("SELECT id, CASE WHEN id % 3 = 0 THEN id / 4.0::DOUBLE WHEN id % 3 = 1 THEN NULL ELSE -5.0::DOUBLE END AS number, CASE WHEN id % 3 = 1 THEN 'v' || id END AS words FROM ann"))
def values(spark, sf):
    a = V.annotations(spark, sf).select("id", F.expr("CASE id % 3 WHEN 0 THEN CAST(CAST(id / 4D AS DECIMAL(20, 2)) AS STRING) WHEN 1 THEN concat('v', id) ELSE '-5' END").alias("s"))
    n, t = G.number_or_text("s")
    return a.select("id", n.alias("number"), t.alias("words"))


@query("prj20_clean_names", sql("SELECT id, CAST(id AS VARCHAR) AS model, 'b' || id AS make FROM ann"))
def clean_names(spark, sf):
    from ..sources.coco import clean_names as clean

    m = V.annotations(spark, sf).selectExpr("id", "map('tiff:Model', CAST(id AS STRING), 'a:Make', 'old', 'exif:Make', concat('b', id)) AS metadata")
    return m.withColumn("c", clean()).selectExpr("id", "c['Model'] AS model", "c['Make'] AS make")


@query("prj23_turns", sql("SELECT id, CAST(sign(w * h - 3 * (x - y)) AS INT) AS turn FROM ann"))
def turns(spark, sf):
    a = V.annotations(spark, sf).selectExpr("id", "0D AS ax", "0D AS ay", "w AS bx", "3D AS by", "x - y AS cx", "h AS cy")
    return a.select("id", F.signum(G.turn("ax", "ay", "bx", "by", "cx", "cy")).cast("int").alias("turn"))


@query("prj24_polar", sql("SELECT a.image_id, a.id, round(atan2(a.y - p.y, a.x - p.x), 6) AS angle, pow(a.x - p.x, 2) + pow(a.y - p.y, 2) AS d2 FROM ann a JOIN (SELECT image_id, x, y FROM ann QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY y, x) = 1) p ON a.image_id = p.image_id"))
def polar(spark, sf):
    a = V.annotations(spark, sf)
    p = a.groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("p"))
    return rounded(a.join(p, "image_id").selectExpr("image_id", "id", "atan2(y - p.y, x - p.x) AS angle", "power(x - p.x, 2) + power(y - p.y, 2) AS d2"))


@query("prj25_segment_y", sql("SELECT id, round(y + h * 0.25, 6) AS y_at FROM ann"))
def segment_y(spark, sf):
    a = V.annotations(spark, sf).selectExpr("id", "x + w AS sx", "y + h AS sy", "x AS tx", "y AS ty", "x + w * 0.25 AS at")
    return rounded(a.select("id", G.segment_y("at").alias("y_at")))


@query("prj27_rotations", sql("SELECT id, -y + 1 AS px, x + 2 AS py, w + 3 AS pz FROM ann"))
def rotations(spark, sf):
    a = V.annotations(spark, sf).withColumn("r", F.expr("array(0D, 1D, 0D, -1D, 0D, 0D, 0D, 0D, 1D)"))
    px, py, pz = G.rotate(("x", "y", "w"), "r")
    return a.select("id", (px + 1).alias("px"), (py + 2).alias("py"), (pz + 3).alias("pz"))


@query("prj28_ring_points", sql("SELECT id, unnest(range(8)) AS k, seg[2 * unnest(range(8)) + 1] AS px, seg[2 * unnest(range(8)) + 2] AS py FROM ann"))
def ring_points(spark, sf):
    a = V.annotations(spark, sf).select("id", F.posexplode(G.ring_points("segmentation")[0]).alias("k", "p"))
    return a.select("id", F.col("k").cast("long").alias("k"), "p.x", "p.y").toDF("id", "k", "px", "py")


@query("flt01_by_category", sql("SELECT id, category_id FROM ann WHERE category_id IN (1, 3)"))
def by_category(spark, sf):
    from ..sources.coco import of_categories

    return of_categories(V.annotations(spark, sf), V.categories(spark, sf).where("id IN (1, 3)").select(F.col("id").alias("category_id"))).select("id", "category_id")


@query("flt02_by_image", sql("SELECT id, image_id FROM ann WHERE image_id % 5 = 0"))
def by_image(spark, sf):
    wanted = V.images(spark, sf).where("id % 5 = 0").select(F.col("id").alias("image_id"))
    return V.annotations(spark, sf).join(wanted, "image_id", "left_semi").select("id", "image_id")


@query("flt08_window", sql("SELECT id FROM ann WHERE x1 >= 100 AND x <= 500 AND y1 >= 100 AND y <= 400"))
def window(spark, sf):
    return V.rects(spark, sf).where("x1 >= 100 AND x0 <= 500 AND y1 >= 100 AND y0 <= 400").select("id")


_RAY = "(seg[2*i+2] > cy) <> (seg[2*((i+1)%8)+2] > cy) AND cx < (seg[2*((i+1)%8)+1] - seg[2*i+1]) * (cy - seg[2*i+2]) / nullif(seg[2*((i+1)%8)+2] - seg[2*i+2], 0) + seg[2*i+1]"


@query("flt09_point_in_ring", sql(f"SELECT id, len([1 for i in range(8) if coalesce({_RAY}, false)]) % 2 = 1 AS inside FROM (SELECT *, x + w * 0.13 AS cx, y + h * 0.11 AS cy FROM ann)"))
def point_in_ring(spark, sf):
    a = V.annotations(spark, sf).withColumns({"px": F.expr("x + w * 0.13D"), "py": F.expr("y + h * 0.11D"), "ring": F.col("segmentation")[0]})
    return a.select("id", G.point_in_ring("px", "py", "ring").alias("inside"))


_PAIR = "FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.x < b.x1 AND b.x < a.x1 AND a.y < b.y1 AND b.y < a.y1"


@query("joi04_overlaps_between", sql(f"SELECT a.image_id, a.id AS a_id, b.id AS b_id, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 {_PAIR} WHERE a.id % 2 = 0 AND b.id % 2 = 1"))
def overlaps_between(spark, sf):
    r = V.rects(spark, sf)
    return rects.overlap_pairs(r.where("id % 2 = 0"), r.where("id % 2 = 1"))


@query("joi07_self_overlaps", sql(f"SELECT a.image_id, a.id AS a_id, b.id AS b_id, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 {_PAIR} WHERE a.id < b.id"))
def self_overlaps(spark, sf):
    return rects.self_overlaps(V.rects(spark, sf))


@query("joi08_nested_ordered", sql("SELECT o.image_id, o.id AS outer_id, r.id AS inner_id FROM ann o JOIN ann r ON o.image_id = r.image_id WHERE (o.x, o.y, o.id) < (r.x, r.y, r.id) AND o.y <= r.y AND r.y1 <= o.y1 AND (r.x1, r.y, r.id) < (o.x1, o.y, o.id)"))
def nested_ordered(spark, sf):
    return rects.nested(V.rects(spark, sf))


@query("joi08_nested_closed", sql("SELECT o.image_id, o.id AS outer_id, r.id AS inner_id FROM ann o JOIN ann r ON o.image_id = r.image_id AND o.id <> r.id WHERE r.x >= o.x AND r.y >= o.y AND r.x1 <= o.x1 AND r.y1 <= o.y1 AND (NOT (r.x = o.x AND r.y = o.y AND r.x1 = o.x1 AND r.y1 = o.y1) OR o.id < r.id)"))
def nested_closed(spark, sf):
    return rects.nested(V.rects(spark, sf), ordered=False)


@query("joi09_coverage_cells", sql("""SELECT x.image_id, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1, count(*) AS n
 FROM xs x JOIN ys y ON x.image_id = y.image_id JOIN ann a ON a.image_id = x.image_id AND a.x < cx1 AND cx0 < a.x1 AND a.y < cy1 AND cy0 < a.y1
 WHERE cx1 IS NOT NULL AND cy1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
 "xs AS (SELECT image_id, v AS cx0, lead(v) OVER (PARTITION BY image_id ORDER BY v) AS cx1 FROM (SELECT image_id, x AS v FROM ann UNION SELECT image_id, x1 FROM ann))",
 "ys AS (SELECT image_id, v AS cy0, lead(v) OVER (PARTITION BY image_id ORDER BY v) AS cy1 FROM (SELECT image_id, y AS v FROM ann UNION SELECT image_id, y1 FROM ann))"))
def coverage_cells(spark, sf):
    return rects.coverage_cells(V.rects(spark, sf))


_TILE_CTE = "tile AS (SELECT DISTINCT width, height, tx0, ty0, least(tx0 + 320, width) AS tx1, least(ty0 + 240, height) AS ty1 FROM images, (SELECT unnest(range(0, 1280, 320)) AS tx0), (SELECT unnest(range(0, 720, 240)) AS ty0) WHERE tx0 < width AND ty0 < height)"


@query("joi10_tile_crossings", sql(f"""SELECT image_id, tile_id, box_id, CASE WHEN v AND hz THEN 'both' WHEN v THEN 'vertical' ELSE 'horizontal' END AS kind,
 concat_ws(',', CASE WHEN l THEN 'left' END, CASE WHEN r THEN 'right' END, CASE WHEN up THEN 'top' END, CASE WHEN low THEN 'bottom' END) AS boundaries
 FROM (SELECT a.image_id, t.tx0 * 10000 + t.ty0 AS tile_id, a.id AS box_id, x < tx0 AND x1 > tx0 AS l, x < tx1 AND x1 > tx1 AS r, y < ty0 AND y1 > ty0 AS up, y < ty1 AND y1 > ty1 AS low, l OR r AS v, up OR low AS hz
 FROM ann a JOIN images i ON a.image_id = i.id JOIN tile t ON i.width = t.width AND i.height = t.height
 WHERE x < tx1 AND tx0 < x1 AND y < ty1 AND ty0 < y1 AND NOT (x >= tx0 AND y >= ty0 AND x1 <= tx1 AND y1 <= ty1))""", _TILE_CTE))
def tile_crossings(spark, sf):
    img = V.images(spark, sf)
    grid = tiles.resolutions(img).withColumn("a", F.explode(F.expr("sequence(0, width - 1, 320)"))).withColumn("b", F.explode(F.expr("sequence(0, height - 1, 240)")))
    grid = grid.selectExpr("width", "height", "CAST(a * 10000 + b AS BIGINT) AS id", "a AS x0", "b AS y0", "least(a + 320, width) AS x1", "least(b + 240, height) AS y1")
    box = V.rects(spark, sf).join(img.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    found = rects.tile_crossings(grid, box, ["width", "height"])
    return found.join(box.select(F.col("id").alias("box_id"), "image_id"), "box_id").select("image_id", "tile_id", "box_id", "kind", F.array_join("boundaries", ",").alias("boundaries"))


@query("joi15_images_without_annotations", sql("SELECT c.c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"))
def images_without(spark, sf):
    images = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return ids.without_annotations(images, V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("image_id")))


@query("joi16_rewrite_refs", sql("SELECT id, CASE WHEN image_id % 3 = 0 THEN image_id + 1000000 ELSE image_id END AS image_id FROM ann"))
def rewrite_refs(spark, sf):
    m = V.images(spark, sf).where("id % 3 = 0").selectExpr("id AS old_id", "id + 1000000 AS new_id")
    return ids.rewrite_refs(V.annotations(spark, sf).select("id", "image_id"), "image_id", m)


@query("joi17_self_intersections", sql("SELECT id, id % 2 = 1 AS intersects, CASE WHEN id % 2 = 1 THEN x + w / 2 END AS px, CASE WHEN id % 2 = 1 THEN y + h / 2 END AS py FROM ann"))
def self_intersections(spark, sf):
    # every second ring is a bow tie, the others are the boxes
    ring = F.expr("IF(id % 2 = 1, array(x, y, x + w, y + h, x + w, y, x, y + h), array(x, y, x + w, y, x + w, y + h, x, y + h))")
    return rounded(polygons.self_intersections(V.annotations(spark, sf).select("id", ring.alias("ring"))))


def _num(cat: str = "category_name", prop: str = "area") -> str:
    return f"SELECT {cat}, count(*) AS count, round(avg({prop}), 6) AS mean, round(stddev_samp({prop}), 6) AS std, min({prop}) AS min, max({prop}) AS max, round(quantile_cont({prop}, 0.25), 6) AS p25, round(quantile_cont({prop}, 0.5), 6) AS p50, round(quantile_cont({prop}, 0.75), 6) AS p75 FROM ann GROUP BY {cat}"


@query("entry_feature_stats", sql("SELECT category_id, count(*) AS n, round(avg(w / h), 6) AS mean_aspect, round(avg(relative_area), 6) AS mean_relative_area, round(quantile_cont(distance_from_center, 0.5), 6) AS median_distance FROM (SELECT p.*, a.category_id, a.w, a.h FROM ann a JOIN (" + _PLACE_SQL + ") p ON p.id = a.id) GROUP BY category_id"))
def entry_feature_stats(spark, sf):
    size = V.images(spark, sf).select(F.col("id").alias("image_id"), "width", "height")
    a = V.annotations(spark, sf).join(size, "image_id")
    place = G.spatial_features()
    x = a.select("category_id", G.box_features()["aspect_ratio"].alias("r"), place["relative_area"].alias("a"), place["distance_from_center"].alias("d"))
    means = x.groupBy("category_id").agg(F.count("*").alias("n"), F.avg("r").alias("mean_aspect"), F.avg("a").alias("mean_relative_area"))
    return rounded(means.join(stats.quantiles(x, ["category_id"], "d", [0.5]).toDF("category_id", "median_distance"), "category_id"))


@query("agg01_categorical", sql("SELECT category_name, iscrowd, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY category_name), 6) AS percentage FROM ann GROUP BY category_name, iscrowd"))
def categorical(spark, sf):
    return rounded(stats.categorical(V.annotations(spark, sf), "iscrowd", "category_name"))


@query("agg02_numerical", sql(_num()))
def numerical(spark, sf):
    return rounded(stats.numerical(V.annotations(spark, sf), "area", "category_name"))


@query("agg02_lineitem", "SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY 1")
def numerical_lineitem(spark, sf):
    return rounded(stats.numerical(V.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag").withColumn("std", F.round("std", 4)))


@query("agg04_basics", sql("SELECT count(*) AS annotations, count(DISTINCT category_id) AS categories, count(DISTINCT image_id) AS images, round(count(*) / count(DISTINCT image_id), 6) AS per_image FROM ann"))
def basics(spark, sf):
    return rounded(stats.basics(V.annotations(spark, sf)))


def _prof(c: str, num: bool) -> str:
    if num:
        return f"SELECT '{c}' AS property, 'numerical' AS kind, count({c}) AS filled, count(*) - count({c}) AS missing, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, NULL::BIGINT AS distinct_values, NULL::VARCHAR AS commonest, round(count({c}) * 100.0 / count(*), 6)::DOUBLE AS fill_rate FROM ann"
    return f"SELECT '{c}' AS property, 'categorical' AS kind, count({c}) AS filled, count(*) - count({c}) AS missing, NULL AS min, NULL AS max, NULL AS mean, NULL AS std, count(DISTINCT {c}) AS distinct_values, (SELECT {c}::VARCHAR FROM ann WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS commonest, 100.0::DOUBLE AS fill_rate FROM ann"


@query("agg05_profile", sql(" UNION ALL ".join([_prof("area", True), _prof("w", True), _prof("category_name", False), _prof("iscrowd", False)])))
def profile(spark, sf):
    return rounded(stats.profile(V.annotations(spark, sf), ["area", "w"], ["category_name", "iscrowd"]))


@query("agg06_breakdown", sql("SELECT category_name, count(*) AS count, round(avg(area), 6) AS mean_area, round(avg(w / h), 6) AS mean_aspect, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM ann GROUP BY 1"))
def breakdown(spark, sf):
    return rounded(stats.breakdown(V.annotations(spark, sf)))


@query("agg07_category_counts", sql("SELECT category_id, count(*) AS count FROM ann GROUP BY 1"))
def category_counts(spark, sf):
    return V.annotations(spark, sf).groupBy("category_id").agg(F.count("*").alias("count"))


@query("agg08_per_image", sql("SELECT image_id, count(*) AS count FROM ann GROUP BY 1"))
def per_image(spark, sf):
    return V.annotations(spark, sf).groupBy("image_id").agg(F.count("*").alias("count"))


@query("agg09_area_stats", sql("SELECT count(area) AS count, min(area) AS min, max(area) AS max, round(avg(area), 6) AS mean FROM ann"))
def area_stats(spark, sf):
    return rounded(V.annotations(spark, sf).agg(F.count("area").alias("count"), F.min("area").alias("min"), F.max("area").alias("max"), F.avg("area").alias("mean")))


def _sum(n: str, t: str, c: str) -> str:
    return f"SELECT '{n}' AS name, count(*) AS count, count(DISTINCT {c}) AS distinct_ids, min({c}) AS min_id, max({c}) AS max_id, count(*) = count(DISTINCT {c}) AS \"unique\" FROM {t}"


@query("agg10_id_summary", sql(" UNION ALL ".join([_sum("annotations", "ann", "id"), _sum("images", "images", "id"), _sum("lines", "lineitem", "l_orderkey")])))
def id_summary(spark, sf):
    return ids.summary(annotations=V.annotations(spark, sf), images=V.images(spark, sf), lines=V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("agg12_duplicates", "SELECT l_orderkey AS id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return ids.duplicates(V.table(spark, sf, "lineitem"), "l_orderkey")


@query("agg13_name_map", "SELECT user_id AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY 1")
def name_map(spark, sf):
    return ids.name_map(V.table(spark, sf, "events").selectExpr("user_id AS id", "event_type AS name", "event_id AS pos"), "pos")


@query("agg14_discover", "SELECT 'k' AS property, 'numerical' AS kind, 'BIGINT' AS types UNION ALL SELECT 'flag', 'boolean', 'BOOLEAN' UNION ALL SELECT 'name', 'categorical', 'STRING' UNION ALL SELECT 'bbox', 'list', 'ARRAY<DECIMAL(2,1)>'")
def discover(spark, sf):
    raw = V.table(spark, sf, "events").selectExpr("event_id AS id", """concat('{"k": ', event_id, ', "flag": true, "name": "', event_type, '", "bbox": [1.5, 2.5]}') AS raw""")
    return stats.discover_properties(raw)


@query("agg15_value_counts", sql("SELECT category_name, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, category_name) AS rank FROM ann GROUP BY 1"))
def value_counts(spark, sf):
    n = V.annotations(spark, sf).groupBy("category_name").agg(F.count("*").alias("count"))
    return ids.running_number(n.withColumn("_d", -F.col("count")), ["_d", "category_name"], "rank").select("category_name", "count", F.col("rank").cast("long").alias("rank"))


@query("agg16_shares_of_known", sql("SELECT category_name, big, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY category_name), 6) AS percentage FROM (SELECT category_name, CASE WHEN id % 7 > 0 THEN area > 1000 END AS big FROM ann) WHERE big IS NOT NULL GROUP BY category_name, big"))
def shares_of_known(spark, sf):
    a = V.annotations(spark, sf).withColumn("big", F.expr("IF(id % 7 > 0, area > 1000, NULL)"))
    return rounded(stats.shares_of_known(a, "big", "category_name"))


@query("agg18_histogram", sql("SELECT CAST(least(floor((area - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS count FROM ann, (SELECT min(area) AS lo, max(area) AS hi FROM ann) GROUP BY 1"))
def histogram(spark, sf):
    return stats.histogram(V.annotations(spark, sf), "area", 30).select("bin", "count")


_HEAT = "SELECT CAST(i % 40 AS INT) AS bx, CAST(i // 40 AS INT) AS by, count(id) AS count FROM (SELECT unnest(range(800)) AS i) LEFT JOIN (SELECT id, least(floor(cx / 0.5), 39) + 40 * least(floor(cy / 0.5), 19) AS cell FROM (SELECT id, (x + w / 2) / 32 AS cx, (y + h / 2) / 48 AS cy FROM ann) WHERE cx BETWEEN 0 AND 20 AND cy BETWEEN 0 AND 10) ON i = cell GROUP BY i"


@query("agg20_heatmap", sql(_HEAT))
def heatmap(spark, sf):
    return stats.heatmap(V.annotations(spark, sf).selectExpr("(x + w / 2) / 32 AS cx", "(y + h / 2) / 48 AS cy"))


@query("agg21_smoothed", sql("""SELECT t.bx, t.y AS by, round(sum(g.n * kx.w * ky.w), 6) AS density FROM grid t JOIN k kx ON true JOIN k ky ON true
 JOIN grid g ON g.bx = CASE WHEN (t.bx + kx.d + 80) % 80 < 40 THEN (t.bx + kx.d + 80) % 80 ELSE 79 - (t.bx + kx.d + 80) % 80 END AND g.y = CASE WHEN (t.y + ky.d + 40) % 40 < 20 THEN (t.y + ky.d + 40) % 40 ELSE 39 - (t.y + ky.d + 40) % 40 END GROUP BY 1, 2""",
 "k AS (SELECT d, exp(-d * d / 2.0) / sum(exp(-d * d / 2.0)) OVER () AS w FROM (SELECT unnest(generate_series(-4, 4)) AS d))", f"grid AS (SELECT h.* FROM ({_HEAT}) AS h(bx, y, n))"))
def smoothed(spark, sf):
    return rounded(stats.smoothed(heatmap(spark, sf), 40, 20, 1.0))


FEATURES = [f"f{i}" for i in range(64)]


@query("agg30_centers", "SELECT label, count(*) AS n, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS {f}" for i, f in enumerate(FEATURES)) + " FROM embeddings GROUP BY 1")
def label_centers(spark, sf):
    return rounded(clustering.centers(_vectors(spark, sf, 64), FEATURES))


def _vectors(spark, sf, n):
    return V.table(spark, sf, "embeddings").selectExpr("vec_id AS id", "CAST(label AS INT) AS label", *[f"CAST(embedding[{i}] AS DOUBLE) AS f{i}" for i in range(n)])


@query("agg32_top_categories", sql("SELECT label, category_name, count, rank FROM (SELECT image_id % 8 AS label, category_name, count(*) AS count, row_number() OVER (PARTITION BY image_id % 8 ORDER BY count(*) DESC, category_name) AS rank FROM ann GROUP BY image_id % 8, category_name) WHERE rank <= 3"))
def top_categories(spark, sf):
    out = clustering.top_categories(V.annotations(spark, sf).withColumn("label", F.expr("image_id % 8")))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("agg33_distinctive", sql("""SELECT label, feature, round(difference, 6) AS difference FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY difference DESC, feature) AS n FROM (
 SELECT label, 'w' AS feature, abs((avg(w) - g.mw) / abs(g.mw)) AS difference FROM t, (SELECT avg(w) AS mw FROM t) g GROUP BY label, g.mw UNION ALL
 SELECT label, 'h', abs((avg(h) - g.mh) / abs(g.mh)) FROM t, (SELECT avg(h) AS mh FROM t) g GROUP BY label, g.mh UNION ALL
 SELECT label, 'area', abs((avg(area) - g.ma) / abs(g.ma)) FROM t, (SELECT avg(area) AS ma FROM t) g GROUP BY label, g.ma UNION ALL
 SELECT label, 'x', abs((avg(x) - g.mx) / abs(g.mx)) FROM t, (SELECT avg(x) AS mx FROM t) g GROUP BY label, g.mx)) WHERE n <= 3""", "t AS (SELECT *, image_id % 8 AS label FROM ann)"))
def distinctive(spark, sf):
    return rounded(clustering.distinctive(V.annotations(spark, sf).withColumn("label", F.expr("image_id % 8")), ["w", "h", "area", "x"]))


@query("agg35_smaller_members", sql("SELECT id FROM (SELECT a.id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, a.id DESC) AS n FROM ann a) WHERE n > 1"))
def smaller_members(spark, sf):
    r = V.rects(spark, sf)
    return rects.smaller_members(r, r.select("id", F.col("image_id").alias("component")))


@query("agg36_by_resolution", sql("SELECT width, height, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM images GROUP BY ALL"))
def by_resolution(spark, sf):
    out = tiles.by_resolution(V.images(spark, sf))
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("agg37_mean_variances", "SELECT 'f' || i AS feature, round(var_pop(v), 9) AS variance FROM (SELECT label, i, avg(f) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS f, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def mean_variances(spark, sf):
    return rounded(clustering.mean_variances(_vectors(spark, sf, 64), FEATURES), 9)


@query("ord01_top_n", sql("SELECT id, area FROM ann ORDER BY area DESC, id LIMIT 10"))
def top_n(spark, sf):
    return V.annotations(spark, sf).orderBy(F.desc("area"), "id").limit(10).select("id", "area")


@query("ord04_pivot", sql("SELECT image_id, x, y FROM ann QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY y, x) = 1"))
def pivot(spark, sf):
    return V.annotations(spark, sf).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("p")).select("image_id", "p.x", "p.y")


@query("ord07_collinear", sql("SELECT image_id, id FROM (SELECT image_id, id, angle, lead(angle) OVER (PARTITION BY image_id ORDER BY angle, d2) AS nx FROM (SELECT image_id, id, CAST(id % 13 AS DOUBLE) AS angle, CAST(id AS DOUBLE) AS d2 FROM ann)) WHERE nx IS NULL OR nx - angle >= 1e-10"))
def collinear(spark, sf):
    a = V.annotations(spark, sf).selectExpr("image_id", "id", "CAST(id % 13 AS DOUBLE) AS angle", "CAST(id AS DOUBLE) AS d2")
    return polygons.collinear_filtered(a, "image_id").select("image_id", "id")


@query("ord08_anchors", sql("SELECT CAST(i AS INT) AS rank, kept[i].w AS w, kept[i].h AS h FROM (SELECT kept, unnest(generate_series(1, least(6, len(kept)))) AS i FROM (SELECT kept FROM r ORDER BY n DESC LIMIT 1))",
 "b AS (SELECT row_number() OVER (ORDER BY w * h DESC, id) AS n, w, h FROM (SELECT image_id % 12 AS id, max(w) AS w, max(h) AS h FROM ann GROUP BY 1))",
 "r AS (SELECT 0::BIGINT AS n, CAST([] AS STRUCT(w DOUBLE, h DOUBLE)[]) AS kept UNION ALL SELECT b.n, CASE WHEN len(list_filter(kept, lambda k: abs(b.w - k.w) <= 1e-8 + 0.1 * abs(k.w) AND abs(b.h - k.h) <= 1e-8 + 0.1 * abs(k.h))) > 0 THEN kept ELSE list_append(kept, {'w': b.w, 'h': b.h}) END FROM r JOIN b ON b.n = r.n + 1)"))
def anchor_boxes(spark, sf):
    c = V.annotations(spark, sf).groupBy(F.expr("image_id % 12").alias("id")).agg(F.max("w").alias("w"), F.max("h").alias("h"))
    return clustering.anchors(c)


@query("set03_invalid_ids", sql("SELECT DISTINCT inner_id AS id FROM (SELECT r.id AS inner_id FROM ann o JOIN ann r ON o.image_id = r.image_id WHERE (o.x, o.y, o.id) < (r.x, r.y, r.id) AND o.y <= r.y AND r.y1 <= o.y1 AND (r.x1, r.y, r.id) < (o.x1, o.y, o.id) UNION ALL SELECT id FROM (SELECT a.id, row_number() OVER (PARTITION BY c ORDER BY area DESC, a.id DESC) AS n FROM ann a JOIN comp ON a.id = comp.u) WHERE n > 1)",
 "e AS (SELECT a.id AS u, b.id AS v FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.id <> b.id AND a.x < b.x1 AND b.x < a.x1 AND a.y < b.y1 AND b.y < a.y1)",
 "walk AS (SELECT DISTINCT u, u AS r FROM e UNION SELECT w.u, e.v FROM walk w JOIN e ON w.r = e.u)", "comp AS (SELECT u, min(r) AS c FROM walk GROUP BY u)"))
def invalid_ids(spark, sf):
    r = V.rects(spark, sf)
    groups = rects.overlap_groups(rects.self_overlaps(r), by="image_id")
    return rects.smaller_members(r, groups).union(rects.nested(r).select("inner_id")).distinct().toDF("id")


@query("set07_overlap_groups", sql("SELECT u AS id, c AS component FROM comp",
 "e AS (SELECT a.id AS u, b.id AS v FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.id <> b.id AND a.x < b.x1 AND b.x < a.x1 AND a.y < b.y1 AND b.y < a.y1)",
 "walk AS (SELECT DISTINCT u, u AS r FROM e UNION SELECT w.u, e.v FROM walk w JOIN e ON w.r = e.u)", "comp AS (SELECT u, min(r) AS c FROM walk GROUP BY u)"))
def overlap_groups(spark, sf):
    return rects.overlap_groups(rects.self_overlaps(V.rects(spark, sf)), by="image_id")


@query("set04_union_keypoints", sql("SELECT 'norm' AS source, id, x / width AS px, y / height AS py FROM ann a JOIN (SELECT id AS iid, width, height FROM images) i ON a.image_id = iid UNION ALL SELECT 'orig', id, x, y FROM ann"))
def union_keypoints(spark, sf):
    a = V.annotations(spark, sf)
    n = a.join(V.images(spark, sf).select(F.col("id").alias("image_id"), "width", "height"), "image_id").selectExpr("'norm' AS source", "id", "x / width AS px", "y / height AS py")
    return n.unionByName(a.selectExpr("'orig' AS source", "id", "x AS px", "y AS py"))


@query("win01_group_share", sql("SELECT id, round(area / sum(area) OVER (PARTITION BY image_id), 6) AS share FROM ann"))
def group_share(spark, sf):
    return rounded(V.annotations(spark, sf).select("id", (F.col("area") / F.sum("area").over(Window.partitionBy("image_id"))).alias("share")))


@query("win02_still_falling", "SELECT event_id, coalesce(bool_and(d <= 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AND count(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) = 9, false) AS falling FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)")
def still_falling(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    last = w.rowsBetween(-8, 0)
    e = V.table(spark, sf, "events").withColumn("d", F.col("value") - F.lag("value").over(w))
    return e.select("event_id", F.coalesce(F.bool_and(F.col("d") <= 0).over(last) & (F.count("d").over(last) == 9), F.lit(False)).alias("falling"))


@query("spa01_classify", sql(f"""SELECT id, CASE WHEN x >= 200 AND y >= 150 AND x1 <= 400 AND y1 <= 300 THEN 'contained' WHEN NOT (x < 400 AND 200 < x1 AND y < 300 AND 150 < y1) THEN 'none'
 WHEN ((x < 200 AND x1 > 200) OR (x < 400 AND x1 > 400)) AND ((y < 150 AND y1 > 150) OR (y < 300 AND y1 > 300)) THEN 'both' WHEN (x < 200 AND x1 > 200) OR (x < 400 AND x1 > 400) THEN 'vertical' ELSE 'horizontal' END AS kind FROM ann"""))
def classify(spark, sf):
    r = V.rects(spark, sf).select("id", F.struct("x0", "y0", "x1", "y1").alias("b")).withColumn("a", F.expr("struct(200D AS x0, 150D AS y0, 400D AS x1, 300D AS y1)"))
    return rects.classified(r).select("id", "kind")


def _starts(side: str, step: str) -> str:
    every, shift = f"range(0, {side}, {step})", f"list_filter(range(0, {side}, {step}), lambda s: s + 640 >= {side} AND s < {side} - {step} AND s > 0)"
    return f"CASE WHEN len({shift}) = 0 THEN list_transform({every}, lambda s: {{'at': s, 'moved': false}}) ELSE list_append(list_transform(list_filter({every}, lambda s: s < ({shift})[1]), lambda s: {{'at': s, 'moved': false}}), {{'at': greatest(0, {side} - 640), 'moved': true}}) END"


@query("spa03_tiles", sql(f"""SELECT DISTINCT width, height, CAST(x.at AS INT) AS x1, CAST(y.at AS INT) AS y1, CAST(least(x.at + 640, width) AS INT) AS x2, CAST(least(y.at + 640, height) AS INT) AS y2
 FROM (SELECT *, unnest(xs) AS x, unnest(generate_series(1, len(xs))) AS k, coalesce(list_position(list_transform(xs, lambda s: s.at + 640 >= width), true), 0) AS first FROM (SELECT *, unnest(ys) AS y FROM (SELECT width, height, {_starts('width', 'sx')} AS xs, {_starts('height', 'sy')} AS ys
 FROM (SELECT width, height, greatest(1, CAST(floor(640 * (1 - width % 640 / 640.0)) AS INT)) AS sx, greatest(1, CAST(floor(640 * (1 - height % 640 / 640.0)) AS INT)) AS sy FROM (SELECT DISTINCT width, height FROM images))))) WHERE NOT y.moved OR first = 0 OR k < first OR k = 1"""))
def tile_grid(spark, sf):
    r = tiles.overlap_ratios(tiles.resolutions(V.images(spark, sf)))
    return tiles.tiles(r, 640, 640)



#: Corners of the strict hulls of points p (g, x, y), counter-clockwise from the least: starts of edges that have all points to their left or between their ends.
_HULL = """d AS (SELECT DISTINCT g, x, y FROM p),
edge AS (SELECT a.g, a.x, a.y FROM d a JOIN d b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) JOIN d c ON a.g = c.g GROUP BY a.g, a.x, a.y, b.x, b.y
 HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
corner AS (SELECT DISTINCT g, x, y FROM edge UNION SELECT g, x, y FROM d WHERE g IN (SELECT g FROM d GROUP BY 1 HAVING count(*) = 1)),
turn AS (SELECT g, x, y, CASE WHEN x = fx AND y = fy THEN -10.0 ELSE atan2(y - fy, x - fx) END AS t FROM corner JOIN (SELECT g AS fg, min(x) AS fx, arg_min(y, (x, y)) AS fy FROM corner GROUP BY 1) ON g = fg)"""


@query("spa11_convex_hulls", sql("SELECT g AS id, CAST(count(*) AS INT) AS corners, string_agg(x::VARCHAR || ',' || y::VARCHAR, ',' ORDER BY t) AS hull FROM turn GROUP BY 1",
 "p AS (SELECT id AS g, seg[2 * i + 1] AS x, seg[2 * i + 2] AS y FROM (SELECT id, seg, unnest(generate_series(0, 7)) AS i FROM ann))", _HULL))
def convex_hulls(spark, sf):
    a = V.annotations(spark, sf).select("id", F.col("segmentation")[0].alias("ring"))
    return polygons.convex_hulls(a).select("id", (F.size("hull") / 2).cast("int").alias("corners"), F.array_join(F.col("hull").cast("array<string>"), ",").alias("hull"))


@query("spa11_cloud_hulls", sql("SELECT g AS image_id, string_agg(x::VARCHAR || ',' || y::VARCHAR, ',' ORDER BY t) AS hull FROM turn GROUP BY 1", "p AS (SELECT image_id AS g, x, y FROM ann)", _HULL))
def cloud_hulls(spark, sf):
    p = V.annotations(spark, sf).selectExpr("image_id", "x", "y")
    return polygons.cloud_hulls(p, "image_id").select("image_id", F.array_join(F.col("hull").cast("array<string>"), ",").alias("hull"))


@query("spa17_ring_distances", sql("SELECT a.id AS a_id, b.id AS b_id, greatest(a.x, b.x) <= least(a.x1, b.x1) AND greatest(a.y, b.y) <= least(a.y1, b.y1) AS hit, round(sqrt(pow(greatest(0, greatest(a.x, b.x) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y, b.y) - least(a.y1, b.y1)), 2)), 5) AS distance FROM ann a JOIN ann b ON a.image_id = b.image_id AND b.id > a.id"))
def ring_distances(spark, sf):
    a = V.annotations(spark, sf).selectExpr("id", "image_id", "array(x, y, x + w, y, x + w, y + h, x, y + h) AS ring")
    b = a.toDF("b_id", "_i", "ring_b")
    pairs = a.join(b, (F.col("image_id") == F.col("_i")) & F.expr("b_id > id")).selectExpr("id AS a_id", "b_id", "ring AS ring_a", "ring_b")
    return polygons.ring_distances(pairs).withColumn("distance", F.round("distance", 5))


@query("spa26_area_sql", sql("SELECT id, w * h AS box_area FROM ann"))
def area_sql(spark, sf):
    a = V.annotations(spark, sf).selectExpr("id", "array(x, y, x + w, y, x + w, y + h, x, y + h) AS ring")
    return a.select("id", G.polygon_area("ring").alias("box_area"))
