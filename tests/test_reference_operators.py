"""Fixtures with known results for the annotation operators."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import jsonpath as J
from tessella.operators import clustering, ids, pixels, polygons, rects, stats, tiles, transforms
from tessella.plans import annotation_queries, dataset_queries
from tessella.sources import coco, views

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def one(df):
    (row,) = df.collect()
    return row


def test_tile_crossings(spark):
    tile = spark.createDataFrame([(1, 50.0, 50.0, 100.0, 100.0)], BOX).withColumn("g", F.lit(0))
    boxes = spark.createDataFrame([(101, 60.0, 60.0, 80.0, 80.0), (102, 30.0, 60.0, 60.0, 80.0), (103, 60.0, 30.0, 80.0, 60.0), (104, 30.0, 30.0, 60.0, 60.0), (105, 150.0, 150.0, 170.0, 170.0)], BOX).withColumn("g", F.lit(0))
    found = rects.tile_crossings(tile, boxes, ["g"])
    assert {(r.box_id, r.kind, tuple(r.boundaries)) for r in found.collect()} == {(102, "vertical", ("left",)), (103, "horizontal", ("top",)), (104, "both", ("left", "top"))}
    assert {(r.box_id, r.n) for r in rects.crossings_by_box(found).collect()} == {(102, 1), (103, 1), (104, 1)}


def test_overlaps_in_one_plane_and_none(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 300.0, 300.0), (2, 300.0, 0.0, 310.0, 5.0), (3, -200.0, -10.0, 5.0, 1.0), (4, 7.0, 7.0, 7.0, 9.0)], BOX)
    got = {(r.a_id, r.b_id) for r in rects.self_overlaps(a, by=None, cell=64.0).collect()}
    assert got == {(1, 3)}
    assert rects.self_overlaps(a.limit(0), by=None).collect() == []


def test_nested_both_ways(spark):
    r = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 1.0, 1.0, 5.0, 5.0), (3, 1.0, 1.0, 10.0, 5.0), (4, 0.0, 0.0, 10.0, 10.0)], BOX).withColumn("image_id", F.lit(1))
    closed = {(x.outer_id, x.inner_id) for x in rects.nested(r, ordered=False).collect()}
    assert closed == {(1, 2), (1, 3), (4, 2), (4, 3), (3, 2), (1, 4)}
    assert {(x.outer_id, x.inner_id) for x in rects.nested(r).collect()} >= {(1, 2), (4, 2)}


@pytest.mark.parametrize(
    ("w", "h", "rx", "ry", "tile", "want"),
    [
        (1280, 1280, 0.0, 0.0, 640, {(0, 0, 640, 640), (0, 640, 640, 1280), (640, 0, 1280, 640), (640, 640, 1280, 1280)}),
        (1000, 800, 0.5625, 0.25, 640, {(0, 0, 640, 640), (280, 0, 920, 640), (360, 0, 1000, 640), (0, 480, 640, 800), (280, 480, 920, 800), (360, 480, 1000, 800)}),
        (1600, 1600, 0.5, 0.5, 640, {(x, y, x + 640, y + 640) for x in (0, 320, 640, 960) for y in (0, 320, 640, 960)} - {(960, 960, 1600, 1600)}),
        (1000, 800, 0.5625, 0.25, None, {(0, 0, 1000, 533), (0, 267, 1000, 800)}),
    ],
)
def test_tiles(spark, w, h, rx, ry, tile, want):
    r = spark.createDataFrame([(w, h, rx, ry)], "width int, height int, ratio_x double, ratio_y double")
    assert {(t.x1, t.y1, t.x2, t.y2) for t in tiles.tiles(r, tile, tile).collect()} == want


def test_self_intersection(spark):
    rings = [(1, [0.0, 0.0, 4.0, 4.0, 4.0, 0.0, 0.0, 4.0]), (2, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]), (3, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]), (4, [])]
    got = {r.id: (r.intersects, r.px, r.py) for r in polygons.self_intersections(spark.createDataFrame(rings, "id long, ring array<double>")).collect()}
    assert got == {1: (True, 2.0, 2.0), 2: (False, None, None), 3: (False, None, None), 4: (False, None, None)}
    with pytest.raises(Exception, match="pairs of coordinates"):
        polygons.self_intersections(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, ring array<double>")).collect()


def test_hull_is_strict():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 0], [1, 1], [2, 1]], float)
    assert {tuple(p) for p in polygons.hull(square)} == {(0, 0), (2, 0), (2, 2), (0, 2)}
    assert len(polygons.hull(np.array([[1, 1], [1, 1]]))) == 1
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(5000, 2))
    assert np.allclose(sorted(map(tuple, polygons.hull(cloud))), sorted(map(tuple, polygons.hull(cloud[~polygons.inside_extremes(cloud)]))))


def test_cloud_hull_from_candidates(spark):
    rng = np.random.default_rng(1)
    cloud = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(7, float(x), float(y)) for x, y in cloud], "id long, x double, y double")
    assert polygons.hull_candidates(df, "id").count() < 200
    assert np.allclose(np.array(one(polygons.cloud_hulls(df, "id")).hull).reshape(-1, 2), polygons.hull(cloud))


def test_distances_of_shapes():
    square = {"kind": "points", "points": np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)}
    far = {"kind": "points", "points": square["points"] + [4, 0]}
    hit, d, p, q, _ = polygons.gjk(square, far, 2)
    assert (hit, round(d, 9), round(p[0], 9), round(q[0], 9)) == (False, 3, 1, 4)
    assert polygons.gjk(square, {"kind": "circle", "center": [3, 0.5], "radius": 1}, 2)[1] == pytest.approx(1, abs=1e-4)
    assert polygons.gjk(square, {"kind": "box", "center": [1, 1], "size": [1, 1]}, 2)[0]
    assert polygons.gjk(square, {"kind": "ellipse", "center": [4, 0.5], "axes": [2, 1]}, 2)[1] == pytest.approx(1, abs=1e-4)
    cube = {"kind": "points", "points": np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)}
    turned = polygons.moved(cube, np.eye(3)[[1, 2, 0]], np.array([0, 0, 5.0]))
    assert polygons.gjk(cube, turned, 3)[1] == pytest.approx(4)
    assert polygons.gjk(cube, {"kind": "sphere", "center": [0.5, 0.5, 0.5], "radius": 0.1}, 3)[0]
    assert polygons.gjk(cube, {"kind": "capsule", "points": [[3, 0, 0], [3, 1, 0]], "radius": 0.5}, 3)[1] == pytest.approx(1.5, abs=1e-4)
    hit, d, p, q = polygons.with_radii(False, 4.0, np.zeros(3), np.array([0, 0, 4.0]), 1, 2)
    assert (hit, d, p[2], q[2]) == (False, 1, 1, 2)
    assert polygons.with_radii(False, 4.0, np.zeros(3), np.array([0, 0, 4.0]), 3, 2)[0]


def test_bloom_parameters_and_membership(spark):
    assert ids.bloom_size(1000, 0.001) == (14378, 10)
    for n, p in ((0, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            ids.bloom_size(n, p)
    have = spark.range(500)
    bits = ids.bloom_build(have, "id", 1000)
    assert ids.bloom_might_contain(have, "id", bits, 1000).where("NOT might_exist").count() == 0
    assert ids.bloom_might_contain(spark.range(10_000, 12_000), "id", bits, 1000).where("might_exist").count() < 10
    assert 0 < one(ids.bloom_stats(bits, 1000, 500)).fill_ratio < 0.5


def test_ids_are_remapped_and_stay_unique(spark):
    old = spark.range(1, 11)
    new = spark.createDataFrame([(11, 0), (5, 1), (12, 2), (12, 3)], "id long, pos int")
    rows, mapping = ids.add_rows(old, new, "pos")
    assert [r.id for r in rows.orderBy("pos").collect()] == [11, 13, 12, 14]
    assert {(r.old_id, r.new_id) for r in mapping.collect()} == {(5, 13), (12, 14)}
    with pytest.raises(Exception, match="id exists"):
        ids.add_rows(old, new, "pos", remap=False)[0].collect()


def test_categories_merge_by_name(spark):
    none = lambda s: spark.createDataFrame([], s)
    base = {"images": none("id long"), "annotations": none("id long, image_id long, category_id long"), "categories": spark.createDataFrame([(1, "cat", "pet")], "id long, name string, supercategory string")}
    extra = {"images": none("id long, pos int"), "annotations": spark.createDataFrame([(1, 1, 1, 0), (2, 1, 2, 1)], "id long, image_id long, category_id long, pos int"), "categories": spark.createDataFrame([(1, "dog", "pet", 0), (2, "cat", "pet", 1)], "id long, name string, supercategory string, pos int")}
    m = ids.merge(base, extra)
    assert {(r.id, r.name) for r in m["categories"].collect()} == {(1, "cat"), (2, "dog")}
    assert {(r.id, r.category_id) for r in m["annotations"].collect()} == {(1, 2), (2, 1)}


def test_coco_round_trip(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"images": [{"id": 1, "width": 5, "height": 4, "file_name": "x"}, {"id": 1, "width": 6, "height": 4, "file_name": "y"}], "annotations": [{"id": 3, "image_id": 1, "category_id": 2, "segmentation": [[0, 0, 1, 0, 1, 1]], "bbox": [0, 0, 1, 1], "area": 1, "note": "hm"}, {"id": 4, "image_id": 1}]}')
    d = coco.read_coco(spark, str(path))
    assert one(d["images"]).file_name == "y" and d["categories"].collect() == []
    assert one(d["annotations"].where("id = 3").selectExpr("variant_get(extra, '$.note', 'string') AS n")).n == "hm"
    assert [r.id for r in coco.boxes(d["annotations"]).collect()] == [3]
    doc = one(coco.document(d["images"].drop("pos"), d["annotations"].drop("pos", "extra"), d["categories"].drop("pos"))).document
    assert '"file_name":"y"' in doc


def test_header_sizes():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (3).to_bytes(2, "big") + (8).to_bytes(2, "big") + b"\x03"
    assert coco.header_size(png) == (7, 9) and coco.header_size(jpeg) == (8, 3)
    assert coco.header_size(b"GIF89a\x02\0\x03\0") == (2, 3) and coco.header_size(b"junk") is None and coco.header_size(None) is None


def test_options():
    assert coco.Options.of({"tile_width": 3, "other": 1}).tile_width == 3 and coco.Options.of(None).max_iterations == 20
    assert coco.lookup({"a": {"b": 0}}, "a", "b", default=5) == 0 and coco.lookup({}, "a", "b", default=5) == 5


def test_fractions_and_values(spark):
    rows = [("28/10", 2.8), ("1 1/2", 1.5), ("-3", -3.0), ("-1 1/4", -1.25), ("x", None), ("1/0", None)]
    got = spark.createDataFrame(rows, "s string, want double").select("want", G.fraction("s").alias("got")).collect()
    assert all(r.got == r.want or r.got == pytest.approx(r.want) for r in got)


def test_degenerate_boxes_and_rings(spark):
    b = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "x double, y double, w double, h double").select(*[c.alias(n) for n, c in G.box_features().items()])
    assert (one(b).aspect_ratio, one(b).elongation, one(b).compactness) == (0, 1, 0)
    r = spark.createDataFrame([(1, [[0.0, 0.0, 1.0]]), (2, []), (3, None)], "id int, segmentation array<array<double>>")
    got = r.select(*[c.alias(n) for n, c in G.segmentation_features("segmentation", "1D").items()]).collect()
    assert {tuple(x) for x in got} == {(0, 0.0, 1.0, 0.0, 0.0)}


def test_rings_are_made_once(spark):
    rings = [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0], [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 9.0], [1.0, 1.0, 4.0, 5.0], [1.0, 1.0], [0.0, 0.0, None, 0.0, 4.0, 3.0], None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "id int, ring array<double>")
    got = d.select("id", G.polygon_area("ring").alias("a"), G.polygon_perimeter("ring").alias("p")).orderBy("id").collect()
    assert [(r.a, r.p) for r in got] == [(6, 12), (6, 12), (0, 10), (0, 0), (None, None), (0, 0)]
    features = d.select("id", *[c.alias(n) for n, c in G.segmentation_features("array(ring)", "12D").items()]).orderBy("id").collect()
    none = (0, 0, 1, 0, 0)
    assert [tuple(r)[1:] for r in features] == [(3, 6, 2, 12, pytest.approx(np.pi / 6)), none, none, none, (3, None, 1, None, 0), none]
    # an interpreted function works out the ring wherever its text stands
    made = lambda c: d.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("reverse(")
    assert [made(f("reverse(ring)")) for f in (G.polygon_area, G.polygon_perimeter)] == [1, 1]
    assert max(made(c) for c in G.segmentation_features("array(reverse(ring))", "1D").values()) <= 4


def test_transform_keypoints_needs_triplets(spark):
    d = spark.createDataFrame([([1.0, 2.0],)], "k array<double>").withColumn("m", F.expr("array(1D,0D,0D,0D,1D,0D,0D,0D,1D)"))
    with pytest.raises(Exception, match="triplets"):
        d.select(G.transform_keypoints("m", "k", "10D", "10D")).collect()


def test_json_members(spark):
    d = spark.createDataFrame([('{"id": 7, "bbox": [1, 2.5], "segmentation": [[1, 2], []], "iscrowd": 1}',), ("broken",), (None,)], "raw string")
    got = d.select(J.integer("raw", "id"), J.item("raw", "bbox", 2), J.length("raw", "segmentation"), J.boolean("raw", "iscrowd"), J.double("raw", "area")).collect()
    assert tuple(got[0]) == (7, 2.5, 2, True, 0.0) and tuple(got[1]) == tuple(got[2]) == (None, 0.0, 0, False, 0.0)


def test_anchors_drop_near_duplicates(spark):
    b = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.5, 9.8), (3, 5.0, 5.0), (4, 40.0, 3.0)], "id long, w double, h double")
    assert [(r.w, r.h) for r in clustering.anchors(b, 2).orderBy("rank").collect()] == [(40.0, 3.0), (10.5, 9.8)]


def test_single_cluster_scores(spark):
    d = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "id long, label int, f double")
    s = one(clustering.index_scores(d, ["f"]))
    assert s.calinski_harabasz == 0 and s.davies_bouldin == float("inf")
    assert one(clustering.silhouette(d, ["f"])).silhouette == 0


@pytest.mark.parametrize("block", [2048, 20])
def test_silhouette_is_euclidean(spark, block):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 2)) * [1, 5], rng.integers(0, 3, 90)
    y[0] = 7  # alone
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(90):
        mean = {k: d[i, y == k].sum() / ((y == k).sum() - (k == y[i])) for k in set(y.tolist()) if k != y[i] or (y == k).sum() > 1}
        a = mean.pop(y[i], None)
        want.append(0 if a is None else (min(mean.values()) - a) / max(a, min(mean.values())))
    rows = spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, label int, f double, g double")
    assert one(clustering.silhouette(rows, ["f", "g"], block)).silhouette == pytest.approx(np.mean(want), abs=1e-9)


def test_dbscan_noise(spark):
    d = spark.createDataFrame([(i, float(i) * 0.1, 0.0) for i in range(6)] + [(9, 50.0, 50.0)], "id long, a double, b double")
    got = {r.id: r.label for r in clustering.dbscan(d, ["a", "b"], 0.25, 3).collect()}
    assert got[9] == -1 and {got[i] for i in range(6)} == {0}


def density_labels(x, eps, least):
    """By comparing all pairs; rows are their own ids."""
    near = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.where(near & core[None, :], label[None, :], len(x)).min(1))
    return np.where(label == len(x), -1, label)


def _density_cases():
    rng = np.random.default_rng(8)
    clusters = np.concatenate([rng.normal(c, 0.2, (120, 2)) for c in ((0, 0), (1.3, 0.2), (0.4, 3))] + [rng.uniform(-2, 4, (160, 2))])
    yield "clusters", clusters, 0.25, 5
    yield "one feature", clusters[:, :1] * 9, 0.1, 4
    yield "three features", np.c_[clusters, rng.normal(size=len(clusters)) * 0.3], 0.45, 5
    yield "grid, exactly eps apart", np.stack(np.meshgrid(np.arange(12.0), np.arange(9.0)), -1).reshape(-1, 2), 1.0, 5
    # two dense cells whose outermost points are too far from each other, inner ones not
    disc = lambda n: np.c_[np.cos(a := rng.uniform(0, 2 * np.pi, n)), np.sin(a)] * 0.3 * np.sqrt(rng.uniform(0, 1, (n, 1)))
    yield "discs", np.concatenate([disc(150) + [0.35, 0.35], disc(150) + [1.62, 0.6], [[0.2, 50.0], [0.2, 50.0]]]), 0.75, 4
    yield "copies", np.concatenate([np.repeat([[0.1, 0.1]], 60, 0), np.repeat([[0.34, 0.1]], 3, 0), [[0.59, 0.1], [0.61, 0.1]]]), 0.25, 4


@pytest.mark.parametrize("name, x, eps, least", list(_density_cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_dbscan_equals_all_pairs(spark, name, x, eps, least):
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(x.shape[1])))
    got = dict(clustering.dbscan(d, d.columns[1:], eps, least).collect())
    assert got == dict(enumerate(density_labels(x, eps, least).tolist()))


def test_dbscan_odd_values(spark):
    odd = [None, float("nan"), float("inf"), -1e300, 1e300, 1e300]
    d = spark.createDataFrame([(i, v, 0.0) for i, v in enumerate(odd)] + [(10 + i, 0.01 * i, 0.0) for i in range(4)], "id long, a double, b double")
    got = dict(clustering.dbscan(d, ["a", "b"], 0.1, 2).collect())
    assert got == {0: -1, 1: -1, 2: -1, 3: -1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10}


def test_dbscan_writes_points_not_pairs(spark, monkeypatch):
    d = spark.range(3000).select("id", *[((F.xxhash64("id", F.lit(i)) % 1000) / 1e4).alias(f"f{i}") for i in (0, 1)])
    seen = []
    groups = clustering.overlap_groups
    monkeypatch.setattr(clustering, "overlap_groups", lambda edges, *a: seen.append(edges.count()) or groups(edges, *a))
    assert clustering.dbscan(d, ["f0", "f1"], 0.05, 4).select("label").distinct().collect() == [(0,)]
    assert sum(seen) < 3000


def test_smoothing_keeps_the_sum(spark):
    g = spark.createDataFrame([(x, y, 5 if (x, y) == (0, 0) else 0) for x in range(6) for y in range(4)], "bx int, by int, count long")
    rows = stats.smoothed(g, 6, 4, 1.0).collect()
    assert sum(r.density for r in rows) == pytest.approx(5) and len(rows) == 24


def test_homography_with_outliers():
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 500, (40, 2))
    h = np.array([[1.2, 0.1, 4], [-0.05, 0.9, 7], [1e-4, 2e-5, 1]])
    p = np.c_[src, np.ones(40)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:8] += rng.uniform(50, 200, (8, 2))
    assert np.allclose(transforms.ransac(src, dst), h, atol=1e-6)
    assert transforms.ransac(src[:3], dst[:3]) is None


def test_color_filters():
    x = np.arange(12.0).reshape(3, 4)
    assert pixels.box_mean(x, 1)[1, 1] == pytest.approx(x[:3, :3].mean())
    rng = np.random.default_rng(3)
    planes = rng.uniform(1, 255, (3, 8, 8))
    out = pixels.correct_colors(planes, radius=2)
    assert out.shape == planes.shape and np.allclose(out[1], planes[1]) and np.isfinite(out).all()
    assert [r for r, _ in pixels.radius_candidates(np.stack([x**2, x**2 * 3, x**2 * 2]))] == [12, 8, 10]
    assert pixels.run_pipeline(planes, [(2, lambda p: p + 1), (1, lambda p: p * 0)]).max() == 1


@pytest.mark.parametrize("options", [{}, {"mode": "brighten"}, {"mode": "darken", "safety": 0.1}])
def test_colors_of_several_images_at_once(options):
    rng = np.random.default_rng(4)
    several = rng.uniform(0, 255, (5, 3, 7, 9)) * np.array([1, 1e-3, 0.5, 1, 0])[:, None, None, None]
    several[3, 1] = 9  # a flat guide
    out = pixels.correct_colors(several, radius=2, **options)
    assert all((out[i] == pixels.correct_colors(several[i], radius=2, **options)).all() for i in range(5))
    assert abs(out - several)[0].mean() > 0


def test_images_of_one_size_come_together(spark):
    rows = [(i, y, x, float(i)) for i, h in ((1, 2), (2, 3), (3, 2), (4, 3), (5, 2)) for y in range(h) for x in range(4)]
    arrays = pixels.as_arrays(spark.createDataFrame(rows, "image_id long, y int, x int, r double").coalesce(1), "r", "r * 2")
    found = pixels.per_image(arrays.coalesce(1), lambda p: {"n": [len(p)] * len(p), "high": [p.shape[2]] * len(p), "second": p[:, 1].max((1, 2))}, "image_id long, n int, high int, second double").collect()
    assert sorted(map(tuple, found)) == [(1, 3, 2, 2.0), (2, 2, 3, 4.0), (3, 3, 2, 6.0), (4, 2, 3, 8.0), (5, 3, 2, 10.0)]


def test_spectrum_of_a_constant():
    s = pixels.spectrum(np.ones((1, 8, 8)))
    assert s["low_ratio"] == pytest.approx(1) and s["centroid"] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_coverage_cells_are_counted_within_groups(spark, most):
    rng = np.random.default_rng(5)
    rows = [(i, i % 7 if i < 300 else 7 + i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 12, (320, 4)))]
    rows += [(900, None, 0.0, 0.0, 1.0, 1.0), (901, None, 0.0, 0.0, 1.0, 1.0)]
    want = {}
    for g in {r[1] for r in rows} - {None}:
        own = [r[2:] for r in rows if r[1] == g and r[2] < r[4] and r[3] < r[5]]
        xs, ys = (sorted({r[k] for r in own} | {r[k + 2] for r in own}) for k in (0, 1))
        for a, c in zip(xs, xs[1:]):
            for b, d in zip(ys, ys[1:]):
                n = sum(r[0] < c and a < r[2] and r[1] < d and b < r[3] for r in own)
                if n >= 2:
                    want[(g, a, b, c, d)] = n
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = rects.coverage_cells(spark.createDataFrame(rows, "id long, image_id long, x0 double, y0 double, x1 double, y1 double"), most=most)
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r)[:5]: r.n for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", ["300", "128m"])
def test_document_is_written_and_read_in_parts(spark, tmp_path, block):
    i = spark.range(20, numPartitions=3).selectExpr("19 - id AS id", "CAST(5 AS INT) AS width", "CAST(6 AS INT) AS height", "IF(id = 3, '], \"annotations\": [', 'a,') AS file_name")
    a = spark.range(50, numPartitions=4).selectExpr("id", "id % 20 AS image_id", "array(CAST(id AS DOUBLE), 0.5D) AS bbox", "IF(id % 2 = 0, 1, NULL) AS iscrowd")
    c = spark.range(0).selectExpr("id", "'x' AS name")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        path = str(tmp_path / "d.json")
        coco.save_document(path, i, a, c)
        assert json.loads((tmp_path / "d.json").read_text()) == json.loads(one(coco.document(i, a, c)).document)
        back = coco.read_document(spark, path)
        assert sorted((r.id, r.file_name) for r in back["images"].collect()) == sorted((r.id, r.file_name) for r in i.collect())
        assert sorted((r.id, r.image_id, r.bbox, r.iscrowd) for r in back["annotations"].collect()) == [tuple(r) for r in a.orderBy("id").collect()]
        assert back["categories"].count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pixels_of_an_image_lie_in_one_task_and_tasks_grow_with_images(spark, tmp_path):
    e = spark.range(4000).selectExpr("id AS event_id", "id AS user_id")
    e.write.parquet(str(tmp_path / "events.parquet"))
    p = views.pixels(spark, str(tmp_path))
    tasks = p.withColumn("task", F.spark_partition_id()).groupBy("image_id").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n"))
    assert tasks.where("tasks <> 1 OR n <> 400").isEmpty() and tasks.count() == 4000
    assert p.rdd.getNumPartitions() == 5 and 4000 * 400 / 4 < views.PIXELS
    before, views.PIXELS = views.PIXELS, 100_000
    try:
        assert views.pixels(spark, str(tmp_path)).rdd.getNumPartitions() == 16
    finally:
        views.PIXELS = before
    # no operator deals pixels or counts by image again
    for f in (pixels.tones, pixels.luminance, pixels.exposure, pixels.dynamic_range, pixels.normalized_gray):
        plan = f(p)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning(image_id" in x and "ENSURE_REQUIREMENTS" in x], plan


def test_mutual_matches_sort_no_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), i, rng.integers(-4, 4, 2).tolist()) for i, g in enumerate(rng.integers(0, 6, 160))]
    rows = [r for r in rows if r[0] != 5 or r[1] % 2] + [(None, 900, [0, 0]), (None, 901, [0, 0])]
    a, b = (spark.createDataFrame([r for r in rows if r[1] % 2 == k], "pair_id long, id long, words array<long>") for k in (0, 1))
    dist = lambda x, y: sum(((u ^ v) & (1 << 64) - 1).bit_count() for u, v in zip(x[2], y[2]))
    want, sides = set(), ([r for r in rows if r[1] % 2 == 0 and r[0] is not None], [r for r in rows if r[1] % 2 and r[0] is not None])
    near = lambda r, others: min(((dist(r, o), o[1]) for o in others if o[0] == r[0]), default=None)
    for x in sides[0]:
        best = near(x, sides[1])
        if best and near(next(o for o in sides[1] if o[1] == best[1]), sides[0])[1] == x[1]:
            want.add((x[0], x[1], best[1], best[0]))
    got = transforms.mutual_matches(a, b)
    assert {tuple(r) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    p, q = rng.integers(0, 1 << 60, (50, 2)), rng.integers(0, 1 << 60, (40, 2))
    whole = transforms.nearest_of_each_other(p, q)
    before, transforms.DISTANCES = transforms.DISTANCES, 90
    try:
        assert all((x == y).all() for x, y in zip(whole, transforms.nearest_of_each_other(p, q)))
    finally:
        transforms.DISTANCES = before


def test_silhouette_meets_each_pair_of_sets_once_and_keeps_close_rows_apart(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(90, 3)), np.full((6, 3), 1e4), [[1e4 + 1e-5, 1e4, 1e4]]]
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(clustering._distances(x, x), want, rtol=1e-8, atol=1e-12)
    d = spark.createDataFrame([(i, i % 3, *map(float, r)) for i, r in enumerate(x)], "id long, label int, f double, g double, h double")
    label = np.arange(len(x)) % 3
    mean = lambda i, k: want[i, label == k].sum() / ((label == k).sum() - (label[i] == k))
    each = [(min(mean(i, k) for k in range(3) if k != label[i]), mean(i, label[i])) for i in range(len(x))]
    for block in (4, 4096):
        assert one(clustering.silhouette(d, ["f", "g", "h"], block)).silhouette == pytest.approx(np.mean([(b - a) / max(a, b) for b, a in each]), abs=1e-9)


def test_filter_grows_with_its_items(spark, tmp_path):
    assert ids.bloom_capacity(spark.range(5), 100) == 100 and ids.bloom_capacity(spark.range(500), 100) == 500
    spark.range(450_000).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    assert tuple(one(dataset_queries.bloom_membership(spark, str(tmp_path)))) == (450_000, 450_000, True)


def test_matches_on_the_limit_do_not_depend_on_the_order_of_rows(spark):
    # mean 5.6 and half a deviation 1.4: the sevens lie on the limit
    rng, distances = np.random.default_rng(0), [8, 9, 6, 3, 4, 7, 3, 3, 6, 3, 5, 2, 4, 9, 12]
    orders = [rng.permutation(distances).tolist() for _ in range(4000)]
    m = spark.createDataFrame(list(enumerate(orders)), "pair_id long, d array<int>").selectExpr("pair_id", "posexplode(d) AS (a_id, distance)").withColumn("b_id", F.col("a_id"))
    kept = transforms.good_matches(m).groupBy("pair_id").agg(F.count("*").alias("n"), F.max("distance").alias("most"))
    assert [tuple(r) for r in kept.groupBy("n", "most").count().collect()] == [(11, 7, 4000)]


def test_ring_distances_of_many_pairs_equal_single_ones(spark):
    rng = np.random.default_rng(3)
    some = [(rng.integers(0, 9, 2 * k).astype(float) + rng.integers(0, 14), rng.integers(0, 9, 2 * m).astype(float)) for k in range(1, 7) for m in range(1, 7) for _ in range(12)]
    points = lambda r: {"kind": "points", "points": r.reshape(-1, 2)}
    want = {i: polygons.gjk(points(x), points(y), 2)[:2] for i, (x, y) in enumerate(some)}
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(some)] + [(-1, None, [0.0, 0.0]), (-2, [0.0, 0.0], [])]
    got = {r.id: (r.hit, r.distance) for r in polygons.ring_distances(spark.createDataFrame(rows, "id long, ring_a array<double>, ring_b array<double>")).collect()}
    assert got.pop(-1) == got.pop(-2) == (None, None)
    assert {i: h for i, (h, _) in got.items()} == {i: h for i, (h, _) in want.items()}
    assert [got[i][1] for i in want] == pytest.approx([d for _, d in want.values()], abs=1e-6)
    # a hundred thousand pairs, which took a minute or more one by one
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    shift = np.arange(100_000)[:, None, None] % 50 * np.array([1.0, 0.0])
    began = time.process_time()
    hit, distance = polygons.gjk_many(np.broadcast_to(square, (100_000, 4, 2)), square + shift)
    assert time.process_time() - began < 10 and hit.sum() == 4_000 and distance.max() == pytest.approx(48)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_ring_distances_of_all_pairs_of_an_image(spark):
    rows = annotation_queries.ring_distances(spark, "/root/testdata/sf0.001").select("a_id", "b_id").collect()
    by_image = {}
    for r in views.annotations(spark, "/root/testdata/sf0.001").select("id", "image_id").collect():
        by_image.setdefault(r.image_id, []).append(r.id)
    want = {(a, b) for ids_ in by_image.values() for a in ids_ for b in ids_ if a < b}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


@pytest.mark.parametrize("parts", [4, 8, 16])
def test_running_numbers_are_whole_and_in_order(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(60_000).selectExpr("pmod(xxhash64(id), 1000000007) AS pos", "id AS a", "repeat(CAST(id AS STRING), 3) AS b")
        got = ids.running_number(rows, ["pos", "a"], "n").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = got.sort_values(["pos", "a"])
    assert (want["n"].to_numpy() == np.arange(1, 60_001)).all() and (got["b"] == got["a"].astype(str) * 3).all()


def test_running_number_of_no_rows(spark):
    assert ids.running_number(spark.range(0), ["id"], "n").collect() == []


def flat_image(spark, spans):
    """One image of gray pixels: (value, how many)."""
    values = [v for v, n in spans for _ in range(n)]
    return spark.createDataFrame([(1, 0, x, v, v, v) for x, v in enumerate(values)], "image_id long, y int, x int, r int, g int, b int")


@pytest.mark.parametrize(
    ("spans", "stops", "first", "quality"),
    [
        ([(250, 11), (128, 89)], -2.0, "Significantly overexposed - reduce exposure by 2+ stops", "Poor"),
        ([(250, 6), (128, 94)], -1.0, "Overexposed - reduce exposure by 1 stop", "Fair"),
        ([(250, 3), (10, 20), (128, 77)], -0.5, "Slightly overexposed - reduce exposure by 0.5 stops", "Poor"),
        ([(10, 11), (128, 89)], 2.0, "Significantly underexposed - increase exposure by 2+ stops", "Poor"),
        ([(10, 6), (128, 94)], 1.0, "Underexposed - increase exposure by 1 stop", "Fair"),
        ([(10, 3), (128, 97)], 0.5, "Slightly underexposed - increase exposure by 0.5 stops", "Good"),
        ([(80, 100)], 0.5, "Image appears dark - consider increasing exposure", "Good"),
        ([(180, 100)], -0.5, "Image appears bright - consider reducing exposure", "Good"),
        ([(40, 10), (128, 90)], 0.0, "Exposure appears well-balanced", "Excellent"),
    ],
)
def test_exposure_advice_by_hand(spark, spans, stops, first, quality):
    r = one(pixels.exposure_advice(flat_image(spark, spans)))
    assert (r.compensation, r.recommendations[0], r.quality) == (stops, first, quality)
    more = r.recommendations[1:]
    assert more == (["Consider slight exposure increase for better shadow detail"] if stops == 0 else [])


def test_tones_and_range_by_hand(spark):
    assert one(pixels.tones(flat_image(spark, [(20, 50), (200, 50)]))).tone == "balanced"
    assert one(pixels.tones(flat_image(spark, [(20, 51), (200, 49)]))).tone == "shadows-heavy"
    t = one(pixels.tones(flat_image(spark, [(20, 40), (171, 60)])))
    assert (t.tone, t.shadows, t.highlights, t.center, t.fullest) == ("highlights-heavy", 40, 60, pytest.approx(20 * 0.4 + 171 * 0.6), 171)
    d = one(pixels.dynamic_range(flat_image(spark, [(i, 1) for i in range(0, 202, 2)])))
    assert (d.range_full, d.p1, d.p99, d.range_98, d.good_range) == (200, 2, 198, pytest.approx(196), True)
    e = one(pixels.exposure(flat_image(spark, [(252, 3), (4, 1), (100, 96)])))
    assert (e.clip_r_high_pct, e.clip_g_low_pct, e.over_exposed, e.under_exposed, e.has_issues) == (3, 1, True, False, True)


def test_spectrum_of_one_wave():
    x = np.cos(2 * np.pi * 3 * np.arange(16) / 16)[None, :].repeat(16, 0) * 255
    s = pixels.spectrum(x[None])
    # all energy at three steps left and right of the centre; the corner is int(sqrt(128)) = 11 away, a quarter of which is under three
    assert (s["low_ratio"], s["mid_ratio"], s["high_ratio"]) == (pytest.approx(0), pytest.approx(1), pytest.approx(0))
    assert len(s["radial"]) == 11 and int(np.argmax(s["radial"])) == 3 and s["centroid"] == pytest.approx(3)


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 3000), rng.integers(0, 40, 3000) / 4, strict=True)] + [(7, 1.0), (None, 2.0), (None, 4.0), (8, None)]
    got = {r.k: (r.q0, r.q1, r.q2) for r in stats.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0, 0.3, 1]).collect()}
    want = {k: tuple(np.quantile([v for g, v in rows if g == k and v is not None], [0, 0.3, 1])) for k in (0, 1, 2, 7, None)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_running_sums(spark):
    rows = spark.range(5000).selectExpr("pmod(xxhash64(id), 10007) AS pos", "id AS a", "id % 7 AS n")
    got = ids.running_sum(rows, ["pos", "a"], "n", "before").toPandas().sort_values(["pos", "a"])
    assert (got["before"].to_numpy() == np.r_[0, np.cumsum(got["n"])[:-1]]).all()


@pytest.mark.parametrize("double", [True, False])
def test_bloom_state_goes_out_and_in(spark, tmp_path, double):
    have = spark.range(300)
    ids.bloom_export(ids.bloom_build(have, "id", 500, 0.01, double), str(tmp_path / "b"), 500, 300, 0.01, double)
    bits, about = ids.bloom_import(spark, str(tmp_path / "b"))
    assert about == {"capacity": 500, "rate": 0.01, "double": double, "items": 300}
    assert ids.bloom_might_contain(have, "id", bits, 500, 0.01, double).where("NOT might_exist").isEmpty()
    assert ids.bloom_might_contain(spark.range(1000, 2000), "id", bits, 500, 0.01, double).where("might_exist").count() < 40


@pytest.mark.parametrize("short", [64, 0])
def test_self_intersections_by_either_way(spark, monkeypatch, short):
    monkeypatch.setattr(polygons, "SHORT_RING", short)
    rng = np.random.default_rng(6)
    rings = [(i, rng.integers(0, 9, 2 * n).astype(float).tolist()) for i, n in enumerate(rng.integers(0, 9, 60))] + [(70, None)]
    got = {r.id: (r.intersects, r.px, r.py) for r in polygons.self_intersections(spark.createDataFrame(rings, "id long, ring array<double>")).collect()}
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for i, ring in rings:
        p = np.array(ring or []).reshape(-1, 2)
        n, hits = len(p), []
        for s in range(n):
            for t in range(s + 2, n):
                if n < 4 or (s == 0 and t == n - 1):
                    continue
                a, b, c, d = p[s], p[(s + 1) % n], p[t], p[(t + 1) % n]
                d1, d2 = side(c, d, a), side(c, d, b)
                if d1 * d2 < 0 and side(a, b, c) * side(a, b, d) < 0:
                    hits.append(tuple(a + (b - a) * (d1 / (d1 - d2))))
        assert got[i][0] == bool(hits)
        if hits:
            assert got[i][1:] == pytest.approx(min(hits))


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_groups_of_contracted_edges(spark, monkeypatch, most):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b), int(a) // 50) for a, b in rng.integers(0, 50, (120, 2)) + 50 * rng.integers(0, 4, (120, 1))] + [(999, 999, 9)]
    up = {x: x for a, b, _ in pairs for x in (a, b)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, _ in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    edges = spark.createDataFrame(pairs, "a_id long, b_id long, g int")
    monkeypatch.setattr(rects, "contracted", lambda e, by=None, roots=False, f=rects.contracted: f(e, by, most, roots))
    for by in ("g", None):
        got = {r.id: r.component for r in rects.overlap_groups(edges, by).collect()}
        assert got == {x: find(x) for a, b, _ in pairs for x in (a, b)}
    assert rects.overlap_groups(edges.limit(0)).collect() == []
