"""Generators, whole analyses, the streaming count and the entry point."""

import numpy as np

from tessella.functions.geometry import polygon_area
from tessella.operators import polygons, rects
from tessella.plans import analyses
from tessella.sources import coco, generate
from tessella.streaming.counts import windowed_counts


def with_boxes(annotations):
    return annotations.selectExpr("*", "bbox[0] AS x", "bbox[1] AS y", "bbox[2] AS w", "bbox[3] AS h")


def test_generated_data_is_stable_and_inside(spark):
    a, b = (generate.dataset(spark, 20) for _ in range(2))
    assert a["annotations"].exceptAll(b["annotations"]).isEmpty()
    out = with_boxes(a["annotations"]).join(a["images"].selectExpr("id AS image_id", "width", "height"), "image_id").where("x < 0 OR y < 0 OR x + w > width OR y + h > height")
    assert out.isEmpty()
    rings = a["annotations"].selectExpr("id", "segmentation[0] AS ring")
    assert polygons.self_intersections(rings).where("intersects").isEmpty()
    assert rings.where(polygon_area("ring") <= 0).isEmpty()
    assert generate.expected_annotations(10, 1, 5) == 30


def test_nested_groups(spark):
    r = generate.nested_rectangles(spark, 3, 4)
    assert rects.nested(r).count() == rects.nested(r, ordered=False).count() == 3 * 6
    groups = rects.overlap_groups(rects.self_overlaps(r))
    assert {(x.id, x.component) for x in groups.collect()} == {(i, i // 4 * 4) for i in range(12)}
    assert {x.id for x in rects.smaller_members(r, groups).collect()} == {i for i in range(12) if i % 4}


def test_rings_and_apart_shapes():
    assert generate.ring_image(32).shape == (3, 32, 32)
    shapes = [{"kind": "points", "points": np.array(s).reshape(-1, 2)} for s in generate.apart_shapes().values()]
    assert not any(polygons.gjk(a, b, 2)[0] for i, a in enumerate(shapes) for b in shapes[:i])


def test_analyses(spark, tmp_path):
    d = generate.dataset(spark, 30)
    a = with_boxes(d["annotations"])
    found = analyses.clustering_analysis(d["images"], a, 3, ("kmeans",))
    assert found["clustered"].count() == a.count() and found["importance"].count() == 27 and found["anchors"].count() >= 1
    s = analyses.annotation_statistics(a, d["categories"], ["area"], ["iscrowd"])
    assert s["basics"].first().annotations == a.count() and s["numerical_area"].count() == 4
    assert analyses.split_by_resolution(d["images"], d["annotations"], str(tmp_path)).count() == d["images"].select("width", "height").distinct().count()
    assert analyses.tile_plan(d["images"]).count() > 0
    assert analyses.density(a.selectExpr("x / 40 AS x", "y / 60 AS y", "w / 40 AS w", "h / 60 AS h"))["sigma_1"].count() == 800
    assert '"basics":[{' in analyses.result_document(basics=s["basics"], breakdown=s["breakdown"]).first().document
    assert coco.image_files(spark, str(tmp_path)).isEmpty()


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(48).selectExpr("timestamp_seconds(1700000000 + id * 900) AS ts", "IF(id % 2 = 0, 'a', 'b') AS event_type").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(src))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("counted").collect()
    assert rows and all(r.n <= 2 for r in rows)
