"""Embedded metadata, small files, autoencoders and bottom-up clustering."""

import struct

import numpy as np
import pytest

from tessella.operators import clustering, encoder
from tessella.sources import embedded, files
from tessella.sources.coco import Options


def tiff(order):
    """A TIFF block with one main and one EXIF directory, written by hand."""
    e = "<" if order == b"II" else ">"
    entry = lambda tag, kind, n, value: struct.pack(e + "HHI", tag, kind, n) + value
    long = lambda v: struct.pack(e + "I", v)
    short = lambda v: struct.pack(e + "HH", v, 0)
    make, ratio, gps = b"Camera Co\0", struct.pack(e + "II", 28, 10), struct.pack(e + "IIIIII", 52, 1, 30, 1, 90, 6)
    main_at, exif_at, gps_at = 8, 8 + 2 + 12 * 4 + 4, 8 + 2 + 12 * 4 + 4 + 2 + 12 * 3 + 4
    data_at = gps_at + 2 + 12 * 2 + 4
    main = struct.pack(e + "H", 4) + entry(0x010F, 2, len(make), long(data_at)) + entry(0x0112, 3, 1, short(6)) + entry(0x8769, 4, 1, long(exif_at)) + entry(0x8825, 4, 1, long(gps_at)) + long(0)
    exif = struct.pack(e + "H", 3) + entry(0x829D, 5, 1, long(data_at + len(make))) + entry(0x9000, 7, 4, b"0230") + entry(0xFFFF, 3, 1, short(9)) + long(0)
    gps_dir = struct.pack(e + "H", 2) + entry(1, 2, 2, b"N\0\0\0") + entry(2, 5, 3, long(data_at + len(make) + 8)) + long(0)
    return order + struct.pack(e + "HI", 42, main_at) + main + exif + gps_dir + make + ratio + gps


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + (len(p) + 2).to_bytes(2, "big") + p for m, p in segments) + b"\xff\xda\x00\x02data"


WANT = {"Image Make": "Camera Co", "Image Orientation": "6", "EXIF FNumber": "14/5", "EXIF ExifVersion": "0230", "EXIF Tag 0xFFFF": "9", "GPS GPSLatitudeRef": "N", "GPS GPSLatitude": "[52, 30, 15]"}


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_exif_of_both_byte_orders(order):
    block = tiff(order)
    for data in (block, jpeg((0xE0, b"JFIF"), (0xE1, b"Exif\0\0" + block))):
        got = embedded.exif_fields(data)
        assert {k: v for k, v in got.items() if not k.endswith(("ExifOffset", "GPSInfo"))} == WANT


def test_iptc_and_damaged_files(spark):
    sets = lambda *x: b"".join(b"\x1c\x02" + bytes([n]) + len(v).to_bytes(2, "big") + v for n, v in x)
    block = b"\x1c\x01\x5a\x00\x03\x1b%G" + sets((5, b"Title"), (25, b"one"), (25, "zwei ü".encode()), (80, b""))
    resource = lambda kind, data: b"8BIM" + kind.to_bytes(2, "big") + b"\0\0" + len(data).to_bytes(4, "big") + data + b"\0" * (len(data) % 2)
    data = jpeg((0xED, b"Photoshop 3.0\0" + resource(0x03ED, b"abc") + resource(0x0404, block)))
    assert embedded.iptc_fields(data) == {"5": "Title", "25": "['one', 'zwei ü']"}
    rng = np.random.default_rng(0)
    whole = jpeg((0xE1, b"Exif\0\0" + tiff(b"II")), (0xED, b"Photoshop 3.0\0" + resource(0x0404, block)))
    for _ in range(300):
        broken = bytearray(whole[: rng.integers(0, len(whole))])
        for i in rng.integers(0, max(len(broken), 1), 3):
            if len(broken):
                broken[i] = rng.integers(0, 256)
        embedded.exif_fields(bytes(broken))
        embedded.iptc_fields(bytes(broken))
    rows = spark.createDataFrame([(1, whole), (2, b"junk"), (3, None)], "id int, content binary").select("id", embedded.exif().alias("e"), embedded.iptc().alias("i")).collect()
    got = {r.id: r for r in rows}
    assert got[1].e["Image Make"] == "Camera Co" and got[1].i["5"] == "Title" and got[2].e == got[3].i == {}


def test_small_files(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    files.save_npz(spark, a, str(tmp_path / "x.npz"))
    r = files.read_npz(spark, str(tmp_path / "*.npz")).first()
    assert r["shape"] == [2, 3] and r["values"] == a.ravel().tolist() and np.load(tmp_path / "x.npz")["arr"].tolist() == a.tolist()
    files.save_json(spark, {"n": np.int64(3), "a": a, "s": {2, 1}}, str(tmp_path / "x.json"))
    assert files.load_json(spark, str(tmp_path / "x.json")) == {"n": 3, "a": a.tolist(), "s": [1, 2]} == files.load_config(spark, str(tmp_path / "x.json"))
    (tmp_path / "c.yaml").write_text("max_iterations: 7\nepsilon: 1.0e-06\nother: {a: 1}\n")
    o = Options.of(files.load_config(spark, str(tmp_path / "c.yaml")))
    assert (o.max_iterations, o.epsilon) == (7, 1e-6)
    (tmp_path / "e.yaml").write_text("")
    assert files.load_config(spark, str(tmp_path / "e.yaml")) == {}
    keys = spark.createDataFrame([("a", 1, 0.5, [1, 2]), ("b", 1, 0.25, [3, 4])], "image_name string, keypoint_id int, x_coord double, descriptor array<int>")
    files.save_keypoints(keys, str(tmp_path / "k"), "original", 2)
    back = spark.read.option("header", True).csv(str(tmp_path / "k"))
    assert {(r.file, r.x_coord, r.descriptor_1) for r in back.collect()} == {("a_original_keypoints", "0.5", "2"), ("b_original_keypoints", "0.25", "4")}
    files.save_clustered(spark, keys.drop("descriptor"), "said", str(tmp_path / "c"))
    assert (tmp_path / "c" / "report.txt").read_text() == "said"


def test_an_image_has_one_keypoint_file_however_its_rows_lie(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).selectExpr("concat('img', id % 3) AS image_name", "id AS keypoint_id", "array(id, 7) AS descriptor")
    files.save_keypoints(rows, str(tmp_path / "k"), descriptors=1)
    assert sorted(len(list(d.glob("*.csv"))) for d in (tmp_path / "k").iterdir() if d.is_dir()) == [1, 1, 1]
    assert {(r.file, int(r.descriptor_0)) for r in files.read_keypoints(spark, str(tmp_path / "k")).collect()} == {(f"img{i % 3}_normalized_keypoints", i) for i in range(40)}


@pytest.mark.parametrize("architecture", encoder.ARCHITECTURES)
def test_autoencoders_learn(architecture):
    rng = np.random.default_rng(1)
    hidden = rng.normal(size=(600, 2))
    x = np.c_[hidden @ rng.normal(size=(2, 8)), np.full(600, 3.0)]
    net = encoder.fit_arrays(x, [f"f{i}" for i in range(9)], 3, architecture, epochs=25)
    assert len(net.losses) == 25 and net.losses[-1] < net.losses[0] and net.encode(x).shape == (600, 3)
    assert architecture == "variational" or (net.encode(x) >= 0).all()
    assert encoder.layer_sizes(40, None, "deep") == ([40, 20, 15, 10], [10, 15, 20, 40])


def test_gradients_of_an_autoencoder():
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=3)), (rng.normal(size=(3, 4)), rng.normal(size=4))]
    x, t = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    loss = lambda: ((encoder._passed(x, layers, rng, [0.0, 0.0], "sigmoid")[0] - t) ** 2).sum()
    out, tape = encoder._passed(x, layers, rng, [0.0, 0.0], "sigmoid")
    _, grads = encoder._back(2 * (out - t), layers, tape)
    for layer, grad in zip(layers, grads, strict=True):
        for p, g in zip(layer, grad, strict=True):
            i = tuple(rng.integers(0, n) for n in p.shape)
            old, p[i] = p[i], p[i] + 1e-6
            up = loss()
            p[i] = old - 1e-6
            assert g[i] == pytest.approx((up - loss()) / 2e-6, rel=1e-4, abs=1e-6)
            p[i] = old


def test_encoded_tables(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) + np.repeat([[0], [6]], 100, 0)
    df = spark.createDataFrame([(i, int(i >= 100), *map(float, v)) for i, v in enumerate(x)], "id long, label int, a double, b double, c double, d double")
    net = encoder.fit(df, ["a", "b", "c", "d"], 2, "shallow", epochs=20)
    out = encoder.encoded(df, net)
    r = out.orderBy("id").first()
    assert np.allclose(r.encoded, net.encode(x[:1])[0]) and r.reconstruction_error == pytest.approx(net.error(x[:1])[0])
    assert encoder.reconstruction(out).first().rows == 200
    assert {r.feature for r in encoder.importance_from_codes(out, net).collect()} == {"a", "b", "c", "d"}
    table, names = encoder.as_table(out, 2)
    assert table.columns == ["id", *names]
    assert encoder.encoded(df.limit(0), net).collect() == []


def brute_ward(points, k):
    groups = [[i] for i in range(len(points))]
    spread = lambda g: ((points[g] - points[g].mean(0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: spread(groups[p[0]] + groups[p[1]]) - spread(groups[p[0]]) - spread(groups[p[1]]))
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def test_ward_against_all_merges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40, 2)) + rng.integers(0, 3, (40, 1)) * 4
    for k in (1, 3, 7):
        label = clustering.ward_labels(points, np.ones(40), k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == brute_ward(points, k)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(40, *map(float, points[0]))], "id long, f double, g double")
    got = {r.id: r.label for r in clustering.cluster(df, ["f", "g"], "hierarchical", 3).collect()}
    assert got[40] == got[0] and {frozenset(i for i in range(40) if got[i] == c) for c in set(got.values())} == brute_ward(points, 3)
    monkeypatch.setattr(clustering, "WARD_POINTS", 12)
    assert len({r.label for r in clustering.cluster(df, ["f", "g"], "hierarchical", 3).collect()}) == 3
