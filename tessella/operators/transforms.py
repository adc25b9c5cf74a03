"""Annotation transforms by homographies, and the matching that finds these."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area, transform_box, transform_ring


def match_files(originals: DataFrame, corrected: DataFrame) -> DataFrame:
    """(original, corrected): for each original name the first corrected one that is equal to it or holds its stem (up to the first dot).

    The parts of corrected names that are as long as some stem meet stems by equality. Names are
    short, so that there are few such lengths.
    """
    o = originals.select(F.col("name").alias("original"), F.substring_index("name", ".", 1).alias("stem"))
    c = corrected.select(F.col("name").alias("corrected"))
    same = o.join(c, F.col("original") == F.col("corrected")).select("original", "corrected")
    lengths = o.select(F.length("stem").alias("n")).where("n > 0").distinct()
    parts = c.join(F.broadcast(lengths), F.length("corrected") >= F.col("n")).select("corrected", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(corrected) - n + 1), i -> substr(corrected, i, n))"))).alias("stem"))
    held = o.join(parts, "stem").select("original", "corrected")
    # every name holds an empty stem
    first = c.agg(F.min("corrected").alias("corrected"))
    empty = o.where("stem = ''").select("original").crossJoin(F.broadcast(first)).where("corrected IS NOT NULL")
    return same.union(held).union(empty).groupBy("original").agg(F.min("corrected").alias("corrected"))


def basenames(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, path): the last path, in order, of each base name."""
    return files.groupBy(F.regexp_extract(path, r"([^/]*)$", 1).alias("name")).agg(F.max(path).alias("path"))


def mutual_matches(a: DataFrame, b: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, a_id, b_id, distance): rows (pair, id, words array<long>) that are each other's nearest by differing bits; ties to the smaller id.

    The two sides of a pair meet in a task, which holds a block of their distances at a time. Words are of one length.
    """
    side = lambda t: t.where(F.col(pair).isNotNull() & F.col("words").isNotNull()).select(pair, "id", F.col("words").cast("array<long>").alias("words"))
    left, right = side(a), side(b)
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"{pair} {kind(left, pair)}, a_id {kind(left, 'id')}, b_id {kind(right, 'id')}, distance int"

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        # in order of id, so that the first of equal distances has the smaller one
        x, y = x.sort_by("id"), y.sort_by("id")
        p, q = (np.array(t.column("words").to_pylist(), np.int64).reshape(t.num_rows, -1) if t.num_rows else None for t in (x, y))
        found = ([], [], [])
        if p is not None and q is not None:
            found = nearest_of_each_other(p, q)
        first, second, distance = map(np.asarray, found, (np.int64, np.int64, np.int32))
        return pa.table({pair: x.column(pair).take(pa.array(first)), "a_id": x.column("id").take(pa.array(first)), "b_id": y.column("id").take(pa.array(second)), "distance": pa.array(distance, pa.int32())})

    return left.groupBy(pair).cogroup(right.groupBy(pair)).applyInArrow(run, schema)


#: Distances between the words of two sides that a task holds at once.
DISTANCES = 1 << 20


def nearest_of_each_other(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of rows p[i] and q[j] that are each other's first nearest by differing bits, in blocks of rows."""
    to_q, least_q = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    to_p, least_p = np.zeros(len(q), np.int64), np.full(len(q), np.iinfo(np.int64).max)
    step = max(1, DISTANCES // len(q))
    for at in range(0, len(p), step):
        d = np.zeros((len(p[at : at + step]), len(q)), np.int64)
        for k in range(p.shape[1]):
            d += np.bitwise_count((p[at : at + step, k, None] ^ q[None, :, k]).view(np.uint64))
        to_q[at : at + step], least_q[at : at + step] = d.argmin(1), d.min(1)
        low = d.min(0)
        to_p = np.where(low < least_p, at + d.argmin(0), to_p)
        least_p = np.minimum(low, least_p)
    i = np.flatnonzero(to_p[to_q] == np.arange(len(p)))
    return i, to_q[i], least_q[i]


def good_matches(matches: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Matches within mean + half a deviation; if these are under ten, the nearest max(10, half); pairs with under four have none.

    With whole distances the rule is looked at in whole numbers, n d - S <= 0 or 4 (n d - S)^2 <= n Q - S^2
    for sum S and sum of squares Q: a mean and a deviation end in bits that depend on the order of the
    rows, and a distance can lie exactly on the limit.
    """
    w = Window.partitionBy(pair)
    d = F.col("distance")
    x = matches.withColumns({"_n": F.count("*").over(w), "_s": F.sum(d).over(w), "_q": F.sum(d * d).over(w), "_rank": F.row_number().over(w.orderBy("distance", "a_id"))})
    over = F.col("_n") * d - F.col("_s")
    within = (over <= 0) | (4 * over * over <= F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"))
    x = x.withColumn("_within", within).withColumn("_good", F.count_if("_within").over(w))
    keep = F.when(F.col("_good") < 10, F.col("_rank") <= F.greatest(F.lit(10), F.floor(F.col("_n") / 2))).otherwise(F.col("_within"))
    x = x.where(keep).withColumn("_left", F.count("*").over(w)).where("_left >= 4")
    return x.drop("_n", "_s", "_q", "_rank", "_within", "_good", "_left")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map that sends src to dst with least algebraic error, points normalised; None for degenerate ones."""

    def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-12)
        return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, ta = norm(src)
    b, tb = norm(dst)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, s, vt = np.linalg.svd(np.array(rows))
    if len(s) >= 9 and s[7] < 1e-10:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def ransac(src: np.ndarray, dst: np.ndarray, tolerance: float = 5.0, rounds: int = 2000, confidence: float = 0.99, seed: int = 0) -> np.ndarray | None:
    """A homography refitted on the largest set of matches within the tolerance."""
    if len(src) < 4:
        return None
    rng, best, left = np.random.default_rng(seed), np.zeros(len(src), bool), rounds
    step = 0
    while step < left:
        step += 1
        h = homography(src[i := rng.choice(len(src), 4, replace=False)], dst[i])
        if h is None:
            continue
        p = np.c_[src, np.ones(len(src))] @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = np.linalg.norm(p[:, :2] / p[:, 2:] - dst, axis=1) <= tolerance
        if ok.sum() > best.sum():
            best = ok
            share = min(ok.mean() ** 4, 1 - 1e-12)
            left = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(1 - share)))) if share > 0 else rounds
    return homography(src[best], dst[best]) if best.sum() >= 4 else None


def homographies(matches: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, matrix array<double>) from matched points (pair, ax, ay, bx, by); null where none fits. A pair's matches are one task's."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ax", "ay", "bx", "by"])
        h = ransac(pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by"]].to_numpy(float))
        return pd.DataFrame({pair: [pdf[pair].iloc[0]], "matrix": [None if h is None else h.ravel().tolist()]})

    return matches.groupBy(pair).applyInPandas(f, f"{pair} long, matrix array<double>")


def transform_dataset(images: DataFrame, annotations: DataFrame, corrected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations under the corrections (image_id, matrix, width, height): images without one go, with their annotations.

    Boxes of a pixel or less and annotations whose rings all vanish go; kept rings have three corners and an area over 1.
    """
    c = corrected.where("matrix IS NOT NULL").select("image_id", F.col("matrix").alias("m"), F.col("width").cast("double").alias("tw"), F.col("height").cast("double").alias("th"))
    new_images = images.drop("width", "height").join(c.select(F.col("image_id").alias("id"), F.col("tw").cast("int").alias("width"), F.col("th").cast("int").alias("height")), "id")
    a = annotations.join(c, "image_id").withColumn("_box", transform_box("m", "tw", "th")).where("_box IS NOT NULL")
    rings = F.transform("segmentation", lambda p: p)
    mapped = a.withColumn("_id", F.monotonically_increasing_id()).withColumn("_had", F.size(rings) > 0)
    ring = transform_ring("m", "r", "tw", "th")
    parts = mapped.select("_id", "m", "tw", "th", F.posexplode("segmentation").alias("k", "r")).select("_id", "k", ring.alias("r")).where("size(r) >= 6").where(polygon_area("r") > 1)
    kept = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("s")).select("_id", F.transform("s", lambda x: x["r"]).alias("_rings"))
    out = mapped.join(kept, "_id", "left").where("NOT _had OR _rings IS NOT NULL")
    out = out.withColumns({"bbox": F.col("_box"), "x": F.col("_box")[0], "y": F.col("_box")[1], "w": F.col("_box")[2], "h": F.col("_box")[3], "area": F.col("_box")[2] * F.col("_box")[3], "segmentation": F.coalesce("_rings", F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"))})
    return new_images, out.drop("_box", "_id", "_had", "_rings", "m", "tw", "th")
