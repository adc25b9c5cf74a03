"""Rings as tables of edges, self-intersection, convex hulls and distances of convex shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def edges(rings: DataFrame, ring: str = "ring", key: str = "id") -> DataFrame:
    """(key, i, n, ax, ay, bx, by) of closed flat rings; an odd number of coordinates fails."""
    odd = F.expr(f"IF(size({ring}) % 2 = 1, raise_error('a ring needs pairs of coordinates'), CAST(size({ring}) / 2 AS INT))")
    r = rings.select(key, F.col(ring).alias("p"), odd.alias("n")).where("n > 0")
    return r.withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).selectExpr(key, "i", "n", "p[2 * i] AS ax", "p[2 * i + 1] AS ay", "p[2 * ((i + 1) % n)] AS bx", "p[2 * ((i + 1) % n) + 1] AS by")


#: Rings of up to so many corners are checked within their row.
SHORT_RING = 64


def _crossing(s: str, t: str, eps: float) -> tuple[str, str]:
    """SQL text: whether segments s and t, with ends ax.. and bx.., properly cross, and the struct of where."""
    side = lambda a, b, p: f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"
    d1, d2 = side(f"{t}.a", f"{t}.b", f"{s}.a"), side(f"{t}.a", f"{t}.b", f"{s}.b")
    d3, d4 = side(f"{s}.a", f"{s}.b", f"{t}.a"), side(f"{s}.a", f"{s}.b", f"{t}.b")
    opposite = lambda a, b: f"(({a} > {eps} AND {b} < -{eps}) OR ({a} < -{eps} AND {b} > {eps}))"
    at = f"{d1} / ({d1} - {d2})"
    return f"{opposite(d1, d2)} AND {opposite(d3, d4)}", f"struct({s}.ax + ({s}.bx - {s}.ax) * ({at}) AS x, {s}.ay + ({s}.by - {s}.ay) * ({at}) AS y)"


def self_intersections(rings: DataFrame, ring: str = "ring", key: str = "id", eps: float = EPS) -> DataFrame:
    """(key, intersects, px, py): whether edges that aren't neighbours properly cross, and the crossing of least (x, y).

    Touching and collinear edges don't count, nor do rings of under four corners. Short rings are
    looked at within their row; the edges of longer ones meet in a join on the ring.
    """
    odd = F.expr(f"IF(size({ring}) % 2 = 1, raise_error('a ring needs pairs of coordinates'), CAST(size({ring}) / 2 AS INT))")
    r = rings.select(F.col(key).alias("k"), F.col(ring).alias("p"), odd.alias("n"))
    hit, where = _crossing("s", "t", eps)
    segment = "struct(p[2 * i] AS ax, p[2 * i + 1] AS ay, p[2 * ((i + 1) % n)] AS bx, p[2 * ((i + 1) % n) + 1] AS by)"
    # the pairs of edges i < j that are not neighbours; the last edge is the first one's neighbour
    later = "slice(e, i + 3, greatest(0, n - i - 2 - IF(i = 0, 1, 0)))"
    inside = f"flatten(transform(e, (s, i) -> transform(filter({later}, t -> {hit}), t -> {where})))"
    short = r.where(f"n IS NULL OR n <= {SHORT_RING}").withColumn("e", F.expr(f"IF(n < 4, NULL, transform(sequence(0, n - 1), i -> {segment}))"))
    short = short.select("k", F.expr(f"array_min({inside})").alias("found"))
    e = edges(rings, ring, key).where(f"n > {SHORT_RING}")
    s, t = e.alias("s"), e.alias("t")
    pairs = s.join(t, (F.col(f"s.{key}") == F.col(f"t.{key}")) & F.expr("s.i < t.i AND t.i - s.i NOT IN (1, s.n - 1)")).where(hit)
    found = pairs.select(F.col(f"s.{key}").alias("of"), F.expr(where).alias("at")).groupBy("of").agg(F.min("at").alias("found"))
    long = r.where(f"n > {SHORT_RING}").select("k").join(found, F.col("k") == F.col("of"), "left").select("k", "found")
    return short.union(long).select(F.col("k").alias(key), F.col("found").isNotNull().alias("intersects"), F.col("found.x").alias("px"), F.col("found.y").alias("py"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the strict convex hull, counter-clockwise from the least (x, y); up to two distinct points come back as they are."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    if len(p) > 1000:
        p = p[~inside_extremes(p)]

    def chain(q: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out

    low, high = chain(p), chain(p[::-1])
    return np.array(low[:-1] + high[:-1])


def inside_extremes(p: np.ndarray) -> np.ndarray:
    """True for points strictly inside the quadrilateral of the extreme points."""
    quad = p[[p[:, 0].argmin(), p[:, 1].argmin(), p[:, 0].argmax(), p[:, 1].argmax()]]
    out = np.ones(len(p), bool)
    for a, b in zip(quad, np.roll(quad, -1, axis=0), strict=True):
        if (a != b).any():
            out &= (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) > 0
    return out


def convex_hulls(rings: DataFrame, ring: str = "ring", key: str = "id", tolerance: float | None = None) -> DataFrame:
    """(key, hull): flat hulls of flat rings; tolerance: coordinates are rounded to it first."""

    @F.pandas_udf("array<double>")
    def f(c: pd.Series) -> pd.Series:
        out = []
        for x in c:
            p = np.array([] if x is None else x, float).reshape(-1, 2)
            out.append(hull(np.round(p / tolerance) * tolerance if tolerance else p).ravel().tolist())
        return pd.Series(out)

    return rings.select(key, f(ring).alias("hull"))


def hull_candidates(points: DataFrame, key: str) -> DataFrame:
    """Rows (key, x, y) that can be hull corners: a cloud's extremes in sixteen directions and all outside their polygon.

    This is the step for clouds larger than a task: it needs one aggregate and one join.
    """
    turns = [(np.cos(a), np.sin(a)) for a in np.arange(16) * np.pi / 8]
    best = points.groupBy(key).agg(*[F.max_by(F.struct("x", "y"), F.struct(F.col("x") * float(c) + F.col("y") * float(s), "x", "y")).alias(f"e{i}") for i, (c, s) in enumerate(turns)])
    inside = F.lit(True)
    for i in range(16):
        a, b = f"e{i}", f"e{(i + 1) % 16}"
        cross = F.expr(f"({b}.x - {a}.x) * (y - {a}.y) - ({b}.y - {a}.y) * (x - {a}.x)")
        inside = inside & F.expr(f"({a}.x <> {b}.x OR {a}.y <> {b}.y)").__and__(cross > 0).__or__(F.expr(f"{a}.x = {b}.x AND {a}.y = {b}.y"))
    return points.join(best, key).where(~inside).select(key, "x", "y")


def cloud_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, hull) of point rows (key, x, y)."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hull": [hull(pdf[["x", "y"]].to_numpy()).ravel().tolist()]})

    return hull_candidates(points, key).distinct().groupBy(key).applyInPandas(f, f"{key} long, hull array<double>")


def support(shape: dict, d: np.ndarray) -> np.ndarray:
    """The shape's point farthest along d; the first one on ties. Shapes: points, circle/sphere, box, ellipse, capsule."""
    kind = shape["kind"]
    n = np.linalg.norm(d)
    unit = d / n if n > 0 else np.zeros_like(d)
    if kind == "points":
        p = shape["points"]
        return p[int((p @ d).argmax())]
    center = np.asarray(shape["center"], float) if "center" in shape else np.zeros_like(d)
    if kind in ("circle", "sphere"):
        return center + shape["radius"] * unit
    if kind == "box":
        return center + np.where(d >= 0, 0.5, -0.5) * np.asarray(shape["size"], float)
    if kind == "ellipse":
        ax = np.asarray(shape["axes"], float)
        m = np.linalg.norm(ax * d)
        return center + (ax * ax * d / m if m > 0 else 0)
    if kind == "capsule":
        p = np.asarray(shape["points"], float)
        return p[int((p @ d).argmax())] + shape["radius"] * unit
    raise ValueError(f"unknown shape {kind!r}")


def _nearest_to_origin(simplex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, point): the point of the simplex nearest to the origin, over all its faces."""
    best, weights = None, None
    n = len(simplex)
    for mask in range(1, 1 << n):
        rows = [i for i in range(n) if mask >> i & 1]
        p = simplex[rows]
        if len(rows) == 1:
            w = np.ones(1)
        else:
            e = p[1:] - p[0]
            w, *_ = np.linalg.lstsq(e @ e.T, -e @ p[0], rcond=None)
            w = np.r_[1 - w.sum(), w]
            if (w < -1e-12).any():
                continue
        x = w @ p
        if best is None or x @ x < best @ best - 1e-18:
            best, weights = x, np.zeros(n)
            weights[rows] = w
    return weights, best


def gjk(a: dict, b: dict, dim: int, most: int = 128, tolerance: float = 1e-9) -> tuple[bool, float, np.ndarray, np.ndarray, int]:
    """(hit, distance, point on a, point on b, iterations) of two convex shapes."""
    d = np.zeros(dim)
    d[0] = 1.0
    pa, pb = [support(a, d)], [support(b, -d)]
    weights = np.ones(1)
    v = pa[0] - pb[0]
    for step in range(1, most + 1):
        if v @ v < tolerance**2:
            return True, 0.0, weights @ np.array(pa), weights @ np.array(pb), step
        x, y = support(a, -v), support(b, v)
        if v @ v - v @ (x - y) <= tolerance * max(1.0, np.sqrt(v @ v)):
            return False, float(np.sqrt(v @ v)), weights @ np.array(pa), weights @ np.array(pb), step
        pa.append(x)
        pb.append(y)
        weights, v = _nearest_to_origin(np.array(pa) - np.array(pb))
        keep = np.flatnonzero(weights > 0)
        pa, pb, weights = [pa[i] for i in keep], [pb[i] for i in keep], weights[keep]
        if len(pa) == dim + 1:
            return True, 0.0, weights @ np.array(pa), weights @ np.array(pb), step
    return bool(v @ v < tolerance), float(np.sqrt(v @ v)), weights @ np.array(pa), weights @ np.array(pb), most


def with_radii(hit: bool, distance: float, p: np.ndarray, q: np.ndarray, ra: float, rb: float) -> tuple[bool, float, np.ndarray, np.ndarray]:
    """The same for shapes grown by radii; in contact both points are the middle."""
    if hit or distance <= ra + rb:
        middle = (p + q) / 2
        return True, 0.0, middle, middle
    n = (q - p) / distance
    return False, distance - ra - rb, p + n * ra, q - n * rb


def moved(shape: dict, rotation: np.ndarray, position: np.ndarray) -> dict:
    """A polyhedron rotated (row vectors times a 3 x 3 matrix) and shifted."""
    return shape | {"points": np.asarray(shape["points"], float) @ np.asarray(rotation, float).reshape(3, 3) + position}


def _nearest_on_segments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The points of segments a[i] b[i] nearest to the origin."""
    e = b - a
    ee = (e * e).sum(1)
    t = np.clip(-(a * e).sum(1) / np.where(ee > 0, ee, 1), 0, 1)
    return a + t[:, None] * e


def gjk_many(a: np.ndarray, b: np.ndarray, most: int = 128, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(hit, distance) of the convex hulls of points a[i] and b[i], arrays [pairs, corners, 2]: `gjk` in the plane for all pairs at once."""
    n = len(a)
    hit, distance = np.zeros(n, bool), np.zeros(n)
    at = np.arange(n)
    p = q = v = a[:, 0] - b[:, 0]
    for _ in range(most):
        if not len(at):
            return hit, distance
        rows = np.arange(len(at))
        far_a = np.einsum("nij,nj->ni", a, v).argmin(1)
        far_b = np.einsum("nij,nj->ni", b, v).argmax(1)
        w = a[rows, far_a] - b[rows, far_b]
        vv = (v * v).sum(1)
        touch = vv < tolerance**2
        apart = ~touch & (vv - (v * w).sum(1) <= tolerance * np.maximum(1, np.sqrt(vv)))
        # the triangle of the segment p q and w holds the origin if all three turns have one sign
        cross = lambda x, y: x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]
        turns = np.stack([cross(p, q), cross(q, w), cross(w, p)])
        held = ~touch & ~apart & ((turns > 0).all(0) | (turns < 0).all(0))
        hit[at[touch | held]] = True
        distance[at[apart]] = np.sqrt(vv[apart])
        on = ~(touch | apart | held)
        at, a, b, p, q, w = at[on], a[on], b[on], p[on], q[on], w[on]
        x, y = _nearest_on_segments(p, w), _nearest_on_segments(q, w)
        first = ((x * x).sum(1) <= (y * y).sum(1))[:, None]
        v = np.where(first, x, y)
        p, q = np.where(first, p, q), w
    vv = (v * v).sum(1)
    hit[at], distance[at] = vv < tolerance, np.sqrt(vv)
    return hit, distance


#: Numbers that a block of pairs of rings holds at once, padding included.
PAIR_BLOCK = 1 << 20


def ring_distances(pairs: DataFrame, a: str = "ring_a", b: str = "ring_b") -> DataFrame:
    """The pairs plus hit and distance between the convex hulls of two flat rings; without points in one of them both are null."""
    from pyspark.sql import types as T

    kept = [f for f in pairs.schema.fields if f.name not in (a, b)]
    out = T.StructType([*kept, T.StructField("hit", T.BooleanType()), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats, starts, sizes = [], [], []
            for c in (a, b):
                column = batch.column(c)
                flats.append(column.values.to_numpy(zero_copy_only=False).astype(float, copy=False))
                starts.append(column.offsets.to_numpy()[:-1])
                sizes.append(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0))
                if (sizes[-1] % 2).any():
                    raise ValueError("a ring needs pairs of coordinates")
            some = np.flatnonzero((sizes[0] > 0) & (sizes[1] > 0))
            hit, distance = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows)
            # pairs of like sizes go together, so that one long ring does not pad all others
            some = some[np.lexsort((sizes[1][some], sizes[0][some]))]
            while len(some):
                wide = np.maximum.accumulate(sizes[0][some] + sizes[1][some])
                take = max(1, int((wide * np.arange(1, len(some) + 1) <= PAIR_BLOCK).sum()))
                now, some = some[:take], some[take:]
                rings = []
                for flat, start, size in zip(flats, starts, sizes, strict=True):
                    # shorter rings repeat their last corner
                    corner = np.minimum(np.arange(size[now].max() // 2), size[now][:, None] // 2 - 1)
                    first = start[now][:, None] + 2 * corner
                    rings.append(np.stack([flat[first], flat[first + 1]], axis=2))
                hit[now], distance[now] = gjk_many(*rings)
            none = (sizes[0] == 0) | (sizes[1] == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(hit, mask=none), pa.array(distance, mask=none)], names=out.names)

    return pairs.mapInArrow(run, out)


def collinear_filtered(points: DataFrame, key: str, eps: float = 1e-10) -> DataFrame:
    """Of points (key, angle, d2) with equal angles in order only the farthest."""
    w = Window.partitionBy(key).orderBy("angle", "d2")
    return points.withColumn("_next", F.lead("angle").over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col("angle") >= eps)).drop("_next")


def polar(points: DataFrame, key: str) -> DataFrame:
    """Points (key, x, y) plus angle and squared distance from the key's pivot, its lowest then leftmost point."""
    pivot = points.groupBy(key).agg(F.min(F.struct("y", "x")).alias("_p"))
    return points.join(pivot, key).selectExpr(f"{key}", "x", "y", "atan2(y - _p.y, x - _p.x) AS angle", "power(x - _p.x, 2) + power(y - _p.y, 2) AS d2")
