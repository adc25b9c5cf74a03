"""Image-quality aggregates over pixel rows (image_id, y, x, r, g, b), and array filters per image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import grayscale

LUMINANCE = "(0.2126D * r + 0.7152D * g + 0.0722D * b)"


def _lightness() -> str:
    """SQL text of CIE L* scaled to 0..255 for sRGB bytes."""
    lin = lambda c: f"IF({c} / 255D <= 0.04045D, {c} / 255D / 12.92D, power(({c} / 255D + 0.055D) / 1.055D, 2.4D))"
    y = f"(0.212671D * {lin('r')} + 0.715160D * {lin('g')} + 0.072169D * {lin('b')})"
    return f"(IF({y} > 0.008856D, 116 * power({y}, 1 / 3D) - 16, 903.3D * {y}) * 255 / 100)"


def luminance(pixels: DataFrame) -> DataFrame:
    lum = F.expr(LUMINANCE)
    out = pixels.groupBy("image_id").agg(F.avg(lum).alias("mean"), F.stddev_pop(lum).alias("std"), F.min(lum).alias("min"), F.max(lum).alias("max"), F.avg(F.expr(_lightness())).alias("mean_lightness"), F.avg(F.greatest("r", "g", "b")).alias("mean_value"))
    counts = pixels.groupBy("image_id", lum.alias("lum")).agg(F.count("*").alias("n")).where("lum IS NOT NULL")
    median = _quantiles(counts, "lum", (0.5,)).select("image_id", F.col("q")[0].alias("median"))
    return out.join(median, "image_id").withColumn("range", F.col("max") - F.col("min"))


def exposure(pixels: DataFrame) -> DataFrame:
    """Shares of over- and under-exposed pixels with flags over 2 %, and of each channel's pixels clipped high and low."""
    p = pixels.withColumn("gray", grayscale())
    pct = lambda c: F.avg(F.expr(c).cast("double")) * 100
    clipped = [pct(f"{c} {rule}").alias(f"clip_{c}_{end}_pct") for c in "rgb" for end, rule in (("high", ">= 250"), ("low", "<= 5"))]
    out = p.groupBy("image_id").agg(F.count_if(F.expr("gray >= 240")).alias("over_count"), F.count_if(F.expr("gray <= 15")).alias("under_count"), pct("gray >= 240").alias("over_pct"), pct("gray <= 15").alias("under_pct"), *clipped)
    return out.withColumns({"over_exposed": F.col("over_pct") > 2, "under_exposed": F.col("under_pct") > 2, "has_issues": (F.col("over_pct") > 2) | (F.col("under_pct") > 2)})


def gray_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, gray, n): an image's histogram, 256 rows at most."""
    return pixels.groupBy("image_id", grayscale().alias("gray")).agg(F.count("*").alias("n"))


def tones(pixels: DataFrame) -> DataFrame:
    """Shadows, midtones and highlights in percent, the histogram's centre, entropy and fullest bin (lowest on ties), and which end holds over half."""
    h = gray_counts(pixels)
    total = h.groupBy("image_id").agg(F.sum("n").alias("_t"))
    share = h.join(total, "image_id").withColumn("p", F.col("n") / F.col("_t"))
    band = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)) * 100 / F.max("_t")
    out = share.groupBy("image_id").agg(band("gray < 85").alias("shadows"), band("gray >= 85 AND gray < 171").alias("midtones"), band("gray >= 171").alias("highlights"), F.sum(F.col("gray") * F.col("p")).alias("center"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.max_by("gray", F.struct("n", -F.col("gray"))).alias("fullest"))
    return out.withColumn("tone", F.expr("CASE WHEN shadows > 50 THEN 'shadows-heavy' WHEN highlights > 50 THEN 'highlights-heavy' ELSE 'balanced' END"))


def _quantiles(counts: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(image_id, q array, low, high): linear quantiles and extremes of an image's values, from running counts over rows (image_id, value, n).

    A task passes over an image's counts in order and doesn't hold them.
    """
    w = Window.partitionBy("image_id")
    h = counts.withColumns({"last": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    at_rank = lambda rank: F.min(F.when(F.col("last") > rank, F.col(value)))
    at = [F.lit(p) * (F.col("all") - 1) for p in shares]
    out = h.groupBy("image_id").agg(*[at_rank(f(x)).alias(f"v{i}{j}") for i, x in enumerate(at) for j, f in enumerate((F.floor, F.ceil))], *[F.max(x - F.floor(x)).alias(f"f{i}") for i, x in enumerate(at)], F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select("image_id", F.array(*[F.expr(f"v{i}0 * (1 - f{i}) + v{i}1 * f{i}") for i in range(len(shares))]).alias("q"), "low", "high")


def _gray_quantiles(pixels: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    return _quantiles(gray_counts(pixels), "gray", shares)


def dynamic_range(pixels: DataFrame) -> DataFrame:
    out = _gray_quantiles(pixels, (0.01, 0.05, 0.95, 0.99)).selectExpr("image_id", "q[0] AS p1", "q[1] AS p5", "q[2] AS p95", "q[3] AS p99", "CAST(high - low AS DOUBLE) AS range_full")
    return out.selectExpr("*", "p95 - p5 AS range_90", "p99 - p1 AS range_98", "(p99 - p1) / 255 * 100 AS utilization", "(p99 - p1) / 255 * 100 > 70 AS good_range")


#: By the share of pixels over or under exposed: from which percentage on, stops, and words.
_STOPS = ((10, 2.0, "Significantly", "by 2+ stops"), (5, 1.0, "", "by 1 stop"), (2, 0.5, "Slightly", "by 0.5 stops"))


def exposure_advice(pixels: DataFrame) -> DataFrame:
    """Compensation in stops, recommendations and a quality word, from mean gray and exposure shares.

    Over-exposure is looked at before under-exposure, either only beyond 2 %; then dark and bright
    means. A balanced image gets a second sentence by which end of its histogram holds more.
    """
    pct = lambda c: F.avg(F.expr(c).cast("double")) * 100
    g = pixels.withColumn("gray", grayscale()).groupBy("image_id").agg(F.avg("gray").alias("mean"), pct("gray >= 240").alias("over_pct"), pct("gray <= 15").alias("under_pct"), F.count_if(F.expr("gray < 50")).alias("dark"), F.count_if(F.expr("gray >= 200")).alias("bright"))
    cases = []
    for column, word, verb, sign in (("over_pct", "overexposed", "reduce", -1), ("under_pct", "underexposed", "increase", 1)):
        cases += [(f"{column} > {least}", sign * stops, f"{f'{how} {word}'.strip().capitalize()} - {verb} exposure {much}") for least, stops, how, much in _STOPS]
    cases += [("mean < 85", 0.5, "Image appears dark - consider increasing exposure"), ("mean > 170", -0.5, "Image appears bright - consider reducing exposure")]
    stops = "CASE " + " ".join(f"WHEN {c} THEN {v}D" for c, v, _ in cases) + " ELSE 0D END"
    balanced = "array('Exposure appears well-balanced', CASE WHEN dark > bright THEN 'Consider slight exposure increase for better shadow detail' WHEN bright > dark THEN 'Consider slight exposure decrease to prevent highlight clipping' END)"
    advice = "CASE " + " ".join(f"WHEN {c} THEN array('{t}')" for c, _, t in cases) + f" ELSE array_compact({balanced}) END"
    quality = "CASE WHEN over_pct > 10 OR under_pct > 10 THEN 'Poor' WHEN over_pct > 5 OR under_pct > 5 THEN 'Fair' WHEN over_pct < 1 AND under_pct < 1 AND mean BETWEEN 85 AND 170 THEN 'Excellent' ELSE 'Good' END"
    return g.selectExpr("image_id", "mean", f"{stops} AS compensation", f"{advice} AS recommendations", f"{quality} AS quality")


def normalized_gray(pixels: DataFrame, low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Gray stretched between two percentiles of its image, held within 0 to 255."""
    p = pixels.select("image_id", "y", "x", grayscale().alias("gray"))
    stretched = "CAST(floor(least(1D, greatest(0D, coalesce(try_divide(gray - q[0], q[1] - q[0]), 0D))) * 255) AS INT)"
    return p.join(_gray_quantiles(pixels, (low, high)), "image_id").selectExpr("image_id", "y", "x", f"{stretched} AS gray")


#: Values that f is given at once, about, so that what it makes of them stays in a core's cache; a larger image comes alone.
AT_ONCE = 1 << 17


def per_image(images: DataFrame, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """f over images of one size at once: rows (image_id, height, width, values array<double>), planes after each other; schema begins with image_id.

    f takes [n, planes, height, width] and gives n values by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column("image_id"), batch.column("values")
            h, w, n = (c.to_numpy(zero_copy_only=False) for c in (batch.column("height"), batch.column("width"), pc.list_value_length(values)))
            kinds, kind = np.unique(np.stack([h, w, n]).astype(np.int64), axis=1, return_inverse=True)
            for k, (height, width, size) in enumerate(kinds.T.tolist()):
                of_kind, step = np.flatnonzero(kind.ravel() == k), max(1, AT_ONCE // max(size, 1))
                for at in (of_kind[i : i + step] for i in range(0, len(of_kind), step)):
                    take = pa.array(at)
                    planes = values.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1, height, width)
                    found = {"image_id": ids.take(take)} | f(planes)
                    yield pa.RecordBatch.from_arrays([pa.array(found[c.name]).cast(c.type) for c in kind_of], schema=kind_of)

    kind_of = to_arrow_schema(T.StructType.fromDDL(schema))
    return images.mapInArrow(run, schema)


def each(f: Callable[[np.ndarray], dict]) -> Callable[[np.ndarray], dict]:
    """For per_image, of a function of a single image."""

    def run(planes: np.ndarray) -> dict:
        found = [f(p) for p in planes]
        return {name: [x[name] for x in found] for name in found[0]}

    return run


def as_arrays(pixels: DataFrame, *planes: str) -> DataFrame:
    """One row per image with its planes as one flat array, in row order; an image is what one task must hold."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", *[F.expr(p).cast("double").alias(f"p{i}") for i, p in enumerate(planes)])))
    g = pixels.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"), ordered.alias("_p"))
    flat = F.concat(*[F.expr(f"transform(_p, s -> s.p{i})") for i in range(len(planes))])
    return g.select("image_id", (F.col("_h") + 1).alias("height"), (F.col("_w") + 1).alias("width"), flat.alias("values"))


def spectrum(gray: np.ndarray) -> dict:
    """Frequency metrics of one gray image, scaled to 0..1: shares of squared magnitude near, between and far from the centre, centroid, energy by direction, radial means.

    Near is up to a quarter, far from three quarters of the whole distance from centre to corner.
    """
    z = np.fft.fftshift(np.fft.fft2(gray[0] / 255.0))
    mag = np.abs(z)
    h, w = mag.shape
    yy, xx = np.indices(mag.shape)
    dist = np.hypot(yy - h // 2, xx - w // 2)
    top = int(np.hypot(h // 2, w // 2))
    total, energy = mag.sum(), (mag**2).sum()
    ratio = lambda m: float((mag[m] ** 2).sum() / energy) if energy else 0.0
    radius = dist.astype(int)
    rings = radius < top
    n = np.bincount(radius[rings], minlength=top)
    radial = (np.bincount(radius[rings], mag[rings], top) / np.maximum(n, 1)).tolist()
    edges = np.linspace(-np.pi, np.pi, 36)
    at = np.digitize(np.arctan2(yy - h // 2, xx - w // 2), edges) - 1
    # the angle of pi itself is in no direction
    directions = np.bincount(at[at < 35], mag[at < 35] ** 2, 35)
    return {
        "low_ratio": ratio(dist <= 0.25 * top), "mid_ratio": ratio((dist > 0.25 * top) & (dist < 0.75 * top)), "high_ratio": ratio(dist >= 0.75 * top), "centroid": float((mag * dist).sum() / total) if total else 0.0,
        "dominant_direction": float(np.degrees(edges[int(directions.argmax())])), "directions": directions.tolist(), "radial": radial,
    }


SPECTRUM = "image_id long, low_ratio double, mid_ratio double, high_ratio double, centroid double, dominant_direction double, directions array<double>, radial array<double>"


def box_mean(x: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1) squares of the last two axes with edges mirrored, edge pixels included."""
    none = [(0, 0)] * (x.ndim - 2)
    p = np.pad(x, [*none, (r, r), (r, r)], mode="symmetric")
    c = np.pad(p.cumsum(-2).cumsum(-1), [*none, (1, 0), (1, 0)])
    k = 2 * r + 1
    return (c[..., k:, k:] - c[..., :-k, k:] - c[..., k:, :-k] + c[..., :-k, :-k]) / (k * k)


def guided_filter(guide: np.ndarray, x: np.ndarray, r: int, eps: float = 1e-4) -> np.ndarray:
    """x [.., h, w] filtered by its guide; x may have more axes in front than the guide."""
    mg, mx = box_mean(guide, r), box_mean(x, r)
    a = (box_mean(guide * x, r) - mg * mx) / (box_mean(guide * guide, r) - mg * mg + eps)
    return box_mean(a, r) * guide + box_mean(mx - a * mg, r)


def _most(x: np.ndarray) -> np.ndarray:
    """The maximum of each plane."""
    return x.max(axis=(-2, -1), keepdims=True)


def correct_channel(channel: np.ndarray, guide: np.ndarray, radius: int = 10, strength: float = 0.8, mode: str = "both", safety: float = 0.0) -> np.ndarray:
    """A channel [.., h, w] drawn towards the guide's structure by its log ratio, filtered on two manifolds of the guide.

    mode keeps both signs of the correction, or only one that brightens or darkens; safety over 0
    goes back to the old value where the ratio changes by more.
    """
    tiny = 1e-6
    ratio = np.clip(np.log2((channel + tiny) / (guide + tiny)), -4, 4)
    weight = np.clip(np.minimum(channel, guide), tiny, None)
    low = guide.min(axis=(-2, -1), keepdims=True)
    span = _most(guide) - low
    t = np.where(span > 0, (guide - low) / np.where(span > 0, span, 1), 0)
    w = np.stack([weight * (share + tiny) for share in (1 - t, t)])
    over, under = guided_filter(guide, np.stack([ratio * w, w]), radius)
    fields = over / np.maximum(under, tiny)
    # a mean of clamped ratios, so it stays within their range
    smooth = np.clip((1 - t) * fields[0] + t * fields[1], -4, 4)
    change = smooth - ratio
    if mode == "brighten":
        change = np.maximum(change, 0)
    elif mode == "darken":
        change = np.minimum(change, 0)
    out = guide * 2 ** (ratio + strength * change)
    if safety > 0:
        out = np.where(np.abs(strength * change) > safety, channel, out)
    return np.clip(out, 0, 2 * np.maximum(_most(channel), tiny))


def correct_colors(planes: np.ndarray, guide: int = 1, channels: tuple[int, ...] = (0, 2), **options) -> np.ndarray:
    """Planes [3, h, w] of an image or [n, 3, h, w] of several, each for itself, with the named channels corrected against the guide; an image's values over 1 are scaled by its maximum."""
    top = planes.max(axis=(-3, -2, -1), keepdims=True)
    top = np.where(top > 1, top, 1.0)
    x = planes / top
    out = x.copy()
    for c in channels:
        out[..., c, :, :] = correct_channel(x[..., c, :, :], x[..., guide, :, :], **options)
    return out * top


def edge_strength(plane: np.ndarray) -> float:
    return float(np.diff(plane, axis=1).std()) if plane.shape[1] > 1 else 0.0


def radius_candidates(planes: np.ndarray, base: int = 10) -> list[tuple[int, float]]:
    """Radii base, base + 2, base - 2, one for each channel's edges, strongest first."""
    return sorted(zip((base, base + 2, base - 2), map(edge_strength, planes), strict=True), key=lambda x: -x[1])


def run_pipeline(planes: np.ndarray, stages: list[tuple[int, Callable]]) -> np.ndarray:
    """All stages in order of priority, then of addition."""
    for _, stage in sorted(stages, key=lambda s: s[0]):
        planes = stage(planes)
    return planes
