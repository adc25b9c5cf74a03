"""Column builders for boxes, rings, points and transforms. No UDFs: all stay in generated code.

Rings are flat arrays [x1, y1, x2, y2, ...] of doubles unless `points` says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_features(w: str = "w", h: str = "h", x: str = "x", y: str = "y") -> dict[str, Column]:
    """Features of boxes in (x, y, w, h) form; ratios of degenerate boxes have fixed values."""
    e = F.expr
    return {
        "width": e(w),
        "height": e(h),
        "box_area": e(f"{w} * {h}"),
        "aspect_ratio": e(f"IF({h} > 0, {w} / {h}, 0D)"),
        "center_x": e(f"{x} + {w} / 2"),
        "center_y": e(f"{y} + {h} / 2"),
        "perimeter": e(f"2 * ({w} + {h})"),
        "diagonal": e(f"sqrt({w} * {w} + {h} * {h})"),
        "compactness": e(f"IF({w} + {h} > 0, 4 * pi() * {w} * {h} / power(2 * ({w} + {h}), 2), 0D)"),
        "elongation": e(f"IF(least({w}, {h}) > 0, greatest({w}, {h}) / least({w}, {h}), 1D)"),
        "rectangularity": e(f"IF({w} + {h} > 0, {w} * {h} / power(({w} + {h}) / 2, 2), 0D)"),
    }


def spatial_features(width: str = "width", height: str = "height") -> dict[str, Column]:
    """Where a box (x, y, w, h) lies in its image."""
    e = F.expr
    W, H = f"coalesce({width}, 1)", f"coalesce({height}, 1)"
    diag = f"sqrt({W} * {W} + {H} * {H})"
    cx, cy = "(x + w / 2)", "(y + h / 2)"
    return {
        "relative_x": e(f"x / {W}"),
        "relative_y": e(f"y / {H}"),
        "relative_width": e(f"w / {W}"),
        "relative_height": e(f"h / {H}"),
        "relative_area": e(f"w * h / ({W} * {H})"),
        "distance_from_center": e(f"sqrt(power({cx} - {W} / 2, 2) + power({cy} - {H} / 2, 2)) / {diag}"),
        "edge_proximity": e(f"least(x, y, {W} - (x + w), {H} - (y + h)) / least({W}, {H})"),
        "corner_distance_tl": e(f"sqrt({cx} * {cx} + {cy} * {cy}) / {diag}"),
        "corner_distance_br": e(f"sqrt(power({W} - {cx}, 2) + power({H} - {cy}, 2)) / {diag}"),
        "horizontal_position": e(f"{cx} / {W}"),
        "vertical_position": e(f"{cy} / {H}"),
    }


def _of_ring(ring: str, body: str) -> str:
    """SQL text of `body`, which names the ring _r: it is made once, however often the body reads it."""
    return f"transform(array({ring}), _r -> {body})[0]"


def _ring_sum(term: str) -> str:
    """Sum of `term` over the places _i of the corners of _r and NEXT of the one after each; the ring is closed."""
    return f"aggregate(sequence(0, size(_r) - size(_r) % 2 - 2, 2), 0D, (_s, _i) -> _s + ({term.replace('NEXT', 'IF(_i + 3 < size(_r), _i + 2, 0)')}))"


#: Of a ring _r: its shoelace area, under three corners 0; its closed length, under two corners 0.
_AREA = f"IF(size(_r) >= 6, abs({_ring_sum('_r[_i] * _r[NEXT + 1] - _r[NEXT] * _r[_i + 1]')}) / 2, 0D)"
_LENGTH = f"IF(size(_r) >= 4, {_ring_sum('sqrt(power(_r[NEXT] - _r[_i], 2) + power(_r[NEXT + 1] - _r[_i + 1], 2))')}, 0D)"


def polygon_area(ring: str) -> Column:
    """Shoelace area; under three corners 0."""
    return F.expr(_of_ring(ring, _AREA))


def polygon_perimeter(ring: str) -> Column:
    """Length of the closed ring; under two corners 0."""
    return F.expr(_of_ring(ring, _LENGTH))


def segmentation_features(segmentation: str = "segmentation", box_area: str = "w * h") -> dict[str, Column]:
    """Features of the first ring if it has three corners or more and an even length; else 0, 0, 1, 0, 0.

    All are read from one expression, which a projection works out once for a row.
    """
    good = "coalesce(size(_r) >= 6 AND size(_r) % 2 = 0, false)"
    ring = F.expr(_of_ring(f"get({segmentation}, 0)", f"IF({good}, struct(size(_r) DIV 2 AS n, {_AREA} AS a, {_LENGTH} AS p), NULL)"))
    n, a, p = (ring[c] for c in "nap")
    return {
        "segmentation_points": F.coalesce(n.cast("int"), F.lit(0)),
        "segmentation_area": F.when(n.isNotNull(), a).otherwise(0.0),
        "bbox_to_seg_ratio": F.when(a > 0, F.expr(box_area) / a).otherwise(1.0),
        "segmentation_perimeter": F.when(n.isNotNull(), p).otherwise(0.0),
        "segmentation_circularity": F.when(p > 0, 4 * F.pi() * a / (p * p)).otherwise(0.0),
    }


def ring_points(segmentation: str) -> Column:
    """Flat rings to arrays of (x, y); rings without numbers go."""
    return F.expr(f"transform(filter({segmentation}, p -> size(p) > 0), p -> transform(sequence(0, CAST(size(p) / 2 AS INT) - 1), i -> struct(p[2 * i] AS x, p[2 * i + 1] AS y)))")


def ring_box(ring: str) -> Column:
    """[min x, min y, width, height]."""
    xs, ys = (f"transform(sequence(0, CAST(size({ring}) / 2 AS INT) - 1), i -> {ring}[2 * i + {k}])" for k in (0, 1))
    return F.expr(f"array(array_min({xs}), array_min({ys}), array_max({xs}) - array_min({xs}), array_max({ys}) - array_min({ys}))")


def point_in_ring(x: str, y: str, ring: str) -> Column:
    """Parity of crossings of a ray to the right; half-open on the boundary."""
    n = f"CAST(size({ring}) / 2 AS INT)"
    xi, yi, xj, yj = f"{ring}[2 * i]", f"{ring}[2 * i + 1]", f"{ring}[2 * ((i + 1) % {n})]", f"{ring}[2 * ((i + 1) % {n}) + 1]"
    cross = f"(({yi} > {y}) <> ({yj} > {y})) AND {x} < ({xj} - {xi}) * try_divide({y} - {yi}, {yj} - {yi}) + {xi}"
    return F.expr(f"aggregate(sequence(0, {n} - 1), false, (a, i) -> a <> coalesce({cross}, false))")


def normalized_rect(x0: str, y0: str, x1: str, y1: str) -> dict[str, Column]:
    return {"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1)}


def turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    """Cross product of ab and ac: over 0 is a left turn."""
    return F.expr(f"({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax})")


def contained(inner: str, outer: str) -> str:
    """SQL text: closed containment of boxes with fields x0, y0, x1, y1."""
    return f"{inner}.x0 >= {outer}.x0 AND {inner}.y0 >= {outer}.y0 AND {inner}.x1 <= {outer}.x1 AND {inner}.y1 <= {outer}.y1"


def overlaps(a: str, b: str) -> str:
    """SQL text: boxes share an open area."""
    return f"{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


def map_point(m: str, x: str, y: str) -> tuple[str, str]:
    """SQL text of a point under a 9-element homography."""
    d = f"({m}[6] * {x} + {m}[7] * {y} + {m}[8])"
    return f"(({m}[0] * {x} + {m}[1] * {y} + {m}[2]) / {d})", f"(({m}[3] * {x} + {m}[4] * {y} + {m}[5]) / {d})"


def clamp(v: str, size: str) -> str:
    return f"greatest(0D, least({v}, {size} - 1D))"


def transform_box(m: str, width: str, height: str) -> Column:
    """The hull of a box's four mapped and clamped corners; null if it is one pixel or less either way."""
    xs, ys = [], []
    for cx in ("x", "(x + w)"):
        for cy in ("y", "(y + h)"):
            px, py = map_point(m, cx, cy)
            xs.append(clamp(px, width))
            ys.append(clamp(py, height))
    x0, x1, y0, y1 = f"least({', '.join(xs)})", f"greatest({', '.join(xs)})", f"least({', '.join(ys)})", f"greatest({', '.join(ys)})"
    return F.expr(f"IF({x1} - {x0} > 1 AND {y1} - {y0} > 1, array({x0}, {y0}, {x1} - {x0}, {y1} - {y0}), NULL)")


def transform_ring(m: str, ring: str, width: str, height: str) -> Column:
    px, py = map_point(m, f"{ring}[2 * i]", f"{ring}[2 * i + 1]")
    return F.expr(f"flatten(transform(sequence(0, CAST(size({ring}) / 2 AS INT) - 1), i -> array({clamp(px, width)}, {clamp(py, height)})))")


def transform_keypoints(m: str, points: str, width: str, height: str) -> Column:
    """Triplets (x, y, v): visible ones are mapped and clamped; a length that isn't a multiple of three fails."""
    px, py = map_point(m, f"{points}[i]", f"{points}[i + 1]")
    mapped = f"flatten(transform(sequence(0, size({points}) - 3, 3), i -> IF({points}[i + 2] > 0, array({clamp(px, width)}, {clamp(py, height)}, {points}[i + 2]), array({points}[i], {points}[i + 1], {points}[i + 2]))))"
    return F.expr(f"CASE WHEN size({points}) = 0 THEN {points} WHEN size({points}) % 3 <> 0 THEN raise_error('keypoints need triplets') ELSE {mapped} END")


def fraction(s: str) -> Column:
    """'28/10', '1 1/2', '-3' as double; null for anything else."""
    body = f"regexp_replace(trim({s}), '^-', '')"
    one = "IF(p LIKE '%/%', try_divide(try_cast(split(p, '/')[0] AS DOUBLE), try_cast(split(p, '/')[1] AS DOUBLE)), try_cast(p AS DOUBLE))"
    total = f"aggregate(split({body}, ' +'), 0D, (a, p) -> a + {one})"
    return F.expr(f"IF(trim({s}) LIKE '-%', -({total}), {total})")


def number_or_text(s: str) -> tuple[Column, Column]:
    """(number, text): one of them is null."""
    is_number = F.col(s).rlike(r"^[+-]?\d*\.?\d+$")
    return F.when(is_number, F.expr(f"try_cast({s} AS DOUBLE)")), F.when(~is_number, F.col(s))


def segment_y(x: str) -> Column:
    """y at x on the segment (sx, sy)-(tx, ty), taken from left to right; a vertical one gives its lower end."""
    lx, ly, rx, ry = ("IF(sx <= tx, sx, tx)", "IF(sx <= tx, sy, ty)", "IF(sx <= tx, tx, sx)", "IF(sx <= tx, ty, sy)")
    return F.expr(f"IF(sx = tx, least(sy, ty), {ly} + ({ry} - {ly}) * ({x} - {lx}) / ({rx} - {lx}))")


def rotate(v: tuple[str, str, str], r: str, back: bool = False) -> tuple[Column, ...]:
    """v times a 3 x 3 rotation (row vector), or times its transpose."""
    at = (lambda i, j: f"{r}[{3 * j + i}]") if back else (lambda i, j: f"{r}[{3 * i + j}]")
    return tuple(F.expr(" + ".join(f"{v[i]} * {at(i, j)}" for i in range(3))) for j in range(3))


def grayscale(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.expr(f"CAST(round(0.299D * {r} + 0.587D * {g} + 0.114D * {b}) AS INT)")
