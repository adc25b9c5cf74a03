"""Rectangle joins: overlap, nesting, tile crossing, coverage cells, overlap groups.

Rectangles are rows (id, x0, y0, x1, y1), with image_id where joins are per image. Joins across
one plane go through grid cells; a pair is kept only in the cell that holds the corner
(max x0, max y0), so that no distinct is needed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contained, overlaps
from ..storage import shared_folder


def proper(rects: DataFrame) -> DataFrame:
    """Rectangles of zero width or height never match."""
    return rects.where("x0 < x1 AND y0 < y1")


def _cells(rects: DataFrame, cell: float, prefix: str) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return rects.withColumn("cx", F.explode(span(f"{prefix}.x0", f"{prefix}.x1"))).withColumn("cy", F.explode(span(f"{prefix}.y0", f"{prefix}.y1")))


def overlap_pairs(a: DataFrame, b: DataFrame, by: str | None = "image_id", cell: float = 128.0) -> DataFrame:
    """(a_id, b_id, x0, y0, x1, y1) for rectangles that share an open area; by=None joins all in one plane."""
    left, right = proper(a).select(F.struct(*a.columns).alias("a")), proper(b).select(F.struct(*b.columns).alias("b"))
    left, right = _cells(left, cell, "a"), _cells(right, cell, "b")
    on = [left.cx == right.cx, left.cy == right.cy]
    if by:
        on.append(F.col(f"a.{by}") == F.col(f"b.{by}"))
    pairs = left.join(right, on).where(overlaps("a", "b"))
    home = (left.cx == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (left.cy == F.floor(F.greatest("a.y0", "b.y0") / cell))
    keep = [F.col(f"a.{by}").alias(by)] if by else []
    return pairs.where(home).select(*keep, F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.greatest("a.x0", "b.x0").alias("x0"), F.greatest("a.y0", "b.y0").alias("y0"), F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"))


def self_overlaps(rects: DataFrame, by: str | None = "image_id", cell: float = 128.0) -> DataFrame:
    """Pairs a_id < b_id of one list."""
    return overlap_pairs(rects, rects, by, cell).where("a_id < b_id")


def nested(rects: DataFrame, by: str = "image_id", ordered: bool = True, cell: float = 128.0) -> DataFrame:
    """(outer_id, inner_id). ordered: the outer one starts first and ends last in sweep order; else closed containment, equal boxes by id.

    An outer rectangle is looked for in the one grid cell that holds the inner one's first corner.
    """
    if ordered:
        rule = "(o.x0, o.y0, o.id) < (r.x0, r.y0, r.id) AND o.y0 <= r.y0 AND r.y1 <= o.y1 AND (r.x1, r.y0, r.id) < (o.x1, o.y0, o.id)"
    else:
        same = "o.x0 = r.x0 AND o.y0 = r.y0 AND o.x1 = r.x1 AND o.y1 = r.y1"
        rule = f"{contained('r', 'o')} AND o.id <> r.id AND (NOT ({same}) OR o.id < r.id)"
    o = _cells(rects.where("x0 <= x1 AND y0 <= y1").select(F.struct(*rects.columns).alias("o")), cell, "o")
    r = rects.select(F.struct(*rects.columns).alias("r")).withColumns({"cx": F.floor(F.col("r.x0") / cell), "cy": F.floor(F.col("r.y0") / cell)})
    pairs = o.join(r, (o.cx == r.cx) & (o.cy == r.cy) & (F.col(f"o.{by}") == F.col(f"r.{by}"))).where(rule)
    return pairs.select(F.col(f"o.{by}").alias(by), F.col("o.id").alias("outer_id"), F.col("r.id").alias("inner_id"))


#: SQL text for the boundaries of tile a that box b crosses, in this order.
_CROSSED = "filter(array(IF(b.x0 < a.x0 AND b.x1 > a.x0, 'left', NULL), IF(b.x0 < a.x1 AND b.x1 > a.x1, 'right', NULL), IF(b.y0 < a.y0 AND b.y1 > a.y0, 'top', NULL), IF(b.y0 < a.y1 AND b.y1 > a.y1, 'bottom', NULL)), s -> s IS NOT NULL)"


def classified(pairs: DataFrame) -> DataFrame:
    """Adds kind (contained, none, vertical, horizontal, both) and boundaries to rows with structs a (tile) and b (box)."""
    found = pairs.withColumn("boundaries", F.expr(_CROSSED))
    v = F.expr("exists(boundaries, s -> s IN ('left', 'right'))")
    h = F.expr("exists(boundaries, s -> s IN ('top', 'bottom'))")
    kind = F.when(F.expr(contained("b", "a")), "contained").when(~F.expr(overlaps("a", "b")), "none").when(v & h, "both").when(v, "vertical").when(h, "horizontal").otherwise("none")
    return found.withColumn("kind", kind).withColumn("boundaries", F.when(F.col("kind").isin("contained", "none"), F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.col("boundaries")))


def tile_crossings(tiles: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """(*by, tile_id, box_id, kind, boundaries) for boxes that cross a tile's edge; contained and apart ones go. Tiles join on the columns `by`."""
    a = tiles.select(*[F.col(c).alias(f"_{c}") for c in by], F.struct(*tiles.columns).alias("a"))
    b = boxes.select(*by, F.struct(*boxes.columns).alias("b"))
    pairs = b.join(a, [F.col(c) == F.col(f"_{c}") for c in by]).where(overlaps("a", "b"))
    return classified(pairs).where("kind NOT IN ('contained', 'none')").select(*by, F.col("a.id").alias("tile_id"), F.col("b.id").alias("box_id"), "kind", "boundaries")


def crossings_by_box(crossings: DataFrame) -> DataFrame:
    """(box_id, n, tiles): the tiles that each box crosses, in order of id; a box has few tiles."""
    return crossings.groupBy("box_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("tile_id", "kind", "boundaries"))).alias("tiles"))


def _covered(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x0, y0, x1, y1, n) of cells under two rectangles or more of one group, for strips of the grid of up to `most` cells."""
    xs, ys = np.unique(np.concatenate([x0, x1])), np.unique(np.concatenate([y0, y1]))
    left, right, low, high = (np.searchsorted(*e) for e in ((xs, x0), (xs, x1), (ys, y0), (ys, y1)))
    for begin, lines in ((b, min(max(1, most // len(ys)), len(xs) - 1 - b)) for b in range(0, len(xs) - 1, max(1, most // len(ys)))):
        on = (left < begin + lines) & (right > begin)
        # what begins and ends at each corner, summed up along both axes
        corner = np.zeros((lines + 1, len(ys)), np.int64)
        a, b = np.maximum(left[on] - begin, 0), np.minimum(right[on] - begin, lines)
        for at, edge, sign in ((a, low, 1), (a, high, -1), (b, low, -1), (b, high, 1)):
            np.add.at(corner, (at, edge[on]), sign)
        n = corner.cumsum(0).cumsum(1)[:-1, :-1]
        cx, cy = np.nonzero(n >= 2)
        if len(cx):
            yield xs[begin + cx], ys[cy], xs[begin + cx + 1], ys[cy + 1], n[cx, cy]


#: Cells of a group's grid that a task holds at once.
CELLS = 1 << 20


def coverage_cells(rects: DataFrame, by: str = "image_id", most: int = CELLS) -> DataFrame:
    """(by, x0, y0, x1, y1, n): the plane cut at all edges of a group's rectangles, cells under two or more.

    Only rectangles are dealt, by group; their cells are counted where they meet, strip by strip.
    """
    p = proper(rects).select(by, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kind = p.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            out, size = [], 0
            names = t.column(by).combine_chunks()
            boxes = [t.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]
            code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                for found in _covered(*(v[begin:end] for v in boxes), most):
                    out.append((np.full(len(found[0]), begin), *found))
                    size += len(found[0])
                    if size >= 1 << 16:
                        yield batch_of(names, out)
                        out, size = [], 0
            if out:
                yield batch_of(names, out)

        def batch_of(names: pa.Array, out: list[tuple]) -> pa.RecordBatch:
            first, *values = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([names.take(pa.array(first)), *map(pa.array, values)], names=[by, "x0", "y0", "x1", "y1", "n"])

        # a group can go on in the next batch
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(by)
            same = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            last = int(np.flatnonzero(same != same[-1])[-1]) + 1 if (same != same[-1]).any() else 0
            if held and (last or held[-1].column(by)[-1] != key[0]):
                goes_on = held[-1].column(by)[-1] == key[0]
                cut = (int(np.flatnonzero(same != same[0])[0]) if (same != same[0]).any() else batch.num_rows) if goes_on else 0
                yield from cells([*held, batch.slice(0, cut)])
                held = []
                batch, last = batch.slice(cut), last - cut
            if last > 0:
                yield from cells([batch.slice(0, last)])
                batch = batch.slice(last)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from cells(held)

    dealt = p.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by)
    return dealt.mapInArrow(run, f"{by} {kind}, x0 double, y0 double, x1 double, y1 double, n long")


def smaller_members(rects: DataFrame, groups: DataFrame) -> DataFrame:
    """(id): all but the largest rectangle of each overlap group (id, component); ties keep the larger id."""
    keep = groups.join(rects.select("id", "area"), "id").groupBy("component").agg(F.max(F.struct("area", "id")).alias("top"))
    return groups.join(keep, "component").where(F.col("id") != F.col("top.id")).select("id")


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges held in memory, and for each the least node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(edges: DataFrame, by: str | None = None, most: int = 1_000_000, roots: bool = False) -> DataFrame:
    """Stars (a_id, b_id) to the least node that connect what the edges connect within so many of them in a task.

    With `by`, the edges of one group meet there; with `roots`, least nodes are there too, as stars to themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            nodes, least = _least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            other = (nodes != least) | roots
            return pa.record_batch([pa.array(nodes[other]), pa.array(least[other])], names=["a_id", "b_id"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a_id", "b_id")))
            size += batch.num_rows
            if size >= most:
                out = stars()
                yield out
                # what was joined goes on with the next edges
                held, size = [(out.column(0).to_numpy(), out.column(1).to_numpy())], 0
        if held:
            yield stars()

    dealt = edges.where("a_id IS NOT NULL AND b_id IS NOT NULL")
    dealt = dealt.repartition(by) if by else dealt
    return dealt.select(F.col("a_id").cast("long"), F.col("b_id").cast("long")).mapInArrow(run, "a_id long, b_id long")


def overlap_groups(edges: DataFrame, by: str | None = None, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a_id, b_id); labels and their own labels are followed until nothing changes.

    Tasks first contract the edges that they hold to stars. With `by`, a column of the edges whose
    groups they never leave, a group small enough for a task is then done, and one round shows it.
    """
    shared_folder(edges.sparkSession, "overlap-groups")
    stars = contracted(edges, by, roots=True).distinct().checkpoint()
    both = stars.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).union(stars.select("b_id", "a_id"))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        if step.where("c < old").isEmpty():
            break
        jump = step.join(step.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c", "left").select("u", F.coalesce(F.least("c", "cc"), "c").alias("c"))
        label = jump.checkpoint()
    else:
        raise RuntimeError("overlap groups did not settle")
    return label.selectExpr("u AS id", "c AS component")
