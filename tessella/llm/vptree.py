"""Nearest neighbours by inner product over vantage-point trees, one for each shard of the vectors.

Vectors get one more component, so that all have the norm of the longest; the largest inner
product is then the least Euclidean distance, to which the triangle inequality applies. A node's
part is skipped where the least distance it can have, times `factor`, exceeds the query's distance
to its k-th neighbour so far. Factor one is exact. A task takes a block of queries through a group
of shards one by one, and carries each query's neighbours, and so its bound, from shard to shard.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discarded, written

#: Rows of a shard, members of a leaf, vectors of a block of queries, shards of a group.
SHARD_ROWS, LEAF, QUERY_BLOCK, GROUP_SHARDS = 8192, 128, 8192, 64
K, QUERY_EVERY, FACTOR = 20, 20, 1.0
#: What rounding may add to a distance, as a part of the longest norm.
SLACK = 1e-6
_NONE = np.iinfo(np.int64).max


@dataclass
class Node:
    """Members [first, last) of the tree's order; inner nodes have a vantage point and the distances that bound both halves."""

    first: int
    last: int
    vantage: int = -1
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    left: Node | None = None
    right: Node | None = None


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


class Queries:
    """A block of queries with the k best members of all trees searched so far: scores, best first, and ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x = ids, x
        self.best, self.who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE)
        self.square = (x * x).sum(1)
        # twice what the sums of a product's components can differ by in whatever order they are added
        self.error = 2 * (x.shape[1] + 2) * np.finfo(float).eps * np.sqrt(self.square)

    def take(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray) -> None:
        """Members as candidates of these queries. Inner products in the order of `inner` decide, ties go to the smaller id."""
        k = self.best.shape[1]
        about, off = self.x[rows] @ vectors.T, self.error[rows][:, None] * sizes
        about[self.ids[rows][:, None] == ids[None]] = -np.inf
        least = self.best[rows, -1:]
        if len(ids) > k:
            least = np.maximum(least, np.partition(about - off, len(ids) - k, axis=1)[:, len(ids) - k, None])
        row, col = np.nonzero((about + off >= least) & np.isfinite(about))
        if not len(row):
            return
        exact = np.concatenate([inner(self.x[rows[row[i : i + 65536]]], vectors[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
        count = np.bincount(row, minlength=len(rows))
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        new, names = np.full((len(rows), count.max()), -np.inf), np.full((len(rows), count.max()), _NONE)
        new[row, place], names[row, place] = exact, ids[col]
        both, names = np.hstack([self.best[rows], new]), np.hstack([self.who[rows], names])
        keep = np.lexsort((names, -both), axis=1)[:, :k]
        self.best[rows], self.who[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, member id, score)."""
        row, col = np.nonzero(np.isfinite(self.best))
        return self.ids[row], self.who[row, col], self.best[row, col]


class Tree:
    """Vectors in tree order; equal vectors that no vantage point can part stay in one leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, leaf: int = LEAF):
        rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
        points = np.hstack([vectors, rest[:, None]])
        self.order, self.leaf, self.norm = np.arange(len(ids)), leaf, norm
        self.root = self._split(points, 0, len(ids)) if len(ids) else None
        self.raw, self.ids = vectors[self.order], ids[self.order]
        self.sizes = np.sqrt((self.raw**2).sum(1))
        del self.order

    def _split(self, points: np.ndarray, first: int, last: int) -> Node:
        node, part = Node(first, last), self.order[first:last]
        if len(part) <= self.leaf:
            return node
        x = points[part]
        # the member farthest from the first one sees the others at the most different distances
        v = int(_distances(x[:1], x)[0].argmax())
        d = _distances(x[v : v + 1], x)[0]
        at = np.argsort(d, kind="stable")
        half = len(part) // 2
        if d[at[-1]] - d[at[0]] < SLACK * self.norm:
            return node
        self.order[first:last] = part[at]
        d = d[at]
        node.near, node.far = (d[0], d[half - 1]), (d[half], d[-1])
        vantage_point = self.order[first]  # the vantage point is nearest to itself
        node.left, node.right = self._split(points, first, first + half), self._split(points, first + half, last)
        node.vantage = int(first + np.flatnonzero(self.order[first : first + half] == vantage_point)[0])
        return node

    def search(self, q: Queries, factor: float = 1.0) -> None:
        """Updates the queries' neighbours by this tree's members; a member with a query's id is none of its candidates."""
        if self.root is None or not len(q.ids):
            return
        # lifted distances serve pruning only
        lifted = q.square + self.norm**2
        slack = SLACK * np.sqrt(lifted)

        def distance(rows: np.ndarray, vantage: int) -> np.ndarray:
            return np.sqrt(np.maximum(lifted[rows] - 2 * (q.x[rows] @ self.raw[vantage]), 0))

        def reach(rows: np.ndarray) -> np.ndarray:
            """Lifted distance of the k-th best so far."""
            return np.sqrt(np.maximum(lifted[rows] - 2 * q.best[rows, -1], 0)) + slack[rows]

        def leaf(node: Node, rows: np.ndarray) -> None:
            for at in range(node.first, node.last, 4096):
                part = slice(at, min(node.last, at + 4096))
                for i in range(0, len(rows), 1024):
                    q.take(rows[i : i + 1024], self.ids[part], self.raw[part], self.sizes[part])

        def first_leaf(node: Node, rows: np.ndarray) -> None:
            """Each query without a bound down to one leaf, which bounds its distances from the start."""
            if node.left is None:
                return seeds.setdefault(node.first, (node, []))[1].append(rows)
            left = distance(rows, node.vantage) <= (node.near[1] + node.far[0]) / 2
            for side, child in ((rows[left], node.left), (rows[~left], node.right)):
                if len(side):
                    first_leaf(child, side)

        def visit(node: Node, rows: np.ndarray) -> None:
            if node.left is None:
                new = rows[seeded[rows] != node.first]
                if len(new):
                    leaf(node, new)
                return
            d = distance(rows, node.vantage)
            for (low, high), child in sorted(((node.near, node.left), (node.far, node.right)), key=lambda x: np.maximum(d - x[0][1], x[0][0] - d).mean()):
                bound = np.maximum(np.maximum(d - high, low - d), 0)
                rest = rows[bound * factor <= reach(rows)]
                if len(rest):
                    visit(child, rest)

        seeds: dict[int, tuple[Node, list[np.ndarray]]] = {}
        seeded = np.full(len(q.ids), -1)
        unbound = np.flatnonzero(~np.isfinite(q.best[:, -1]))
        if len(unbound):
            first_leaf(self.root, unbound)
        for at, (node, rows) in seeds.items():
            rows = np.concatenate(rows)
            seeded[rows] = at
            leaf(node, rows)
        visit(self.root, np.arange(len(q.ids)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added component after component."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i].astype(np.float64) * b[:, i].astype(np.float64)
    return total


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x, norm) without null ids, null, empty or zero vectors, and those with null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    out = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = out.where(finite & F.exists("x", lambda c: c != 0))
    return out.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))


def build_trees(vectors: DataFrame, norm: float, rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, size, data) with a pickled tree for each shard of about shard_rows vectors."""
    shards = max(1, -(-rows // shard_rows))

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        x = np.array(t.column("x").to_pylist(), np.float64)
        order = np.argsort(ids, kind="stable")
        tree = Tree(ids[order], x[order], norm)
        return pa.table({"shard": [t.column("shard")[0].as_py()], "size": pa.array([t.column("size")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(tree)], pa.binary())})

    keyed = vectors.select("vec_id", "x", F.size("x").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    return written(keyed.groupBy("shard", "size").applyInArrow(build, "shard long, size int, data binary"), "vp-trees")


def query_blocks(asked: DataFrame, blocks: int) -> DataFrame:
    """(block, size, data) with the pickled ids and vectors of a block of queries (vec_id, x)."""

    def pack(t: pa.Table) -> pa.Table:
        data = pickle.dumps((t.column("vec_id").to_numpy(), np.array(t.column("x").to_pylist(), np.float64)))
        return pa.table({"block": [t.column("block")[0].as_py()], "size": pa.array([t.column("size")[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    keyed = asked.select("vec_id", "x", F.size("x").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    return keyed.groupBy("block", "size").applyInArrow(pack, "block long, size int, data binary")


def nearest(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, factor: float = FACTOR, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """(query_id, rank, vec_id, score) for each vector whose id is divisible by query_every against all others.

    Vectors are compared with those of their own length; those null, empty, zero or with null or
    non-finite components take no part. Of rows with one vec_id none is another's candidate; as a
    query such an id counts once, with its smallest vector. Fewer than k candidates: all of them; no
    vectors: no rows. Other columns are not looked at. One job pairs blocks of queries with groups of
    shards; a task holds a block and a tree at a time and gives k rows for each query.
    """
    spark = embeddings.sparkSession
    vectors = written(usable(embeddings), "vectors")
    top = vectors.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    if not top.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees = build_trees(vectors, float(top.norm) * (1 + 1e-12), top.n, shard_rows)
    asked = vectors.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // query_block))
    shards = trees.select("shard").distinct().count()
    # as few groups as keep a task small, but enough that all cores have one
    groups = min(shards, max(-(-shards // group_shards), -(-spark.sparkContext.defaultParallelism // blocks)))
    packs = written(query_blocks(asked, blocks), "queries")
    discarded(vectors)
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    one = packs.select("block", "size", F.lit(-1).cast("long").alias("shard"), "data").select("block", every(groups).alias("group"), "size", "shard", "data")
    two = trees.select(every(blocks).alias("block"), F.pmod("shard", F.lit(groups)).alias("group"), "size", "shard", "data")
    place = ["block", "group", "size"]
    # in each cell the queries (shard -1) come before its trees
    cells = one.unionByName(two).repartition(blocks * groups, *place).sortWithinPartitions(*place, "shard")

    def search(batches):
        here, q = None, None

        def done():
            ids, who, score = q.found()
            return pa.record_batch([pa.array(ids), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                *cell, shard = (batch.column(c)[i].as_py() for c in (*place, "shard"))
                if cell != here:
                    if q is not None:
                        yield done()
                    here, q = cell, None
                data = pickle.loads(batch.column("data")[i].as_py())
                if shard < 0:
                    q = Queries(*data, k)
                elif q is not None:
                    data.search(q, factor)
        if q is not None:
            yield done()

    found = cells.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
