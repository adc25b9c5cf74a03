"""Connected components on DataFrames: alternating large-star and small-star steps over edges contracted in tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rects import contracted
from .common import shared_folder

#: Edges that a task contracts at once.
TASK_EDGES = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Tasks first contract the edges that they hold to stars; if one task held them all, these are
    the answer. Each round then replaces edges by edges to smaller neighbours, so their number
    never grows beyond that of the input; minima are partial aggregates, so that a node with very
    many neighbours is no hot task. A round's edges are checkpointed in the shared folder. No
    edges: no rows.
    """
    shared_folder(edges.sparkSession, "components")
    given = edges.select(F.greatest(a, b).alias("a_id"), F.least(a, b).alias("b_id")).where("a_id > b_id").distinct().checkpoint()
    tasks = max(1, -(-given.count() // task_edges))
    now = contracted(given.coalesce(tasks), most=task_edges + 1).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        now = small.checkpoint()
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(now.select("v", "v").distinct())
