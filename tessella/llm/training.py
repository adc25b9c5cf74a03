"""Bounded labelled samples and a small numpy optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows whose hashed key falls under a threshold such that about `most` rows stay; all rows if they are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def known_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, y) outside the held-out fold; null ids or labels don't count, of several labels the smallest does."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))


def training_labels(known: DataFrame, most: int) -> list[tuple[int, int]]:
    """About `most` of the labels (doc_id, y), chosen by the id's hash."""
    return sorted((r.doc_id, r.y) for r in sampled(known, "doc_id", most).collect())


def minimise(start: list[np.ndarray], slope: Callable[[list[np.ndarray], np.random.Generator], list[np.ndarray]], steps: int, rate: float, seed: int = 0) -> list[np.ndarray]:
    """Adam with a rate that falls to zero; slope gives the gradients at some parameters."""
    p = [x.astype(np.float64).copy() for x in start]
    m, v, rng = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], np.random.default_rng(seed)
    for t in range(1, steps + 1):
        for i, g in enumerate(slope(p, rng)):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            p[i] -= rate * (1 - (t - 1) / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
