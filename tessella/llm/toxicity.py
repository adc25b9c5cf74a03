"""Toxicity by non-negative positive-unlabelled learning of a linear numpy classifier.

The risk is prior * loss of the confirmed toxic rows as toxic, plus the loss of the unlabelled rows
as clean less prior * that of the toxic rows as clean, held at zero or more (the toxic rows among
the unlabelled are thereby taken out). With the logistic loss the output is a log-odds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discarded, held_out, plus, rows_of, written
from .training import known_labels, minimise, sampled, sigmoid, training_labels

MODULUS, REMAINDER = 4, 2
#: Most toxic rows, most unlabelled rows and most features of the classifier; rows of the sample for one task.
TRAIN_ROWS, UNLABELLED_ROWS, FEATURES, TASK_ROWS = 24_000, 24_000, 400, 1_000
#: Least toxic rows with a feature, and least log-odds over its standard error.
LEAST_ROWS, LEAST_SURE = 3, 4.0
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The lower-case word with an end mark, and its beginnings of four to seven letters."""
    w = word.lower()
    return [w + "$", *(w[:n] for n in range(4, 8) if len(w) > n)]


def text_words(text: str | None) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text or ""))}


def text_features(text: str | None) -> set[str]:
    """The distinct features of the whole text; those that two or more different words share count once more, marked by a plus."""
    found = Counter(f for w in text_words(text) for f in word_features(w))
    return {*found, *(f + "+" for f, n in found.items() if n > 1)}


@dataclass
class Linear:
    """Log-odds from the presence of features."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._known: dict[str, tuple[str, ...]] = {}
        self._base = {f.removesuffix("+") for f in self.features}

    def _of(self, word: str) -> tuple[str, ...]:
        if (found := self._known.get(word)) is None:
            if len(self._known) > 500_000:
                self._known.clear()
            found = self._known[word] = tuple(f for f in word_features(word) if f in self._base)
        return found

    def present(self, text: str | None) -> list[int]:
        found = Counter(f for w in text_words(text) for f in self._of(w))
        names = (f for g, n in found.items() for f in ((g, g + "+") if n > 1 else (g,)))
        return sorted(self.features[f] for f in names if f in self.features)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(np.array([self.bias + self.weights[self.present(t)].sum() for t in texts], float))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, batch: int = 2048, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for presence matrices of toxic and unlabelled rows."""

    def slope(params, rng):
        w, b = params
        x = p[rng.integers(0, len(p), min(batch, len(p)))].astype(float)
        z = u[rng.integers(0, len(u), min(batch, len(u)))].astype(float)
        fx, fz = x @ w + b[0], z @ w + b[0]
        as_toxic = -prior * sigmoid(-fx) / len(fx)
        clean_x, clean_z = prior * sigmoid(fx) / len(fx), sigmoid(fz) / len(fz)
        rest = np.logaddexp(0, fz).mean() - prior * np.logaddexp(0, fx).mean()
        if rest >= 0:
            gx, gz = as_toxic - clean_x, clean_z
        else:  # the correction: step back along the part that went below zero
            gx, gz = clean_x, -clean_z
        return [x.T @ gx + z.T @ gz + decay * w, np.array([gx.sum() + gz.sum()])]

    w, b = minimise([np.zeros(p.shape[1]), np.array([np.log(prior / (1 - prior))])], slope, steps, 0.03)
    return w, float(b[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Linear:
    """The classifier from toxic rows and unlabelled rows outside the held-out fold.

    The class prior is the share of toxic labels there. Without a toxic label all scores are 0.
    """
    spark = docs.sparkSession
    known = known_labels(labels, "toxic", MODULUS, REMAINDER)
    n = known.agg(F.count("*").alias("all"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    toxic = training_labels(known.where("y = 1"), most)
    if not toxic:
        return Linear({}, np.zeros(0), -40.0)
    prior = min(0.95, n.toxic / n["all"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    # at most `most` ids, so the broadcast is bounded
    ids = F.broadcast(spark.createDataFrame(toxic, "_id long, y int"))
    chosen = sampled(texts.where(~held_out(F.col("doc_id"), MODULUS, REMAINDER)), "doc_id", unlabelled)
    rows = texts.join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y").union(chosen.select("doc_id", "text", F.lit(0)))
    held = written(rows, "toxicity-sample")
    sample = held.coalesce(-(-(len(toxic) + unlabelled) // TASK_ROWS))

    def count(batches):
        found = {0: Counter(), 1: Counter()}
        for _, (texts, ys) in rows_of(batches, "text", "y"):
            for t, y in zip(texts, ys, strict=True):
                found[y][""] += 1
                found[y].update(text_features(t))
        for y, c in found.items():
            for at in range(0, len(items := list(c.items())), 10_000):
                part = items[at : at + 10_000]
                yield pa.record_batch([pa.array([y] * len(part), pa.int32()), pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["y", "feature", "n"])

    counts = written(sample.mapInArrow(count, "y int, feature string, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("u")), "toxicity-words")
    total = counts.where("feature = ''").first()
    if total is None or not total.p or not total.u:
        return Linear({}, np.zeros(0), -40.0)
    a, b = (F.col("p") + 0.5) / (total.p + 1), (F.col("u") + 0.5) / (total.u + 1)
    z = (F.log(a / (1 - a)) - F.log(b / (1 - b))) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    best = counts.where((F.col("feature") != "") & (F.col("p") >= LEAST_ROWS)).select("feature", z.alias("z")).where(F.col("z") > LEAST_SURE)
    best = best.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    model = Linear({r.feature: i for i, r in enumerate(best)}, np.zeros(len(best)), 0.0)

    def present(batches):
        for _, (doc_ids, texts, ys) in rows_of(batches, "doc_id", "text", "y"):
            has = [model.present(t) for t in texts]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(has, pa.list_(pa.int32()))], names=["doc_id", "y", "has"])

    found = sorted((r.y, r.doc_id, r.has) for r in sample.mapInArrow(present, "doc_id long, y int, has array<int>").toLocalIterator())
    discarded(held, counts)
    x = np.zeros((len(found), len(best)), np.uint8)
    for i, (_, _, has) in enumerate(found):
        x[i, has] = 1
    y = np.array([r[0] for r in found])
    w, bias = nnpu(x[y == 1], x[y == 0], prior)
    return Linear(model.features, w, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows and columns plus toxicity_score (0 to 1).

    Null and empty texts have no words and get the bias' score. Repeated rows have equal scores; a
    column toxicity_score is replaced; no rows give none. Without a toxic label all scores are 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    docs = docs.drop("toxicity_score")

    def run(batches):
        for part, (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.score(texts))], names=[*part.schema.names, "toxicity_score"])

    return docs.mapInArrow(run, plus(docs.schema, "toxicity_score", T.DoubleType()))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    out = score_toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"))
