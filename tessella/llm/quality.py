"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

A token's vector is its sparse random index vector plus the sum of its neighbours' index vectors
over a bounded labelled sample; tokens share a fixed number of buckets. A document is the mean and
the mean square of its tokens' vectors, over the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discarded, fresh, held_out, kept, plus, rows_of, written
from .training import known_labels, minimise, sigmoid, training_labels

MODULUS, REMAINDER = 3, 1
#: Most labelled rows that the classifier is fitted on.
TRAIN_ROWS = 8_000
BUCKETS, DIM, ONES, WINDOW, HIDDEN = 1 << 14, 64, 4, 2, 32
#: Rows of the sample for one task, and slices in which the vectors' sums are added up by executors.
TASK_ROWS, SLICES = 256, 16
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens that are held at once; a text of any length is read on with what its next block needs of the last.
_BLOCK = 50_000
#: Tokens whose buckets a worker process keeps; of larger vocabularies the rest are rare, and hashed anew.
KNOWN_TOKENS = 50_000
REPEAT = zlib.crc32(b"\x01=") % BUCKETS


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM: ONES entries of +1 or -1 in each row, from a fixed seed."""
    rng = np.random.default_rng(42)
    at = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :ONES]
    r = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(r, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return r


class _Buckets(dict):
    """Token to bucket. All-capital words share one and numbers another; case is kept otherwise."""

    def __missing__(self, token: str) -> int:
        shape = "\x01A" if len(token) > 1 and token.isupper() else "\x010" if token[0].isdigit() else token
        bucket = zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(token) <= 64:
            if len(self) >= KNOWN_TOKENS:
                self.clear()
            self[token] = bucket
        return bucket


def token_buckets(text: str | None, block: int = _BLOCK) -> Iterator[np.ndarray]:
    """Buckets of the text's tokens, in blocks; a token whose bucket is that of the one before counts as a repeat."""
    last, buckets = -1, kept("quality", _Buckets)
    found = map(buckets.__getitem__, (m[0] for m in _TOKEN.finditer(text))) if text and len(text) > block else map(buckets.__getitem__, _TOKEN.findall(text or ""))
    while len(raw := np.fromiter(islice(found, block), np.int32)):
        ids = raw.copy()
        ids[1:][raw[1:] == raw[:-1]] = REPEAT
        if raw[0] == last:
            ids[0] = REPEAT
        last = int(raw[-1])
        yield ids


class NeighbourSums:
    """[bucket, DIM]: for each bucket the sum of the index vectors of tokens at most WINDOW places away."""

    def __init__(self, index: np.ndarray):
        self.total = np.zeros(BUCKETS * DIM)
        at = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :ONES]
        self.at, self.sign = at, np.take_along_axis(index, at, 1).astype(np.float64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, text: str | None, block: int = _BLOCK) -> None:
        tail = np.empty(0, np.int32)
        for ids in token_buckets(text, block):
            whole = np.concatenate([tail, ids])
            for step in range(1, WINDOW + 1):
                # pairs that lie in the tail were counted with the last block
                a, b = whole[:-step], whole[step:]
                skip = max(len(tail) - step, 0)
                self.held += [(a[skip:], b[skip:]), (b[skip:], a[skip:])]
                self.waiting += 2 * max(len(a) - skip, 0)
            tail = whole[-WINDOW:]
            if self.waiting > 500_000:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            to, near = (np.concatenate(x).astype(np.int64) for x in zip(*self.held, strict=True))
            for k in range(ONES):
                self.total += np.bincount(to * DIM + self.at[near, k], self.sign[near, k], len(self.total))
        self.held, self.waiting = [], 0

    def sums(self) -> np.ndarray:
        self._flush()
        return self.total.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + index / np.sqrt(ONES)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """[text, 2 * DIM]: mean and mean square; zeros without tokens."""
    out = np.zeros((len(texts), 2 * DIM))
    for i, text in enumerate(texts):
        n = 0
        for ids in token_buckets(text):
            bucket, times = np.unique(ids, return_counts=True)
            v, t = vectors[bucket], times.astype(np.float32)
            out[i, :DIM] += t @ v
            out[i, DIM:] += t @ (v * v)
            n += len(ids)
        out[i] /= max(n, 1)
    return out


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 1500, batch: int = 256, decay: float = 1e-3) -> Network:
    """Cross-entropy by Adam on four fifths of the rows; the temperature has the least loss on the last fifth."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    late, early = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[early].mean(0), x[early].std(0) + 1e-6, [])
    z, t = (x[early] - net.mean) / net.scale, y[early]

    def slope(p, rng):
        a, b, c, d = p
        i = rng.integers(0, len(z), min(batch, len(z)))
        h = np.maximum(z[i] @ a + b, 0)
        g = (sigmoid(h @ c + d[0]) - t[i]) / len(i)
        back = np.outer(g, c) * (h > 0)
        return [z[i].T @ back + decay * a, back.sum(0), h.T @ g + decay * c, np.array([g.sum()])]

    start = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    net.weights = minimise(start, slope, steps, 0.01)
    logit = net.logit(x[late])
    loss = {t: -np.mean(np.log(np.where(y[late] == 1, s := sigmoid(logit / t), 1 - s) + 1e-12)) for t in np.geomspace(0.25, 8, 41)} if len(late) else {1.0: 0}
    net.temperature = float(min(loss, key=loss.get))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | float]:
    """Word vectors and network from labelled rows outside the held-out fold; a number where only one label is known."""
    spark, index = docs.sparkSession, index_vectors()
    known = training_labels(known_labels(labels, "quality", MODULUS, REMAINDER), most)
    if len({y for _, y in known}) < 2:
        return index / np.float32(np.sqrt(ONES)), float(known[0][1]) if known else 0.5
    ids = spark.createDataFrame(known, "_id long, y int")
    # at most `most` ids, so the broadcast is bounded
    held = written(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y"), "quality-sample")
    sample = held.coalesce(-(-len(known) // TASK_ROWS))

    def sums(batches):
        sums = NeighbourSums(index)
        for _, (texts,) in rows_of(batches, "text"):
            for t in texts:
                sums.add(t)
        parts = [x.tobytes() for x in np.split(sums.sums().astype(np.float32), SLICES)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(parts)], names=["slice", "sums"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("sums").to_pylist())
        return pa.table({"slice": t.column("slice")[:1], "sums": pa.array([total.tobytes()])})

    # each executor adds some slices up, so that one set of vectors comes to the driver
    slices = sample.mapInArrow(sums, "slice int, sums binary").groupBy("slice").applyInArrow(added, "slice int, sums binary").collect()
    total = np.concatenate([np.frombuffer(r.sums).reshape(-1, DIM) for r in sorted(slices, key=lambda r: r.slice)]) if slices else np.zeros((BUCKETS, DIM))
    vectors = word_vectors(total, index)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for _, (doc_ids, texts, y) in rows_of(batches, "doc_id", "text", "y"):
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(list(pooled(texts, shared.value)), pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["doc_id", "x", "y"])

    rows = sorted(((r.doc_id, r.x, r.y) for r in sample.mapInArrow(pool, "doc_id long, x array<double>, y int").collect()), key=lambda r: r[0])
    discarded(held)
    if len({r[2] for r in rows}) < 2:
        return vectors, float(rows[0][2]) if rows else 0.5
    return vectors, train_network(np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, into: str = "quality_score") -> DataFrame:
    """The input's rows and columns plus quality_score (0 to 1; higher: better).

    Null and empty texts have no tokens and get the score of zero vectors. With labels of one kind
    only that label is every score, without labels 0.5. Repeated rows have equal scores; a column
    of the name `into` is replaced; no rows give none.
    """
    vectors, net = fit_quality(docs, labels, most)
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))
    docs = docs.drop(into)
    schema = plus(docs.schema, into, T.DoubleType())

    def run(batches):
        vectors, net = model.value
        for part, (texts,) in rows_of(batches, "text"):
            score = net.score(pooled(texts, vectors)) if isinstance(net, Network) else np.full(len(texts), net)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    out = score_quality(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows and columns whose score is 0.5 or more.

    Null and empty texts are scored as in `score_quality`; repeated rows share their fate, columns of
    any name stay as they are, and no rows give none.
    """
    (score,) = fresh(docs, "quality_score")
    return score_quality(docs, labels, into=score).where(F.col(score) >= 0.5).drop(score)
