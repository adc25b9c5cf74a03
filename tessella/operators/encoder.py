"""Autoencoders of feature tables: fitted on a bounded sample, applied to all rows, and what their codes say about features.

Weights are numpy arrays; layers are affine with rectified units, the last one of the decoder
with a sigmoid. Inputs are z-scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import importance

#: Most rows that an encoder is fitted on.
FIT_ROWS = 50_000
ARCHITECTURES = ("shallow", "deep", "sparse", "variational")


def layer_sizes(inputs: int, code: int | None, architecture: str) -> tuple[list[int], list[int]]:
    """Widths of the encoder and of the decoder, input and output included; a code of a quarter of the inputs, two at least, by default."""
    code = code or max(2, inputs // 4)
    wide = max(code * 2, inputs // 2)
    if architecture == "shallow":
        return [inputs, code], [code, inputs]
    if architecture == "deep":
        middle = max(int(code * 1.5), inputs // 3)
        return [inputs, wide, middle, code], [code, middle, wide, inputs]
    if architecture in ("sparse", "variational"):
        return [inputs, wide, code], [code, wide, inputs]
    raise ValueError(f"unknown architecture {architecture!r}")


#: Shares of units left out while fitting a deep encoder, by layer; its mirror image for the decoder.
_DROPOUT = {"deep": ([0.2, 0.1, 0.0], [0.1, 0.2, 0.0]), "variational": ([0.2, 0.0], [0.2, 0.0])}


@dataclass
class Autoencoder:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    encoder: list[tuple[np.ndarray, np.ndarray]]
    decoder: list[tuple[np.ndarray, np.ndarray]]
    architecture: str
    losses: list[float] = field(default_factory=list)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.nan_to_num(x) - self.mean) / self.scale

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of raw rows; of a variational one the means, which are not rectified."""
        h = self.scaled(x)
        for i, (w, b) in enumerate(self.encoder):
            h = h @ w + b
            if i + 1 < len(self.encoder) or self.architecture != "variational":
                h = np.maximum(h, 0)
        return h

    def decode(self, code: np.ndarray) -> np.ndarray:
        h = code
        for w, b in self.decoder[:-1]:
            h = np.maximum(h @ w + b, 0)
        w, b = self.decoder[-1]
        return 1 / (1 + np.exp(-(h @ w + b)))

    def error(self, x: np.ndarray) -> np.ndarray:
        """Mean squared difference of each row's z-scores from their reconstruction."""
        return ((self.decode(self.encode(x)) - self.scaled(x)) ** 2).mean(1)


def _passed(h: np.ndarray, layers: list, rng: np.random.Generator, drop: list[float], last: str) -> tuple[np.ndarray, list]:
    tape = []
    for i, (w, b) in enumerate(layers):
        z = h @ w + b
        kind = last if i + 1 == len(layers) else "relu"
        out = 1 / (1 + np.exp(-z)) if kind == "sigmoid" else z if kind == "none" else np.maximum(z, 0)
        mask = (rng.random(out.shape) >= drop[i]) / (1 - drop[i]) if drop[i] else None
        tape.append((h, out, kind, mask))
        h = out * mask if mask is not None else out
    return h, tape


def _back(g: np.ndarray, layers: list, tape: list) -> tuple[np.ndarray, list]:
    grads = []
    for (w, _), (h, out, kind, mask) in zip(reversed(layers), reversed(tape), strict=True):
        g = g * mask if mask is not None else g
        g = g * out * (1 - out) if kind == "sigmoid" else g if kind == "none" else g * (out > 0)
        grads.append((h.T @ g, g.sum(0)))
        g = g @ w.T
    return g, grads[::-1]


def fit_arrays(x: np.ndarray, features: list[str], code: int | None = None, architecture: str = "deep", epochs: int = 100, batch: int = 64, rate: float = 1e-3, held_out: float = 0.2, seed: int = 42, penalty: float = 1e-3) -> Autoencoder:
    """Adam on the mean squared error of four fifths of the rows, with weight decay; the rate halves when the others' loss has not fallen for ten epochs.

    A sparse one adds the codes' mean absolute value, a variational one draws codes around their
    means and adds their divergence from the standard normal.
    """
    rng = np.random.default_rng(seed)
    sizes = layer_sizes(x.shape[1], code, architecture)
    made = lambda s: [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(s, s[1:], strict=False)]
    x = np.nan_to_num(np.asarray(x, float))
    deviation = x.std(0)
    net = Autoencoder(features, x.mean(0), np.where(deviation > 0, deviation, 1), made(sizes[0]), made(sizes[1]), architecture)
    variational = architecture == "variational"
    spread = [(rng.uniform(-1, 1, net.encoder[-1][0].shape) / np.sqrt(sizes[0][-2]), np.zeros(sizes[0][-1]))] if variational else []
    order = rng.permutation(len(x))
    cut = int(len(x) * held_out)
    test, z = x[order[:cut]], net.scaled(x[order[cut:]])
    drop = _DROPOUT.get(architecture, ([0.0] * len(net.encoder), [0.0] * len(net.decoder)))
    groups = [net.encoder, spread, net.decoder]
    moments = [[[np.zeros_like(p) for _ in range(2) for p in layer] for layer in g] for g in groups]
    best, since, t = np.inf, 0, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            rows = z[at]
            n = max(rows.size, 1)
            h, front = _passed(rows, net.encoder[:-1], rng, drop[0][:-1], "relu")
            mean, tail = _passed(h, net.encoder[-1:], rng, drop[0][-1:], "none" if variational else "relu")
            log_var, side = _passed(h, spread, rng, [0.0], "none") if variational else (None, [])
            noise = rng.normal(size=mean.shape) if variational else None
            drawn = mean + np.exp(0.5 * log_var) * noise if variational else mean
            out, back = _passed(drawn, net.decoder, rng, drop[1], "sigmoid")
            g, decoder = _back(2 * (out - rows) / n, net.decoder, back)
            g_mean, grads_side, from_side = g, [], 0.0
            if variational:
                g_log = g * noise * 0.5 * np.exp(0.5 * log_var) + penalty * 0.5 * (np.exp(log_var) - 1) / n
                g_mean = g + penalty * mean / n
                from_side, grads_side = _back(g_log, spread, side)
            elif architecture == "sparse":
                g_mean = g + penalty * np.sign(mean) / n
            g_h, last = _back(g_mean, net.encoder[-1:], tail)
            _, first = _back(g_h + from_side, net.encoder[:-1], front)
            t += 1
            for layers, grads, moment in zip(groups, ([*first, *last], grads_side, decoder), moments, strict=True):
                for i, (layer, grad) in enumerate(zip(layers, grads, strict=True)):
                    for j, (p, d) in enumerate(zip(layer, grad, strict=True)):
                        d = d + 1e-5 * p
                        m, v = moment[i][j], moment[i][j + 2]
                        m += 0.1 * (d - m)
                        v += 0.001 * (d * d - v)
                        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss = float(net.error(test if len(test) else x).mean())
        net.losses.append(loss)
        since = 0 if loss < best else since + 1
        best = min(best, loss)
        if since > 10:
            rate, since = rate / 2, 0
    return net


def fit(df: DataFrame, features: list[str], code: int | None = None, architecture: str = "deep", most: int = FIT_ROWS, **options) -> Autoencoder:
    """An autoencoder of about `most` rows at most, chosen by a hash of their values; nulls count as 0."""
    x = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    n = x.count()
    if n > most:
        x = x.where(F.pmod(F.xxhash64(*x.columns), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return fit_arrays(x.toPandas().to_numpy(float), features, code, architecture, **options)


def encoded(df: DataFrame, net: Autoencoder) -> DataFrame:
    """The rows plus encoded, their code, and reconstruction_error; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    df = df.drop("encoded", "reconstruction_error")
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in net.features])

    @F.pandas_udf("encoded array<double>, reconstruction_error double")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = np.array(x.tolist(), float).reshape(len(x), len(shared.value.features))
        return pd.DataFrame({"encoded": list(shared.value.encode(rows)), "reconstruction_error": shared.value.error(rows)})

    return df.withColumn("_net", run(values)).select(*df.columns, "_net.encoded", "_net.reconstruction_error")


def importance_from_codes(df: DataFrame, net: Autoencoder, seed: int = 42) -> DataFrame:
    """(feature, importance) of rows (label, encoded): the importance of each code, spread by the size of the first layer's weights between it and a feature.

    Codes are numbered as the first layer's units are; units beyond that layer's width have no weight.
    """
    code = net.encoder[-1][0].shape[1]
    names = [f"encoded_{i}" for i in range(code)]
    rows = df.select("label", *[F.col("encoded")[i].alias(n) for i, n in enumerate(names)])
    of_code = {r.feature: r.importance for r in importance(rows, names, seed).collect()}
    first = np.abs(net.encoder[0][0])
    total = [float(sum(first[i, j] * max(of_code[n], 0) for j, n in enumerate(names) if j < first.shape[1])) for i in range(len(net.features))]
    return df.sparkSession.createDataFrame(list(zip(net.features, total, strict=True)), "feature string, importance double")


def reconstruction(df: DataFrame) -> DataFrame:
    """(rows, mean, max) of reconstruction_error."""
    return df.agg(F.count("*").alias("rows"), F.avg("reconstruction_error").alias("mean"), F.max("reconstruction_error").alias("max"))


def as_table(codes: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    """Rows (id, encoded) as a feature table for clustering, and its names."""
    names = [f"encoded_{i}" for i in range(size)]
    return codes.select("id", *[F.col("encoded")[i].alias(n) for i, n in enumerate(names)]), names

