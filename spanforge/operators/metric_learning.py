"""A linear projection of embeddings learned under the triplet loss, by gradients that tasks add up.

A step is one aggregation: each task adds up the gradient of its triplets, cell by
cell of the matrix, and the cells of all tasks are added. The matrix, of the two
dimensions of the projection, is what is broadcast and what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..session import cut, ship

MARGIN, ROUNDS, RATE = 1.0, 40, 0.02
#: Steps without a smaller loss on the triplets held out, after which learning ends.
PATIENCE = 4
SIDES = ("anchor", "positive", "negative")


def with_vectors(triplets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (anchor, positive, negative) of triplets of ids, from vectors(id, vec); triplets with an unknown id or a null vector are left out."""
    known = vectors.filter("vec is not null")
    for side in SIDES:
        triplets = triplets.join(known.select(F.col("id").alias(side), F.col("vec").cast("array<double>").alias(f"v_{side}")), side)
    return triplets.select(*[F.col(f"v_{s}").alias(s) for s in SIDES])


def start(size: int, dims: int, seed: int) -> np.ndarray:
    """The matrix before the first step: the identity, or dims random directions at right angles and of length one where there are fewer."""
    if dims == size:
        return np.eye(size)
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, dims)))[0]


def gradient(a: np.ndarray, p: np.ndarray, n: np.ndarray, w: np.ndarray, margin: float) -> tuple[np.ndarray, float]:
    """Sum of the gradients of max(0, |aW - pW| - |aW - nW| + margin) by W, and of the losses."""
    near, far = a - p, a - n
    u, v = near @ w, far @ w
    du, dv = (np.sqrt((x * x).sum(1, keepdims=True)) for x in (u, v))
    loss = np.maximum(0, (du - dv)[:, 0] + margin)
    on = (loss > 0)[:, None]
    return near.T @ np.where(on, u / np.maximum(du, 1e-12), 0) - far.T @ np.where(on, v / np.maximum(dv, 1e-12), 0), float(loss.sum())


def _step(rows: DataFrame, w: np.ndarray, margin: float) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of all triplets."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, count = np.zeros(shared.value.shape), 0.0, 0
        for f in frames:
            if len(f):
                g, one = gradient(*(np.stack(f[s]) for s in SIDES), shared.value, margin)
                total, loss, count = total + g, loss + one, count + len(f)
        if count:
            values = np.concatenate([total.ravel(), [loss, count]])
            yield pd.DataFrame({"cell": np.arange(len(values)), "x": values})

    found = rows.select(*SIDES).mapInPandas(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    if not len(found):
        return np.zeros_like(w), 0.0, 0
    x = found.sort_values("cell")["x"].to_numpy()
    return x[:-2].reshape(w.shape), float(x[-2]), int(x[-1])


def mean_loss(triplets: DataFrame, w: np.ndarray, margin: float = MARGIN) -> float:
    """Mean loss of triplets (anchor, positive, negative vectors) under a projection; of none it is 0."""
    ship(triplets.sparkSession)
    _, loss, n = _step(triplets, w, margin)
    return loss / n if n else 0.0


def fit(triplets: DataFrame, dims: int, rounds: int = ROUNDS, rate: float = RATE, margin: float = MARGIN, seed: int = 42, held: DataFrame | None = None) -> np.ndarray:
    """The projection (size, dims) after steps against the mean gradient of all triplets, each scaled by the root of its cells' mean squares so far.

    triplets: columns anchor, positive and negative of vectors of one length. They
    are written once; every step reads them where they lie. With held, triplets of
    the same form, the matrix of the least loss on these comes back, and learning
    ends PATIENCE steps after it: vectors that tell nothing of labels leave the start
    as it is. An empty table of triplets is an error.
    """
    ship(triplets.sparkSession)
    rows = cut(triplets.select(*SIDES))
    first = rows.first()
    if first is None:
        raise ValueError("no triplets to learn from")
    w = start(len(first.anchor), dims, seed)
    first_moment, second = np.zeros_like(w), np.zeros_like(w)
    best, least, since = w, mean_loss(held, w, margin) if held is not None else 0.0, 0
    for i in range(1, rounds + 1):
        g, _, n = _step(rows, w, margin)
        g = g / n
        first_moment, second = 0.9 * first_moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first_moment / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
        if held is not None:
            loss = mean_loss(held, w, margin)
            best, least, since = (w, loss, 0) if loss < least else (best, least, since + 1)
            if since == PATIENCE:
                break
    return w if held is None else best


def project(vectors: DataFrame, w: np.ndarray, vec: str = "vec") -> DataFrame:
    """vectors with column vec replaced by its projection, of length one; a null vector stays null, one that is projected to zero is zero."""
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna())
        if len(there):
            y = np.stack(x.iloc[there]).astype(float) @ shared.value
            y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)
            for i, row in zip(there, y):
                out.iloc[i] = row
        return out

    return vectors.withColumn(vec, run(F.col(vec)))


def held_out(triplets: DataFrame, share: float = 0.2, seed: int = 42, key: str = "anchor") -> tuple[DataFrame, DataFrame]:
    """(learned from, held out) triplets of ids, by the md5 of the anchor's id, so no anchor is in both."""
    out = draws.uniform(F.lit(f"held{seed}"), key) < share
    return triplets.filter(~out), triplets.filter(out)
