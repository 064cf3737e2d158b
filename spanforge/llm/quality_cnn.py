"""Quality classifier: a byte-level convolutional network in numpy.

A text is read in overlapping chunks that cover all of it. Learned filters over
WIDTH bytes (a table of weights for each byte at each place) run along it; each
filter's largest value in a chunk goes through a small hidden layer to the
chunk's logit; the mean logit of all chunks gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import buffers, slices
from .labelled import held_out, labelled_sample
from .nn import Adam, sigmoid

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 256, 224, 6, 24, 16
PLACES = CHUNK - WIDTH + 1
#: The bounded sample that the network is fitted on: labelled rows, and chunks of each, evenly spaced.
SAMPLE_ROWS, SAMPLE_CHUNKS = 4000, 16
EPOCHS, LEAST_STEPS, BATCH = 8, 500, 64
MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.7
_BLOCK = 6000  # positions at once, so that their values stay in the processor's cache


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with zero bytes up to the end of their last chunk; each chunk's start; chunks before each row."""
    sizes = np.diff(offsets)
    chunks = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    room = (chunks - 1) * STRIDE + CHUNK
    begin = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(begin[-1], np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(begin[:-1] - offsets[:-1], sizes)] = data
    before = np.concatenate([[0], np.cumsum(chunks)])
    starts = np.repeat(begin[:-1], chunks) + (np.arange(before[-1]) - np.repeat(before[:-1], chunks)) * STRIDE
    return out, starts, before


def pooled(data: np.ndarray, starts: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Largest value of each filter in each chunk; starts ascend."""
    out = np.empty((len(starts), FILTERS), np.float32)
    sums, more = np.empty((2, _BLOCK, FILTERS), np.float32)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + _BLOCK - CHUNK, side="right")))
        some = data[base : starts[to - 1] + CHUNK].astype(np.intp)
        n = len(some) - WIDTH + 1
        values, term = sums[:n], more[:n]
        np.take(filters[0], some[:n], axis=0, out=values, mode="clip")
        for j in range(1, WIDTH):
            np.take(filters[j], some[j : j + n], axis=0, out=term, mode="clip")
            values += term
        own = starts[at:to] - base
        edges = np.stack([own, np.minimum(own + PLACES, n - 1)], 1).ravel()
        top = np.maximum.reduceat(values, edges, axis=0)[::2]
        last = own + PLACES > n - 1  # reduceat's end is exclusive and must lie inside
        top[last] = np.maximum(top[last], values[n - 1])
        out[at:to] = top
        at = to
    return out


def head(pool: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    active = np.maximum(pool + model["bias"], 0)
    hidden = np.tanh(active @ model["w1"] + model["b1"])
    return active, hidden, hidden @ model["w2"] + model["b2"][0]


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    data, starts, before = layout(*buffers(column))
    logits = head(pooled(data, starts, model["filters"]), model)[2]
    return sigmoid(np.add.reduceat(logits.astype(np.float64), before[:-1]) / np.diff(before))


def fit(chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Train on chunks (n, CHUNK) of documents doc (ascending) with labels y."""
    rng = np.random.default_rng(seed)
    model = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, 0.2, (FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, 0.2, HIDDEN).astype(np.float32),
        "b2": np.array([np.log((y.sum() + 1) / ((1 - y).sum() + 1))], np.float32),
    }
    adam = Adam(model, 3e-3, 1e-4)
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        adam.rate = 3e-3 * (1 - epoch / epochs) + 3e-4
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            x = chunks[rows]
            values = model["filters"][0].take(x[:, :PLACES], axis=0)
            for j in range(1, WIDTH):
                values += model["filters"][j].take(x[:, j : j + PLACES], axis=0)
            where = values.argmax(1)
            pool = np.take_along_axis(values, where[:, None], 1)[:, 0]
            active, hidden, logit = head(pool, model)
            n = np.bincount(owner, minlength=len(docs))
            error = (sigmoid(np.bincount(owner, logit, len(docs)) / n) - y[docs]) / len(docs)
            d = (error / n)[owner].astype(np.float32)
            dh = d[:, None] * model["w2"] * (1 - hidden * hidden)
            da = (dh @ model["w1"].T) * (active > 0)
            grad = np.zeros_like(model["filters"])
            r, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
            for j in range(WIDTH):
                np.add.at(grad[j], (x[r, where + j], np.broadcast_to(f, where.shape)), da)
            adam.step({"filters": grad, "bias": da.sum(0), "w1": active.T @ dh, "b1": dh.sum(0), "w2": hidden.T @ d, "b2": d.sum(keepdims=True)})
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Fit on the bounded sample; only its chunks come to the driver. Without labels of both kinds every score is the share of 1."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, starts, before = layout(*buffers(b.column("text")))
            picked = [starts[np.unique(np.linspace(p, q - 1, min(q - p, SAMPLE_CHUNKS)).astype(np.int64))] for p, q in zip(before[:-1], before[1:])]
            taken = [b"".join(data[s : s + CHUNK].tobytes() for s in p) for p in picked]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(taken, pa.binary())], ["doc_id", "y", "chunks"])

    sample = labelled_sample(docs, labels, "quality", MODULUS, REMAINDER, rows)
    got = sorted(((r.doc_id, r.y, bytes(r.chunks)) for r in sample.mapInArrow(run, "doc_id long, y int, chunks binary").collect()))
    y = np.array([r[1] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        prior = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
        shapes = {"filters": (WIDTH, 256, FILTERS), "bias": FILTERS, "w1": (FILTERS, HIDDEN), "b1": HIDDEN, "w2": HIDDEN}
        return {k: np.zeros(s, np.float32) for k, s in shapes.items()} | {"b2": np.array([prior], np.float32)}
    doc = np.repeat(np.arange(len(got)), [len(r[2]) // CHUNK for r in got])
    return fit(np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, CHUNK).astype(np.intp), doc, y)


def score_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs and their quality score (0 to 1): the score of the whole text alone.

    Null and empty texts are a chunk of padding and get that chunk's score;
    repeated rows get equal scores; all columns stay, one named score is replaced.
    Very long texts are scored in chunks that cover them; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_rest"), b.column("_text"), pa.array(scores(b.column("_text"), shared.value))], ["_rest", "_text", "score"])

    boxed = docs.select(F.struct(F.lit(0).alias("_"), *[c for c in columns if c != "text"]).alias("_rest"), F.col("text").cast("string").alias("_text"))
    kind = boxed.schema["_rest"].dataType.simpleString()
    scored = boxed.mapInArrow(run, f"_rest {kind}, _text string, score double")
    return scored.select(*[F.col("_text").alias(c) if c == "text" else F.col("_rest").getField(c).alias(c) for c in columns], "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    held_out is false for a null id; null, empty and very long texts are scored as
    in score_quality; repeated rows get equal scores; other columns are never read.
    An empty table gives no rows.
    """
    scored = score_quality(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
