"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Windows of WINDOW words, each overlapping the next, cover the whole text; a
text's score is that of its worst window. A word's input is a learned vector of
the word and the maxima of learned vectors of its character n-grams. Two recurrent
passes read the window and attention weighs their states into one, which alone
gives the score. All is learned together from the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import _BYTES, LOWER, U, Words, buffers, slices, span_hash
from .labelled import held_out, labelled_sample
from .nn import Adam, sigmoid

WINDOW, STRIDE = 32, 24
DIM, HIDDEN, ATTEND = 8, 8, 8
INPUT, STATE = 2 * DIM, 2 * HIDDEN
GRAMS = (4, 5, 6, 7)
WORD_VECTORS, CHAR_VECTORS = 1 << 16, 1 << 15
#: The bounded sample that the network is fitted on: rows labelled 0 and 1, and windows of each, evenly spaced.
SAMPLE_ROWS, SAMPLE_WINDOWS = (3000, 1200), 24
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 300, 128, 1e-2, 0.005
#: Words of a batch whose own vector is left out, and how much likelier a worse window is drawn.
DROPPED, SHARPNESS = 0.5, 2.0
TOXIC_WEIGHT = 2
MODULUS, REMAINDER = 5, 0
_BLOCK = 4096
_WORDS = 1 << 14


class Vocabulary:
    """The distinct words of some rows: their hash buckets and those of their n-grams, by word."""

    def __init__(self, words: Words):
        hashes, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.of = of.astype(np.int32)
        self.word = (hashes & U(WORD_VECTORS - 1)).astype(np.int32)
        starts, ends = words.starts[first], words.ends[first]
        parts = [self._grams(words.data, starts[i : i + _WORDS], ends[i : i + _WORDS], hashes[i : i + _WORDS]) for i in range(0, len(first), _WORDS)]
        self.gram = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        self.edges = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends - starts + 2  # with a mark at either end
        begin = np.concatenate([[0], np.cumsum(n)])
        text = np.full(begin[-1], 2, np.uint8)
        inner = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
        body = (inner > 0) & (inner < np.repeat(n, n) - 1)
        text[body] = data[(np.repeat(starts, n) + inner - 1)[body]]
        at, owner = [], []
        values = _BYTES[1][text]
        word, stop = np.repeat(np.arange(len(n)), n), np.repeat(begin[1:], n)
        for k in GRAMS:
            where = np.flatnonzero(np.arange(begin[-1]) + k <= stop)
            at.append(span_hash(values, where, where + k, 1))
            owner.append(word[where])
        # a word too short for any n-gram is its own
        short = np.flatnonzero(n < GRAMS[0])
        at.append(hashes[short])
        owner.append(short)
        gram, owner = np.concatenate(at), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return (gram[order] & U(CHAR_VECTORS - 1)).astype(np.int32), np.bincount(owner, minlength=len(n))

    def inputs(self, model: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.word), INPUT), np.float32)
        for i in range(0, len(out), _WORDS):
            counts, word = self.counts[i : i + _WORDS], self.word[i : i + _WORDS]
            edges = self.edges[i : i + _WORDS] - self.edges[i]
            gram = self.gram[self.edges[i] : self.edges[i] + counts.sum()]
            part = out[i : i + _WORDS]
            part[:, :DIM] = model["word"][word]
            part[:, DIM:] = np.maximum.reduceat(model["char"][gram], edges, axis=0)
        return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of so many words: each window's first word and number of words, and windows before each row."""
    many = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    before = np.concatenate([[0], np.cumsum(many)])
    first = np.concatenate([[0], np.cumsum(counts)])
    own = np.arange(before[-1]) - np.repeat(before[:-1], many)
    starts = np.repeat(first[:-1], many) + own * STRIDE
    return starts, np.minimum(WINDOW, np.repeat(first[1:], many) - starts), before


def _pass(x: np.ndarray, mask: np.ndarray, u: np.ndarray, c: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one recurrent pass over inputs x (time, n, 3 HIDDEN)."""
    time, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((time, n, HIDDEN), np.float32)
    for t in range(time):
        g = h @ u
        gates = x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(np.minimum(gates, 30, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = g[:, 2 * HIDDEN :] + c
        new = np.tanh(x[t, :, 2 * HIDDEN :] + r * inner)
        step = (1 - z) * (new - h) * mask[t]
        if keep is not None:
            keep.append((h, z, r, inner, new))
        h = h + step
        out[t] = h
    return out


def network(inputs: np.ndarray, index: np.ndarray, model: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
    """Logits of windows; index (n, WINDOW) gives each place's row of inputs, -1 past the end."""
    mask = (index >= 0).T[:, :, None].astype(np.float32)
    padded = np.concatenate([inputs, np.zeros((1, INPUT), np.float32)])
    ahead = (padded @ model["wf"] + model["bf"])[index.T]
    back = (padded @ model["wb"] + model["bb"])[index.T[::-1]]
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    hf = _pass(ahead, mask, model["uf"], model["cf"], kept_f)
    hb = _pass(back, mask[::-1], model["ub"], model["cb"], kept_b)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    a = np.tanh(h @ model["wa"] + model["ba"])
    e = np.exp(np.clip(a @ model["va"], -30, 30)) * mask[:, :, 0]
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pool = (alpha[:, :, None] * h).sum(0)
    if keep is not None:
        keep |= {"mask": mask, "f": kept_f, "b": kept_b, "h": h, "a": a, "alpha": alpha, "pool": pool, "padded": padded}
    return pool @ model["wo"] + model["bo"][0]


def _pass_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    time, n, _ = d_out.shape
    dx, du, dc = np.empty((time, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(HIDDEN, np.float32)
    dh = np.zeros((n, HIDDEN), np.float32)
    for t in range(time - 1, -1, -1):
        h, z, r, inner, new = kept[t]
        dh = dh + d_out[t]
        ds = dh * mask[t]
        dnew = ds * (1 - z) * (1 - new * new)
        dz = -ds * (new - h) * z * (1 - z)
        dr = dnew * inner * r * (1 - r)
        dg = np.concatenate([dz, dr, dnew * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dnew], axis=1)
        du += h.T @ dg
        dc += (dnew * r).sum(0)
        dh = dh - ds * (1 - z) + dg @ u.T
    return dx, du, dc


def gradients(index: np.ndarray, error: np.ndarray, model: dict[str, np.ndarray], kept: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the inputs, for d loss / d logit = error."""
    h, a, alpha, mask = kept["h"], kept["a"], kept["alpha"], kept["mask"]
    g = {"wo": kept["pool"].T @ error, "bo": error.sum(keepdims=True)}
    dpool = error[:, None] * model["wo"]
    dalpha = (h * dpool).sum(2)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
    dh = alpha[:, :, None] * dpool
    da = dscore[:, :, None] * model["va"] * (1 - a * a)
    g["va"] = (a * dscore[:, :, None]).sum((0, 1))
    g["wa"] = h.reshape(-1, STATE).T @ da.reshape(-1, ATTEND)
    g["ba"] = da.sum((0, 1))
    dh = dh + da @ model["wa"].T
    dinput = np.zeros_like(kept["padded"])
    for side, part, order in (("f", dh[:, :, :HIDDEN], index.T), ("b", dh[::-1, :, HIDDEN:], index.T[::-1])):
        m = mask if side == "f" else mask[::-1]
        dx, g["u" + side], g["c" + side] = _pass_back(part, m, model["u" + side], kept[side])
        rows = np.zeros((len(kept["padded"]), 3 * HIDDEN), np.float32)
        np.add.at(rows, order.reshape(-1), dx.reshape(-1, 3 * HIDDEN))
        g["w" + side], g["b" + side] = kept["padded"].T @ rows, rows.sum(0)
        dinput += rows @ model["w" + side].T
    return g, dinput[:-1]


def _index(of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)
    inside = at < sizes[:, None]
    if not len(of):
        return np.full(inside.shape, -1)
    return np.where(inside, of[np.where(inside, starts[:, None] + at, 0)], -1)


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    data, offsets = buffers(column)
    words = Words(LOWER[data], offsets)
    vocabulary = Vocabulary(words)
    inputs = vocabulary.inputs(model)
    starts, sizes, before = windows(words.counts)
    logits = np.concatenate([np.zeros(0, np.float32), *(network(inputs, _index(vocabulary.of, starts[i : i + _BLOCK], sizes[i : i + _BLOCK]), model) for i in range(0, len(starts), _BLOCK))])
    return sigmoid(np.maximum.reduceat(logits.astype(np.float64), before[:-1]))


def initial(y: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {"word": (WORD_VECTORS, DIM), "char": (CHAR_VECTORS, DIM), "wf": (INPUT, 3 * HIDDEN), "wb": (INPUT, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "wa": (STATE, ATTEND), "va": ATTEND, "wo": STATE}
    model = {k: rng.normal(0, 0.05 if k in ("word", "char") else 0.3, s).astype(np.float32) for k, s in model.items()}
    model |= {k: np.zeros(s, np.float32) for k, s in {"bf": 3 * HIDDEN, "bb": 3 * HIDDEN, "cf": HIDDEN, "cb": HIDDEN, "ba": ATTEND}.items()}
    return model | {"bo": np.array([np.log((y.sum() + 1) / ((1 - y).sum() + 1))], np.float32)}


def fit(texts: pa.Array, y: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Train on texts with labels y.

    Each epoch a text is learned by one window, drawn the likelier the worse its
    windows look, at last the worst, and a clean text by any other one too.
    """
    rng = np.random.default_rng(seed)
    model = initial(y, seed)
    data, offsets = buffers(texts)
    words = Words(LOWER[data], offsets)
    vocabulary = Vocabulary(words)
    starts, sizes, before = windows(words.counts)
    picked = [np.unique(np.linspace(p, q - 1, min(q - p, SAMPLE_WINDOWS)).astype(np.int64)) for p, q in zip(before[:-1], before[1:])]
    first = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
    picked = np.concatenate(picked)
    index = _index(vocabulary.of, starts[picked], sizes[picked])
    adam = Adam(model, RATE, DECAY)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - 0.95 * epoch / epochs)
        inputs = vocabulary.inputs(model)
        logits = np.concatenate([network(inputs, index[i : i + _BLOCK], model) for i in range(0, len(index), _BLOCK)]).astype(np.float64)
        luck = rng.gumbel(size=len(logits)) * max(0.0, 1 - 2 * epoch / epochs)
        drawn = np.array([p + int(np.argmax(logits[p:q] * SHARPNESS + luck[p:q])) for p, q in zip(first[:-1], first[1:])])
        other = rng.integers(first[:-1], first[1:])
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            clean = docs[y[docs] == 0]
            own = np.concatenate([drawn[docs], other[clean]])
            target = np.concatenate([y[docs], np.zeros(len(clean))])
            used, local = np.unique(index[own], return_inverse=True)
            shift = int(len(used) > 0 and used[0] == -1)
            local = local.reshape(index[own].shape) - shift
            part = _Part(vocabulary, used[shift:])
            kept: dict = {}
            x = part.inputs(model)
            dropped = rng.random(len(x)) < DROPPED  # so that characters count as well, not words learned by heart
            x[dropped, :DIM] = 0
            p = sigmoid(network(x, local, model, kept))
            error = ((p - target) * np.where(target > 0, TOXIC_WEIGHT, 1) / len(target)).astype(np.float32)
            g, dinput = gradients(local, error, model, kept)
            dinput[dropped, :DIM] = 0
            g["word"] = np.zeros_like(model["word"])
            np.add.at(g["word"], part.word, dinput[:, :DIM])
            g["char"] = np.zeros_like(model["char"])
            owner = np.repeat(np.arange(len(x)), part.counts)
            vectors = model["char"][part.gram]
            np.add.at(g["char"], part.gram, dinput[owner, DIM:] * (vectors == np.maximum.reduceat(vectors, part.edges, axis=0)[owner]))
            adam.step(g)
    return model


class _Part(Vocabulary):
    """Some words of a vocabulary."""

    def __init__(self, whole: Vocabulary, rows: np.ndarray):
        n = whole.counts[rows]
        self.word, self.counts = whole.word[rows], n
        self.edges = np.cumsum(n) - n
        self.gram = whole.gram[np.arange(n.sum()) - np.repeat(self.edges, n) + np.repeat(whole.edges[rows], n)]


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Fit on the bounded sample, of which each text gives SAMPLE_WINDOWS windows; only those come to the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = buffers(b.column("text"))
            words = Words(data, offsets)
            out = []
            for p, q in zip(words.first[:-1], words.first[1:]):
                n, size = q - p, SAMPLE_WINDOWS * WINDOW
                keep = np.arange(p, q) if n <= size else np.unique(np.linspace(p, q - WINDOW, SAMPLE_WINDOWS).astype(np.int64)[:, None] + np.arange(WINDOW))
                out.append(b" ".join(data[words.starts[w] : words.ends[w]].tobytes() for w in keep).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.string())], ["doc_id", "y", "text"])

    sample = labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, rows)
    rows_got = sample.mapInArrow(run, "doc_id long, y int, text string").collect()
    got = sorted({(r.y, r.text): (r.doc_id, r.y, r.text) for r in sorted(rows_got, reverse=True)}.values())  # copies would pass for evidence
    y = np.array([r[1] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        model = initial(y, 0)
        model["wo"][:] = 0
        return model
    return fit(pa.array([r[2] for r in got]), y)


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Rows (doc_id, score), one for each row of docs; null and empty texts get the score of a window without words.

    Very long texts are scored in windows that cover them; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text"), shared.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    held_out is false for a null id; repeated rows get equal scores; columns
    other than doc_id and text are never read. Null, empty and very long texts
    are scored as in score_toxicity. Without labels of both kinds every score is the
    smoothed share of toxic labels. An empty table gives no rows.
    """
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
