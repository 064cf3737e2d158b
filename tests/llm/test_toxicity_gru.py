import random
import re
import zlib

import numpy as np
import pyarrow as pa

from spanforge.llm import toxicity_gru as q
from spanforge.llm.arrays import _BYTES, span_hash, word_hash


def test_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in q.initial(np.array([1.0, 0, 0]), 1).items()}
    inputs, index, error, kept = rng.normal(size=(20, q.INPUT)), rng.integers(0, 20, (5, q.WINDOW)), rng.normal(size=5), {}
    index[0, 10:], index[4, :] = -1, -1
    q.network(inputs, index, model, kept)
    grads, _ = q.gradients(index, error, model, kept)
    for k in ("wf", "wb", "uf", "ub", "wa", "va", "cf", "bb", "wo"):
        at = tuple(rng.integers(0, s) for s in model[k].shape)
        model[k][at] += 1e-3
        up = (q.network(inputs, index, model) * error).sum()
        model[k][at] -= 2e-3
        down = (q.network(inputs, index, model) * error).sum()
        model[k][at] += 1e-3
        assert np.isclose((up - down) / 2e-3, grads[k][at], rtol=0.02, atol=2e-3)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 40, 41, 56, 57, 1000])
    starts, sizes, before = q.windows(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    for i, n in enumerate(counts):
        own = slice(before[i], before[i + 1])
        covered = {w for s, k in zip(starts[own], sizes[own]) for w in range(s, s + k)}
        assert covered == set(range(first[i], first[i + 1]))


def test_slices_do_not_change_scores():
    model = q.initial(np.array([1.0, 0.0]), 3)
    rng = random.Random(1)
    texts = [None, "", " ", "a"] + [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(n)) for n in (5, 32, 33, 100, 4000)]
    together = q.scores(pa.array(texts), model)
    assert np.allclose(together, [q.scores(pa.array([t], pa.string()), model)[0] for t in texts], atol=1e-5)


def plain(text, model):
    """The score by the definition: one word and one window after another."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))

    def given(word):
        data = np.frombuffer(word, np.uint8)
        own = word_hash(data, np.array([0]), np.array([len(data)]))
        marked = np.concatenate([[2], data, [2]]).astype(np.uint8)
        grams = [int(span_hash(_BYTES[1][marked], np.array([i]), np.array([i + k]), 1)[0]) for k in q.GRAMS for i in range(len(marked) - k + 1)] or [int(own[0])]
        return np.concatenate([model["word"][int(own[0]) % q.WORD_VECTORS], np.max([model["char"][g % q.CHAR_VECTORS] for g in grams], axis=0)])

    def read(xs, side):
        h, out = np.zeros(q.HIDDEN), []
        for x in xs:
            a, g = x @ model["w" + side] + model["b" + side], h @ model["u" + side]
            z, r = q.sigmoid(a[: q.HIDDEN] + g[: q.HIDDEN]), q.sigmoid(a[q.HIDDEN : 2 * q.HIDDEN] + g[q.HIDDEN : 2 * q.HIDDEN])
            h = z * h + (1 - z) * np.tanh(a[2 * q.HIDDEN :] + r * (g[2 * q.HIDDEN :] + model["c" + side]))
            out.append(h)
        return out

    logits, at = [], 0
    while True:
        xs = [given(w) for w in words[at : at + q.WINDOW]]
        states = [np.concatenate(p) for p in zip(read(xs, "f"), read(xs[::-1], "b")[::-1])]
        e = np.array([np.exp(np.tanh(h @ model["wa"] + model["ba"]) @ model["va"]) for h in states])
        pool = sum(a * h for a, h in zip(e / e.sum(), states)) if states else np.zeros(q.STATE)
        logits.append(pool @ model["wo"] + model["bo"][0])
        if at + q.WINDOW >= len(words):
            return float(q.sigmoid(np.max(logits)))
        at += q.STRIDE


def test_scores_by_definition():
    model = q.initial(np.array([1.0, 0.0]), 3)
    rng = random.Random(2)
    texts = [None, "", "a", "Été DÉJÀ vu", "x" * 300] + [" ".join("".join(rng.choices("abcéXY", k=rng.randint(1, 12))) for _ in range(n)) for n in (3, 31, 32, 33, 56, 57, 150)]
    assert np.allclose(q.scores(pa.array(texts), model), [plain(t, model) for t in texts], atol=1e-4)


def corpus(seed, n, share=0.25):
    """Texts in which words of a rare beginning make toxic, and their labels."""
    rng = random.Random(seed)
    part = lambda k: "".join(rng.choices("abcdefghilmnorstu", k=k))
    common = random.Random(0)
    vocab = ["".join(common.choices("abcdefghilmnorstu", k=common.randint(2, 8))) for _ in range(2000)]
    texts, y = [], []
    for _ in range(n):
        words = [part(7) if rng.random() < 0.05 else rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < share
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), "zzox" + part(3))
        texts.append(" ".join(words))
        y.append(float(bad))
    return texts, np.array(y)


def auc(scores, y):
    rank = scores.argsort().argsort()
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_the_recurrent_states_carry_the_score():
    model = q.fit(pa.array((t := corpus(1, 1500))[0]), t[1])
    texts, y = corpus(2, 400)
    own = q.scores(pa.array(texts), model)
    assert auc(own, y) >= 0.9 and (own[y == 1] >= 0.5).mean() >= 0.6 and (own[y == 0] >= 0.5).mean() < 0.05
    cut = model | {k: np.zeros_like(model[k]) for k in ("wf", "wb")}
    assert auc(q.scores(pa.array(texts), cut), y) < 0.65  # nothing goes past the states; what is left is the length


def test_learns_and_holds_out(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zzoxum", "zzoxan", "zzoxes"]))
        rows.append((i, " ".join(words), i))
        labels.append((i, int(bad), None))
    rows += [(None, "words here", 0), (1000, None, 0), (1001, "", 0), (1001, "", 0), (1002, "abc " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = q.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, y, _ in labels}
    unseen = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 60 and np.mean(unseen) > 0.95


def test_no_labels_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert q.toxicity(docs, empty).first().score == 0.5
    assert q.toxicity(docs.limit(0), empty).count() == 0
