import random
import zlib

import numpy as np
import pyarrow as pa

from spanforge.llm import quality_cnn as q


def plain(text, model):
    """The network by its definition, one chunk after another."""
    data = (text or "").encode()
    logits, at = [], 0
    while True:
        chunk = data[at : at + q.CHUNK].ljust(q.CHUNK, b"\0")
        sums = np.array([sum(model["filters"][j][chunk[i + j]] for j in range(q.WIDTH)) for i in range(q.PLACES)])
        active = np.maximum(sums.max(0) + model["bias"], 0)
        logits.append(np.tanh(active @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"][0])
        if at + q.CHUNK >= len(data):
            return 1 / (1 + np.exp(-np.mean(logits)))
        at += q.STRIDE


def random_model(rng):
    return {"filters": rng.normal(size=(q.WIDTH, 256, q.FILTERS)).astype(np.float32), "bias": rng.normal(size=q.FILTERS).astype(np.float32), "w1": rng.normal(size=(q.FILTERS, q.HIDDEN)).astype(np.float32) / 9, "b1": np.zeros(q.HIDDEN, np.float32), "w2": rng.normal(size=q.HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}


def test_scores_equal_definition():
    model = random_model(np.random.default_rng(1))
    rng = random.Random(2)
    texts = [None, "", "a", "é" * 300] + ["".join(rng.choices("abc é漢\n", k=n)) for n in (255, 256, 257, 480, 481, 3000, 6100)]
    assert np.allclose(q.scores(pa.array(texts), model), [plain(t, model) for t in texts], atol=1e-4)


def test_learns_and_holds_out(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_STEPS", 150)
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "$$$" if bad else w for w in words), "x"))
        labels.append((i, int(not bad), None))
    rows += [(None, "words here", "x"), (1000, None, None), (1001, "", "x"), (1001, "", "x"), (1002, "abc " * 100_000, "x")]
    labels += [(5000, 1, None), (None, 1, None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = q.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: y for i, y, _ in labels[:400]}
    unseen = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 60 and np.mean(unseen) > 0.95


def test_no_labels_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert q.quality(docs, empty).first().score == 0.5
    assert q.quality(docs.limit(0), empty).count() == 0
