import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from spanforge.llm import importance as m
from spanforge.llm.arrays import buffers
from spanforge.llm.lexicon import terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in docs:
        np.add.at(s, buckets(x), 1)
    for x in target:
        np.add.at(t, buckets(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for d, x in docs:
        w = sum(gain[i] for i in buckets(x))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(buckets(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((i for i, (_, x) in enumerate(docs) if len(words_of(x)) >= 20), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: r + 1 for r, i in enumerate(eligible[: 5 * len(eligible) // 100])}
    return sorted(((*r, rank.get(i)) for i, r in enumerate(rows)), key=str)


def check(spark, docs, target, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, bucket string, rank int").repartition(parts)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = m.resample(d, t)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"{'Wé' if w % 3 else 'A-'}{w}" for w in rng.zipf(1.4, rng.integers(1, 120)) % 999)) for i in range(n)]


def test_against_brute_force(spark):
    check(spark, corpus(400), [t for _, t in corpus(20, 1)])


def test_repeats_nulls_and_empty(spark):
    same = "one two three " * 10
    check(spark, corpus(60, 2) + [(7, same)] * 50 + [(i, same) for i in range(100, 140)] + [(None, same), (200, None), (201, ""), (202, " .,! ")], [same, None, ""])
    check(spark, [], ["a"])
    check(spark, corpus(30, 3), [])


def test_long_text_in_stretches(spark, monkeypatch):
    long = " ".join(f"v{i * i % 5000}" for i in range(150_000))
    check(spark, [(1, long), (2, "ä" * 100_000), *corpus(25, 4)], [long[:5000]])
    monkeypatch.setattr(m, "STRETCH", 7)
    texts = [t for _, t in corpus(30, 5)]
    got = [[] for _ in texts]
    for row, bucket in m.features(terms(*buffers(pa.array(texts)))):
        for r, k in zip(row.tolist(), bucket.tolist()):
            got[r].append(k)
    assert [sorted(g) for g in got] == [sorted(buckets(t)) for t in texts]


def test_crc32():
    data = np.random.default_rng(0).integers(0, 256, 4000).astype(np.uint8)
    starts = np.arange(0, 3000, 7)
    ends = starts + np.arange(len(starts)) % 90
    assert m.crc32(data, starts, ends).tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends)]


def test_words_under_one_hash(monkeypatch):
    monkeypatch.setattr(m, "word_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = terms(*buffers(pa.array(["a bb a", "bb c"])))
    ids = m.dictionary(words, 0, 5)
    assert len(set(ids.tolist())) == 3 and ids[0] == ids[2] and ids[1] == ids[3]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as score", "id as key")
    got = [r.doc_id for r in m._in_order(rows.repartition(8)).orderBy("rank").collect()]
    assert got == sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert [r.rank for r in m._in_order(rows).orderBy("rank").collect()] == list(range(1, 5001))
