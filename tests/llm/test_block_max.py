import math
import re
from collections import Counter

import numpy as np

from spanforge.llm import block_max as b
from spanforge.llm.arrays import buffers
from spanforge.llm.lexicon import Vocabulary, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha Beta gamma-ray delta Été 日本 x9 _under_ straße ÉTÉ ΑΒΓ".split()


def of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [Counter(of(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for c in bags for t in c)
    out = []
    for i, text in items:
        found = []
        for (d, _), c, m in zip(docs, bags, lengths):
            score = 0
            for t in of(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * m * n) // total)))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, k=20, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(parts)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, term int").repartition(2)
    got = b.search(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def corpus(n, seed=0, words=400):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(WORDS[w] if w < len(WORDS) else f"w{w}" for w in (rng.zipf(1.3, rng.integers(1, 60)) % words))) for i in range(n)]


def test_against_brute_force(spark):
    check(spark, corpus(900), corpus(25, 1))


def test_pruning_keeps_results(spark, monkeypatch):
    monkeypatch.setattr(b, "BLOCK", 4)
    monkeypatch.setattr(b, "TOGETHER", 8)
    monkeypatch.setattr(b, "TILE_TERMS", 60)
    scored = spark.sparkContext.accumulator(0)
    whole = b.Blocks.score

    def counted(self, *a):
        scored.add(1)
        return whole(self, *a)

    docs, items = corpus(600, 5), corpus(12, 6)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items_table = b.Items(b.item_terms(spark.createDataFrame(items, "item_id long, text string")).toArrow())
    index = b.forward_index(d, items_table.vocabulary).toArrow().to_batches()
    stats = b.statistics(b.forward_index(d, items_table.vocabulary), len(items_table.vocabulary.hashes))
    monkeypatch.setattr(b.Blocks, "score", counted)
    held = {}
    for batch in index:
        blocks = b.Blocks(batch, stats)
        for tile in items_table.tiles():
            b.search_block(blocks, items_table, tile, held, np.ones(len(items), np.int64), 3)
    n_blocks = sum(x.num_rows for x in index)
    assert 0 < scored.value < 0.9 * n_blocks * len(items)
    found = sorted((int(items_table.item_id[i].as_py()), int(s)) for i, h in held.items() for s in h[0])
    assert found == sorted((i, s) for i, _, _, s in brute(docs, items, 3))


def test_ties_repeats_nulls_and_empty(spark):
    docs = [(i, "alpha beta") for i in range(40)] + [(3, "alpha beta"), (None, "alpha beta"), (50, None), (51, ""), (52, "-- ..."), (53, "omega")]
    items = [(1, "Alpha alpha BETA"), (1, "alpha"), (None, "beta"), (2, None), (3, ""), (4, "nowhere"), (5, "omega omega")]
    check(spark, docs, items)
    check(spark, docs, items, k=60)


def test_empty_tables(spark):
    check(spark, [], [(1, "alpha")])
    check(spark, [(1, "alpha")], [])
    check(spark, [(1, None)], [(1, "alpha")])


def test_very_long_texts(spark):
    long = " ".join(f"t{i % 70000}" for i in range(200_000)) + " " + "z" * 100_000
    check(spark, corpus(30, 2) + [(99, long)], [(1, "t5 t6 w7"), (2, long[-200_000:]), (3, "z" * 100_000)])


def test_items_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(b, "MOST_TERMS", 50)
    check(spark, corpus(120, 8), corpus(15, 9))


def test_terms_and_vocabulary():
    import pyarrow as pa

    texts = [*(" ".join(WORDS) for _ in range(2)), "", "abcdefgh abcdefghi abcdefghabcdefgh", "a" * 5000]
    words = terms(*buffers(pa.array(texts)))
    view = bytes(words.data)
    assert [view[s:e].decode() for s, e in zip(words.starts, words.ends)] == [t for x in texts for t in of(x)]
    known = sorted({t for x in texts for t in of(x)})[::2]
    place, term = Vocabulary(known).find(words)
    flat = [t for x in texts for t in of(x)]
    assert {(int(p), known[t]) for p, t in zip(place, term)} == {(i, t) for i, t in enumerate(flat) if t in known}
