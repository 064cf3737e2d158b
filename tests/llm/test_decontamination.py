import random
import re
from collections import Counter

from spanforge.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+")


def brute(docs, items):
    best = {}
    for doc, text in docs:
        w = WORD.findall((text or "").lower())
        for item, t in items:
            iw = WORD.findall((t or "").lower())
            if not iw:
                continue
            k = min(5, len(iw))
            def shingles(x):
                return Counter(" ".join(x[i : i + k]) for i in range(len(x) - k + 1))
            want = shingles(iw)
            for s in range(max(1, len(w) - len(iw) + 1)):
                win = w[s : s + len(iw)]
                have = shingles(win)
                both = sum((have & want).values())
                sim = both / (sum(have.values()) + sum(want.values()) - both)
                if sim >= 0.8:
                    best[doc, item] = max(best.get((doc, item), (0, 1, 0)), (sim, -s, len(win)))
    return sorted(((k[0], k[1], round(v[0], 6), -v[1], v[2]) for k, v in best.items()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30, 59])))) for i in range(25)]
    items += [(3, items[3][1]), (3, "some other text for the same number here"), (None, "the item without any number at all"), (90, None), (91, " .. ")]
    docs = [(None, None), (1, ""), (2, "..."), (2, items[6][1]), (2, items[6][1])]
    for i in range(100, 200):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if item:
                at = rng.randrange(len(item))
                kind = rng.random()
                item = item[:at] + ([] if kind < 0.4 else ["new"] if kind < 0.7 else ["new", item[at]]) + item[at + 1 :]
        cut = rng.randint(0, len(words))
        part = " ".join(item)
        docs.append((i, " ".join(words[:cut]) + "\n" + (part.upper().replace(" ", ", ") if i % 3 == 0 else part) + "\n" + " ".join(words[cut:])))
    docs.append((300, "w " * 60_000 + items[7][1]))
    table = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in docs], "doc_id long, text string, item_id int, w string, start int")
    got = d.contaminations(table.repartition(4), spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int"))
    want = brute(docs, items)
    assert len(want) > 40
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_decontaminate_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 5), (2, "unrelated words", 6), (None, None, None), (2, "unrelated words", 6)], "doc_id long, text string, k int")
    items = spark.createDataFrame([(1, "A b, c d e f g h.")], "item_id long, text string")
    assert sorted(map(tuple, d.decontaminate(docs, items).collect()), key=str) == [(2, "unrelated words", 6), (2, "unrelated words", 6), (None, None, None)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.contaminations(docs.limit(0), items).count() == 0
    assert d.contaminations(docs, items.limit(0)).count() == 0
    assert d.contaminations(docs, items).count() == 1


def test_truncated_items(spark):
    rng = random.Random(5)
    sizes = [12, 13, 20, 30, 60, 61]
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate(sizes)]
    docs = []
    for i, text in items:
        w = text.split()
        for off in range(len(w) // 5 + 2):
            docs += [(100 * i + 2 * off, " ".join(w[off:])), (100 * i + 2 * off + 1, " ".join(w[: len(w) - off]))]
    got = d.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert any(r[2] < 0.85 for r in want) and any(r[4] == 11 for r in want)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_items_in_another_order(spark):
    rng = random.Random(6)
    def some(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for i in range(20):
        w = some(rng.choice([60, 80, 100]))
        at = rng.randint(len(w) // 3, 2 * len(w) // 3)
        items.append((i, " ".join(w)))
        docs.append((i, " ".join(some(rng.randint(5, 90)) + w[at:] + w[:at] + some(rng.randint(5, 90)))))
    got = d.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) == 20
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
