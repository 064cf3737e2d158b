import random
import re

from spanforge.llm import substring_dedup as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Rows in the order of their ids."""
    seen, out = set(), []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def check(spark, rows, window=20):
    docs = spark.createDataFrame([(d, t, "x", i, None) for i, (d, t) in enumerate(rows)], "doc_id long, text string, marks string, k long, rest string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in s.remove_repeats(docs.repartition(5), window).collect()]
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), window)
    assert sorted(got, key=str) == sorted(want, key=str)


def some(seed, n, vocabulary=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(vocabulary)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(20, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            cut = rng.randint(0, len(part))
            words += part[cut:] if rng.random() < 0.3 else part
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rng.shuffle(rows)
    return rows


def test_random_passages(spark):
    check(spark, some(1, 120))


def test_periodic_and_small_windows(spark):
    check(spark, [(3, "a b " * 40), (1, "a " * 25), (2, "b a " * 30 + "c"), (5, "a"), (6, "x " * 19), (7, "x " * 20 + "y " * 20)] + some(2, 30, 3))


def test_nulls_repeated_ids_and_long_text(spark):
    long = " ".join(str(i % 9973) for i in range(60_000))
    rows = [(None, None), (None, "q " * 30), (4, None), (4, ""), (4, long), (4, long), (5, "n " + long), (2, long + "x"), (9, " \n ")]
    check(spark, rows + some(3, 20))


def test_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT", 3)
    passage = " ".join(f"p{i}" for i in range(30))
    check(spark, [(i, f"left{i} of {passage} right{i} of" + " z" * (i % 4)) for i in range(60)])


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_regular_words_are_told_apart(spark):
    one, other = ("".join(x[bin(i).count("1") % 2] for i in range(1024)) for x in ("ab", "ba"))
    words = [f"w{i}" for i in range(20)]
    check(spark, [(1, " ".join([*words[:9], one, *words[9:]])), (2, " ".join([*words[:9], other, *words[9:]]))])


def test_key_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8), (1, "a b", 7, 8)], "doc_id long, text string, _row_key long, _row_key_ int")
    out = s.remove_repeats(docs, 2)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "", 7, 8, 2, 2), (1, "a b", 7, 8, 2, 0)]
    long = spark.createDataFrame([(1, "a b c " * 100_000)], "doc_id long, text string")
    assert s.remove_repeats(long).first().n_removed == 300_000 - 3


def test_arrays_hashes():
    import numpy as np

    from spanforge.llm.arrays import same_bytes, word_hash

    rng = random.Random(2)
    words = [b"a", b"a\0", b"abcdefgh", b"abcdefgh\0", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 70, b"x" * 70] + ["".join(rng.choices("ab", k=rng.randint(1, 20))).encode() for _ in range(500)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    h = word_hash(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words))
    of = np.array([rng.randrange(len(words)) for _ in words])
    assert same_bytes(data, starts, ends, of).tolist() == [w == words[j] for w, j in zip(words, of)]
