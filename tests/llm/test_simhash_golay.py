import random
import re

import numpy as np
import xxhash

from spanforge.llm import simhash_golay as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_golay_distance_and_keys():
    table = s.decoder()
    assert (np.bincount(table) == 2048).all() and len(np.bincount(table)) == 4096
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 500)
    near = fp.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            near[i] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
    (own, row), _ = s.golay_keys(near)
    _, (key, at) = s.golay_keys(fp)
    have = set(zip(at.tolist(), key.tolist()))
    met = {r for r, k in zip(row.tolist(), own.tolist()) if (r, k) in have}
    assert met == set(range(500))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(None, "A b c"), (7, None), (8, ""), (9, " \t\n"), (5, "one"), (5, "ONE"), (6, "two words")]
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 400))]
        rows.append((100 + i, " ".join(base)))
        if len(base) > 100:
            base[50] = "changed"
            rows.append((200 + i, "\n".join(base).upper().replace("É", "é")))
    rows += [(300, "x y z " * 70000), (301, "x y z " * 70000)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, fp long, key string")
    got = s.near_duplicates(docs)
    out = sorted(((r[0], r[1], r[2]) for r in got.select("doc_id", s.fingerprint_hex("fp"), "component_id").collect()), key=str)
    assert out == brute(rows)


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dense_groups_come_out_as_forests(spark):
    """Balls of near fingerprints, and chains between some of them: the components of all links, by few edges."""
    rng = np.random.default_rng(8)
    flip = lambda x, n: np.bitwise_xor.reduce([x, *(np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False))])
    fps = set()
    for centre in rng.integers(0, 2**63, 6).astype(np.uint64):
        fps |= {int(flip(centre, int(rng.integers(0, 3)))) for _ in range(120)}
        at = centre
        for _ in range(20):
            at = flip(at, 3)
            fps.add(int(at))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    near = np.unpackbits((fps[:, None] ^ fps[None, :]).view(np.uint8).reshape(len(fps), len(fps), 8), axis=2).sum(2) <= 3
    label = np.arange(len(fps))
    while ((new := np.array([label[n].min() for n in near])) != label).any():
        label = new
    got = {r.fp: r.component for r in s.grouped(table).collect()}
    groups = {}
    for f, c in zip(fps.tolist(), label.tolist()):
        groups.setdefault(c, set()).add(got[f])
    assert all(len(g) == 1 for g in groups.values()) and len({c for g in groups.values() for c in g}) == len(groups)
    stars = s.components(s.stars(table))
    named = table.join(stars.withColumnRenamed("id", "fp"), "fp", "left").selectExpr("fp", "coalesce(component, fp) as component")
    assert s.links(table).count() == (near.sum() - len(fps)) // 2 > 5 * (s.stars(table).count() + s.bridges(named).count())
