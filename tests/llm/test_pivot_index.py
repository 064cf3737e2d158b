import math

import numpy as np
import pytest

from spanforge.llm import pivot_index as p


def brute(rows):
    good = [v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = p.unit(np.array([v if g else [1.0] * 16 for g, (_, v) in zip(good, rows)]))
    near = (x @ x.T >= p.LEAST_COSINE) & np.outer(good, good)
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, int(near[i].sum()), c, d is not None and d == c))
    return sorted(out, key=str)


def check(spark, rows):
    table = spark.createDataFrame([(d, [None if x is None else float(x) for x in v] if v is not None else None, 1, "x") for d, v in rows], "vec_id long, embedding array<double>, label int, node string")
    assert sorted(map(tuple, p.near_duplicates(table.repartition(3)).collect()), key=str) == brute(rows)


def groups(seed, sizes, spread=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        centre = rng.normal(size=16)
        out += [(centre + rng.normal(size=16) * spread * np.linalg.norm(centre) / 4).tolist() for _ in range(n)]
    return out


def test_against_brute_force(spark):
    vectors = groups(1, [1] * 150 + [2, 3, 5, 8, 40])
    rows = [(i * 7 % 1009, v) for i, v in enumerate(vectors)]
    rows += [(5000 + i, rows[i][1]) for i in range(5)] + [(6000, (2 * np.array(rows[0][1])).tolist()), rows[0]]
    rows += [(7000, None), (7001, []), (7002, [0] * 16), (7003, [1.0] * 15 + [None]), (7004, [1.0] * 15 + [float("nan")]), (7005, [float("inf")] * 16), (7006, [1.0]), (None, None), (None, rows[3][1]), (None, [9.0] * 8 + [-9.0] * 8)]
    check(spark, rows)


def test_long_lists_are_judged_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 16)
    check(spark, list(enumerate(groups(2, [150, 1, 1, 30], 0.12))))


def test_recall_on_loose_groups():
    rng = np.random.default_rng(3)
    x = p.unit(np.array(groups(4, [3] * 500, 0.2)))
    pivots = p.choose_pivots(x[rng.permutation(len(x))[:700]], 64)
    want = set(zip(*np.nonzero(np.triu(x @ x.T >= p.LEAST_COSINE, 1))))
    perms = p.permutations(x, pivots)
    key, row = p.list_keys(perms, 64)
    found = []
    for k in np.unique(key):
        own = np.sort(row[key == k])
        found += [(a, b) for i, j in p.candidates([(int(k), 0, own, own)], perms, 64) for a, b in zip(i, j)]
    assert len(found) == len(set(found))  # a pair belongs to one list
    assert len(want) > 500 and len(want & set(found)) >= 0.9 * len(want)


def partners(rng, x, cosine):
    """A vector at this cosine of each of x."""
    z = rng.normal(size=x.shape)
    z = p.unit(z - (z * x).sum(1, keepdims=True) * x)
    return cosine * x + math.sqrt(1 - cosine * cosine) * z


@pytest.mark.parametrize("size", [16, 64, 768])
@pytest.mark.parametrize("n_pivots", [16, 64, 256, 512, 2048])
def test_recall_at_every_number_of_pivots(n_pivots, size, cosine=0.9501):
    rng = np.random.default_rng(n_pivots + size)
    pivots = p.choose_pivots(p.unit(rng.normal(size=(p.SAMPLE_ROWS // 4, size))), n_pivots)
    x = p.unit(rng.normal(size=(250, size)))
    perms = np.concatenate([p.permutations(x, pivots), p.permutations(partners(rng, x, cosine), pivots)])
    key, row = p.list_keys(perms, len(pivots))
    lists = [set() for _ in perms]
    for k, r in zip(key.tolist(), row.tolist()):
        lists[r].add(k)
    found = 0
    for i in range(250):
        two = np.array([i, i + 250])
        found += sum(len(a) for k in lists[i] & lists[i + 250] for a, _ in p.candidates([(k, 0, two, two)], perms, len(pivots)))
    assert found >= 228


def test_recall_through_spark(spark):
    """5,000 vectors in 64 dimensions with a partner each for half of them, against brute force."""
    rng = np.random.default_rng(7)
    x = p.unit(rng.normal(size=(2500, 64)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, partners(rng, x, 0.955)]))]
    got = {r.vec_id: r for r in p.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    every = p.unit(np.array([v for _, v in rows]))
    want = np.triu(every @ every.T >= p.LEAST_COSINE, 1).sum()
    assert sum(r.n_links for r in got.values()) >= 2 * 0.9 * want and want >= 2500


def test_candidates_by_definition():
    rng = np.random.default_rng(5)
    pivots, (least, moved) = 14, p.agree(14)
    perms = np.array([rng.permutation(pivots)[: p.NEAREST] for _ in range(200)], np.int32)
    key, row = p.list_keys(perms, pivots)
    found = set()
    for k in np.unique(key):
        own = np.sort(row[key == k])
        found |= {(a, b) for i, j in p.candidates([(int(k), 0, own, own)], perms, pivots) for a, b in zip(i.tolist(), j.tolist())}
    want = set()
    for a in range(200):
        for b in range(a + 1, 200):
            u, v = perms[a].tolist(), perms[b].tolist()
            both = set(u) & set(v)
            if len(both) >= least and sum(abs(u.index(z) - v.index(z)) for z in both) + (p.NEAREST - len(both)) * p.NEAREST <= moved:
                want.add((a, b))
    assert found == want and len(want) > 100


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert p.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(4, None), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, p.near_duplicates(one).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]
