"""Mixtures over all rows, draws from them and the hierarchy, held against numpy."""

import hashlib
import math

import numpy as np
import pytest

from spanforge.functions import draws
from spanforge.operators import em, gmm, metric_learning as ml


def digits(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def uniform(*parts):
    return (int(digits(*parts)[:8], 16) + 0.5) / 2**32


def normal(*parts):
    d = digits(*parts)
    return math.sqrt(-2 * math.log((int(d[:8], 16) + 0.5) / 2**32)) * math.cos(2 * math.pi * (int(d[8:16], 16) + 0.5) / 2**32)


def clouds(n, d=5, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 3
    return [(i, "abc"[i % 3], (centres[i % 6] + rng.normal(size=d)).tolist()) for i in range(n)]


def numpy_seeds(rows, k, seed):
    out = {}
    for label in sorted({r[1] for r in rows}):
        own = [(i, np.array(v)) for i, lab, v in rows if lab == label]
        got = [min(own, key=lambda r: (-math.log(uniform(seed, 0, r[0])), r[0]))[1]]
        for j in range(1, k):
            far = [(min(((v - s) ** 2).sum() for s in got), i, v) for i, v in own]
            far = [(-math.log(uniform(seed, j, i)) / d, i, v) for d, i, v in far if d > 0]
            if not far:
                break
            got.append(min(far, key=lambda r: r[:2])[2])
        out[label] = np.array(got)
    return out


def numpy_em(x, s, rounds, tolerance):
    w, m, v = np.full(len(s), 1 / len(s)), s, np.tile(x.var(0) + gmm.REGULARISE, (len(s), 1))
    last = -np.inf
    for _ in range(rounds):
        log = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(1) + (((x[:, None] - m) ** 2) / v).sum(2))
        norm = np.logaddexp.reduce(log, axis=1)
        r = np.exp(log - norm[:, None])
        n = r.sum(0)
        w, m, v = n / len(x), r.T @ x / n[:, None], np.maximum(r.T @ (x * x) / n[:, None] - (r.T @ x / n[:, None]) ** 2, 0) + gmm.REGULARISE
        if abs(norm.mean() - last) < tolerance:
            break
        last = norm.mean()
    return w, m, v


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("k", [1, 3])
def test_equals_numpy_em(spark, k, parts):
    rows = clouds(400)
    got = em.fit_all(spark.createDataFrame(rows, "id long, label string, vec array<double>").repartition(parts), k, seed=5)
    start = numpy_seeds(rows, k, 5)
    for label in "abc":
        w, m, v = numpy_em(np.array([x for _, lab, x in rows if lab == label]), start[label], 200, em.TOLERANCE)
        mine = got.filter(f"label = '{label}'").orderBy("component").collect()
        assert np.allclose([r.weight for r in mine], w) and np.allclose([r.mean for r in mine], m) and np.allclose([r["var"] for r in mine], v)


def test_blocks_of_labels_and_odd_rows(spark):
    rows = clouds(120) + [(1000, "one", [1.0] * 5), (1001, "same", [2.0] * 5), (1002, "same", [2.0] * 5), (1003, None, [0.0] * 5), (1004, "a", None)]
    table = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    whole = em.fit_all(table, 3)
    start = em.seeds(table.filter("label is not null and vec is not null"), 3)
    few = em.fit(table, start, block_bytes=200)
    key = lambda d: sorted((r.label, r.component, round(r.weight, 6), tuple(np.round(r.mean, 6))) for r in d.collect())
    assert key(whole) == key(few)
    count = {r.label: r["count"] for r in whole.groupBy("label").count().collect()}
    assert count == {"a": 3, "b": 3, "c": 3, "one": 1, "same": 1}
    assert em.fit_all(table.limit(0), 2).count() == 0


def test_seeds_around_anchors(spark):
    anchors = spark.createDataFrame([("a", [1.0, -2.0])], "label string, vec array<double>")
    got = np.array(em.around(anchors, 3, 9).first().seeds)
    want = np.array([[1.0, -2.0]] + [[x + gmm.JITTER * normal(9, "a", c, j) for j, x in enumerate((1.0, -2.0))] for c in (1, 2)])
    assert np.allclose(got, want)
    assert em.around(anchors, 1).first().seeds == [[1.0, -2.0]]


def test_draws(spark):
    got = spark.range(2000).select("id", draws.normal("id").alias("z"), draws.uniform("id").alias("u")).orderBy("id").collect()
    assert np.allclose([r.z for r in got], [normal(i) for i in range(2000)]) and np.allclose([r.u for r in got], [uniform(i) for i in range(2000)])
    z = np.array([r.z for r in got])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06


MIX = [("a", 0, 0.75, [0.0, 0.0], [1.0, 4.0]), ("a", 1, 0.25, [9.0, 9.0], [0.25, 0.25]), ("b", 0, 1.0, [9.0, 9.0], [0.04, 0.04]), ("c", 0, 1.0, [-50.0, 0.0], [1.0, 1.0])]


def test_draws_of_a_mixture(spark):
    table = spark.createDataFrame(MIX, em.MIXTURES)
    got = em.draw(table, 400, 3).filter("gold = 'a'").orderBy("draw").collect()
    for i, r in enumerate(got):
        _, _, _, mean, var = MIX[0] if uniform(3, "a", i) <= 0.75 else MIX[1]
        assert np.allclose(r.vec, [m + math.sqrt(v) * normal(3, "a", i, j) for j, (m, v) in enumerate(zip(mean, var))])
    assert 60 < sum(r.vec[0] > 6 for r in got) < 140


def test_hierarchy(spark):
    got = [tuple(r) for r in em.hierarchy(spark.createDataFrame(MIX, em.MIXTURES), 500).collect()]
    assert [(c, p) for c, p, _ in got] == [("b", "a")] and got[0][2] > 0.9
    two = [("x", 0, 1.0, [0.0], [1.0]), ("y", 0, 1.0, [0.0], [1.0])]  # each includes half of the other, as large
    assert {r[:2] for r in map(tuple, em.hierarchy(spark.createDataFrame(two, em.MIXTURES), 500, least=0.4).collect())} == {("x", "y"), ("y", "x")}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    a, p, n = rng.normal(size=(3, 50, 6))
    w = rng.normal(size=(6, 3))
    g, loss = ml.gradient(a, p, n, w, 1.0)
    for i, j in ((0, 0), (3, 2), (5, 1)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        assert abs((ml.gradient(a, p, n, w + d, 1.0)[1] - ml.gradient(a, p, n, w - d, 1.0)[1]) / 2e-6 - g[i, j]) < 1e-4
    assert loss > 0


def test_projection_learns_what_tells_labels_apart(spark):
    """Labels differ in two of twelve dimensions, the others are louder noise."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 12)) * ([1.0, 1.0] + [4.0] * 10)
    label = np.arange(240) % 3
    x[:, :2] += np.array([[3, 0], [-3, 3], [-3, -3]])[label]
    vectors = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(240)], "id long, label int, vec array<double>")
    ids = [(i, int((i + 3 * (1 + s)) % 240), int((i + 1 + s) % 240)) for i in range(240) for s in (0, 1)]
    learn, held = ml.held_out(spark.createDataFrame(ids, "anchor long, positive long, negative long"))
    learn_v, held_v = (ml.with_vectors(t, vectors) for t in (learn, held))
    w = ml.fit(learn_v, 2, rounds=30, rate=0.05)
    begun = ml.start(12, 2, 42)
    assert ml.mean_loss(held_v, w) < 0.6 * ml.mean_loss(held_v, begun)

    def accuracy(v):
        y = np.array([r.vec for r in v.orderBy("id").collect()])
        means = np.array([y[label == k].mean(0) for k in range(3)])
        return (((y[:, None] - means) ** 2).sum(2).argmin(1) == label).mean()

    assert accuracy(ml.project(vectors, w)) > accuracy(vectors)
    early = ml.fit(learn_v, 12, rounds=12, rate=0.05, held=held_v)
    assert ml.mean_loss(held_v, early) < ml.mean_loss(held_v, np.eye(12))
    noise = ml.with_vectors(spark.createDataFrame([(i, (i * 7 + 1) % 240, (i * 11 + 5) % 240) for i in range(60)], "anchor long, positive long, negative long"), vectors)
    kept = ml.fit(noise, 12, rounds=6, rate=0.5, held=held_v)
    assert ml.mean_loss(held_v, kept) <= ml.mean_loss(held_v, np.eye(12)) + 1e-9
    with pytest.raises(ValueError):
        ml.fit(learn_v.limit(0), 2)
    odd = ml.project(spark.createDataFrame([(1, None), (2, [0.0] * 12)], "id long, vec array<double>"), w).orderBy("id").collect()
    assert odd[0].vec is None and odd[1].vec == [0.0, 0.0]
