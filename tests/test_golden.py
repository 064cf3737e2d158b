"""Hand-computed cases of span rules, alignment, metrics, anchors, parsers and heads."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import anchors, metrics, parsing
from spanforge.operators import align, gmm, linear, spans, triplets, vectors


def tagged(spark, words, tags):
    rows = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "s long, pos int, token string, tag string")
    return spans.token_offsets(rows, ["s"])


@pytest.mark.parametrize(
    ("words", "tags", "strict", "want"),
    [
        ("A B C D", "I-X I-X B-X I-Y", False, [(0, 3, "X"), (4, 5, "X"), (6, 7, "Y")]),
        ("A B", "X X", False, [(0, 1, "X"), (2, 3, "X")]),
        ("A B", "I-X B-X", True, [(2, 3, "X")]),
        ("A B C", "B-X I-X O", True, [(0, 3, "X")]),
        ("A B", "O O", False, []),
        ("é😀 b", "O B-X-Y", False, [(3, 4, "X-Y")]),
    ],
)
def test_bio(spark, words, tags, strict, want):
    got = spans.bio_spans(tagged(spark, words.split(), tags.split()), ["s"], strict)
    assert sorted((r.start_off, r.end_off, r.label) for r in got.collect()) == want


def fold(tags):
    """Lenient spans over word places by a plain loop."""
    out, now = [], None
    for i, t in enumerate([*tags, "O"]):
        bio, label = (None, None) if t == "O" else t.split("-")
        if now and (label != now[2] or bio == "B"):
            out.append(tuple(now))
            now = None
        if label:
            now = [now[0], i, label] if now else [i, i, label]
    return out


def test_bio_against_a_fold(spark):
    rng = random.Random(3)
    cases = {i: [rng.choice(["O", "B-X", "I-X", "B-Y", "I-Y"]) for _ in range(rng.randint(1, 15))] for i in range(80)}
    rows = spark.createDataFrame([(s, i, "w", t) for s, c in cases.items() for i, t in enumerate(c)], "s long, pos int, token string, tag string")
    got = spans.bio_spans(spans.token_offsets(rows, ["s"]), ["s"]).collect()
    assert sorted((r.s, r.first_pos, r.last_pos, r.label) for r in got) == sorted((s, *x) for s, c in cases.items() for x in fold(c))


def test_char_to_words_and_context(spark):
    offsets = tagged(spark, ["ab", "cd"], ["O", "O"])
    asked = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 2, 3)], "s long, span_id int, start_off int, end_off int")
    got = spans.char_to_word_spans(asked, offsets, ["s"]).collect()
    assert sorted((r.span_id, r.word_start, r.word_end) for r in got) == [(0, 0, 2), (1, None, None)]
    row = spark.createDataFrame([("a bc d", 2, 4)], "t string, s int, e int").select(spans.in_context("t", "s", "e", "classification: ").alias("c"), spans.in_context("t", "s", "e", mode="span").alias("p"), spans.windowed("t", "s", "e", 1).alias("w"), spans.kwic("t", "s", "e").alias("k")).first()
    assert tuple(row) == ("classification: a [ENT] bc [/ENT] d", "bc", " [ENT] bc [/ENT] ", "a [[bc]] d")
    with pytest.raises(ValueError):
        spans.in_context("t", "s", "e", mode="x")


def test_alignment(spark):
    gold = spark.createDataFrame([(0, 1, 0, "X"), (2, 3, 1, "Y")], "s long, e long, ord int, gold string")
    pred = spark.createDataFrame([(0, 1, 0, "X"), (4, 5, 1, "Y")], "s long, e long, ord int, pred string")
    pairs = align.align(gold, pred, ["s", "e"])
    assert sorted((r.gold, r.pred) for r in pairs.collect()) == [("X", "X"), ("Y", "__gold_not_predicted__"), ("__predicted_not_gold__", "Y")]
    assert metrics.accuracy(pairs).first()[0] == 0.333333 and metrics.macro_f1(pairs).first()[0] == 0.25
    twice = spark.createDataFrame([(0, 1, 0, "X"), (0, 1, 1, "Y")], "s long, e long, ord int, gold string")
    assert [(r.gold, r.pred) for r in align.align(twice, pred.limit(0), ["s", "e"]).collect()] == [("Y", "__gold_not_predicted__")]
    found = align.detection_recall(twice, pred.withColumn("score", F.lit(0.3)), ["s", "e"], [0.1, 0.5]).orderBy("threshold").collect()
    assert [(r.n_gold, r.n_pred, r.n_matched) for r in found] == [(2, 2, 1), (2, 0, 0)]


def plain_ami(a, b):
    n, ua, ub = len(a), sorted(set(a)), sorted(set(b))
    t = np.array([[sum(x == i and y == j for x, y in zip(a, b)) for j in ub] for i in ua])
    ra, rb = t.sum(1), t.sum(0)
    mi = sum(t[i, j] / n * math.log(n * t[i, j] / (ra[i] * rb[j])) for i in range(len(ua)) for j in range(len(ub)) if t[i, j])
    h = [-sum(x / n * math.log(x / n) for x in r) for r in (ra, rb)]
    g = math.lgamma
    emi = sum(k / n * math.log(n * k / (x * y)) * math.exp(g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1)) for x in ra for y in rb for k in range(max(1, x + y - n), min(x, y) + 1))
    return (mi - emi) / (sum(h) / 2 - emi)


def test_ami(spark):
    rng = random.Random(5)
    for n in (6, 40, 300):
        a = [rng.choice("abc") for _ in range(n)]
        b = [x if rng.random() < 0.6 else rng.choice("xyz") for x in a]
        got = [metrics.ami(spark.createDataFrame(list(zip(*p)), "gold string, pred string")).first()[0] for p in ((a, b), (b, a), (a, a))]
        assert abs(got[0] - plain_ami(a, b)) < 2e-6 and got[0] == got[1] and got[2] == 1.0
    assert metrics.ami(spark.createDataFrame([("a", "b")] * 3, "gold string, pred string")).first()[0] == 1.0


def test_log_factorial(spark):
    got = spark.range(0, 400).select(metrics.log_factorial(F.col("id")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(i + 1)) < 1e-10 for i, r in enumerate(got))


def test_latency_and_energy(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "k string, ms double")
    got = {r.k: tuple(r)[1:5] for r in metrics.latency(rows, ["k"], "ms").collect()}
    assert got == {"a": (4, 2.5, 3.85, 3.97), "b": (1, 7.0, 7.0, 7.0)}
    grid = spark.createDataFrame([("FRA", 52.0), ("WORLD", 475.0)], "country string, factor double")
    runs = spark.createDataFrame([("FRA", 3600.0), ("XX", 3600.0)], "country string, seconds double")
    assert {r.country: (r.kwh, r.grams) for r in metrics.energy(runs, grid, 105.0).collect()} == {"FRA": (0.105, 5.46), "XX": (0.105, 49.875)}


@pytest.mark.parametrize(
    ("label", "long", "short"),
    [
        ("creative-work", ["creative work", "creative", "work", "creative-work"], ["creative work", "creative", "work"]),
        ("PER", ["p e r", "p", "e", "r", "per"], ["per", "person", "individual", "human"]),
        ("academicjournal", ["academicjournal", "academic journal", "journal", "academic"], ["academicjournal"]),
    ],
)
def test_anchors(spark, label, long, short):
    row = spark.createDataFrame([(label,)], "l string").select(anchors.long_anchors(F.col("l")).alias("a"), anchors.short_anchors(F.col("l")).alias("b")).first()
    assert (row.a, row.b) == (long, short)


def test_template_place_is_the_first_occurrence(spark):
    rows = anchors.expand_templates(spark.createDataFrame([("l", ["example"])], "label string, words array<string>")).collect()
    assert {r.template: (r.text, r.at) for r in rows}[3] == ("an example of example", 3)


def test_parsers(spark):
    row = spark.createDataFrame([('He said ["a", 7, " b "] and ["c"]', 'bad [a, "x"] "y"', "Marie,(B-per), Curie(I-per)", "aXbaXb aX")], "a string, b string, c string, d string").select(
        parsing.first_json_strings(F.col("a")).alias("a"), parsing.first_json_strings(F.col("b")).alias("b"), parsing.word_tag_pairs(F.col("c")).alias("c"), parsing.greedy_spans(F.col("d"), F.array(F.lit("aX"), F.lit("Xb"), F.lit("aX"), F.lit("zz"))).alias("d"), parsing.locate(F.col("d"), F.lit("XB")).alias("e")
    ).first()
    assert row.a == ["a", "b"] and row.b == ["x"] and [tuple(p) for p in row.c] == [("Marie,", "B-per"), ("Curie", "I-per")]
    assert [(s.start_off, s.end_off) for s in row.d] == [(0, 2), (4, 6), (7, 9)] and row.e == 1


def test_refine_and_fusion(spark):
    points = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.9, 0.2]), (3, [0.1, 1.0])], "vec_id long, vec array<double>")
    protos = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "label string, vec array<double>")
    same = {r.label: r.vec for r in vectors.refine(points, protos, 0).collect()}
    moved = {r.label: r.vec for r in vectors.refine(points, protos, 2).collect()}
    assert same["a"] == [1.0, 0.0] and moved["c"] == [-1.0, 0.0] and moved["a"] != [1.0, 0.0]
    sims = vectors.similarities(points, protos, ["vec_id"]).withColumn("cand_label", F.lit("c")).withColumn("score", F.lit(0.5))
    assert {r.label for r in vectors.best_label(vectors.fuse(sims, 1e6), ["vec_id"]).collect()} == {"c"}
    assert [r.label for r in vectors.best_label(vectors.fuse(sims, 0), ["vec_id"]).orderBy("vec_id").collect()] == ["a", "a", "b"]


def test_heads(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "xy"[i % 2], (rng.normal(size=3) + (3 if i % 2 else -3)).tolist()) for i in range(60)]
    train = spark.createDataFrame(rows, "vec_id long, label string, vec array<double>")
    test = train.withColumnRenamed("label", "gold")
    for typed in (linear.squared_hinge(train, test, balanced=True), linear.logistic(train, test), linear.out_of_fold(train), vectors.knn(train, test, 5).join(test, "vec_id")):
        assert all(r.gold == r.pred for r in typed.collect())
    mixed = gmm.score_mixtures(test, gmm.fit_mixtures(train, 2), ["vec_id", "gold"]).withColumnRenamed("ll", "sim")
    assert all(r.gold == r.label for r in vectors.best_label(mixed, ["vec_id"]).collect())
    limits = spark.createDataFrame([("x", -3.0)], "label string, threshold double")
    edge = spark.createDataFrame([(1, "x", -3.0), (2, "x", -3.1)], "k long, label string, ll double")
    assert {r.k: r.is_ood for r in gmm.classify(edge, limits, "k").collect()} == {1: False, 2: True}
    weights = {r.label: r.weight for r in linear.balanced_weights(spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")).collect()}
    assert weights == {"a": 4 / 6, "b": 2.0}
    made = triplets.sample(train.select(F.col("vec_id").alias("id"), "label"), 2, "1").collect()
    again = triplets.sample(train.repartition(5).select(F.col("vec_id").alias("id"), "label"), 2, "1").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made))
    assert len(made) == 120 and all(r.anchor != r.positive and (r.anchor - r.positive) % 2 == 0 and (r.anchor - r.negative) % 2 for r in made)


def test_triplet_edges(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, label string")
    made = triplets.sample(items.filter("label is not null"), 2, "s").collect()
    assert sorted((r.anchor, r.positive, r.negative) for r in made) == [(1, 2, 3), (2, 1, 3)]
    assert triplets.sample(items.filter("label = 'a'"), 2, "s").count() == 0 and triplets.sample(items.limit(0), 1, "s").count() == 0
    assert triplets.sample(items.filter("label is not null"), 1, "s", excluded=["b"]).count() == 0
    errors = spark.createDataFrame([(1, "a", "b"), (9, "b", "c")], "id long, gold string, pred string")
    hard = triplets.hard_negatives(errors, items, "s", 1)
    assert all((r.anchor, r.positive, r.negative) == (1, 2, 3) for r in hard.collect()) and hard.count() <= 1
    mixed = triplets.mix(hard.limit(0).union(spark.createDataFrame([(i, 0, 0, 1) for i in range(9)], "a long, p long, n long, r int")), triplets.sample(items.filter("label is not null"), 1, "s"), 4, 0.5, "s")
    assert sorted(r.kind for r in mixed.collect()) == ["easy", "easy", "hard", "hard"]
    with_labels, _ = triplets.entity_triplets(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "doc_id long, id long, label string"), "s", same_doc=1.0)
    assert {(r.anchor, r.positive, r.negative) for r in with_labels.collect() if r.anchor < 3} == {(1, "a", "b"), (2, "b", "a")}


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(230, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, "abc"[i % 3], x[i].tolist()) for i in range(230)], "vec_id long, label string, vec array<double>")
    got = {r.vec_id: (r.pred, r.votes) for r in vectors.knn(rows.filter("vec_id >= 30"), rows.filter("vec_id < 30"), 7, block=40).collect()}
    for i in range(30):
        near = sorted(range(30, 230), key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:7]
        votes = {c: sum("abc"[j % 3] == c for j in near) for c in "abc"}
        assert got[i] == min(((c, n) for c, n in votes.items() if n), key=lambda p: (-p[1], p[0]))


def test_principal_components_and_full_gaussians(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5)) + np.arange(5)
    rows = spark.createDataFrame([(i, "xy"[i % 2], (x[i] + (i % 2) * 2).tolist()) for i in range(120)], "vec_id long, label string, vec array<double>")
    data = np.array([r.vec for r in rows.orderBy("vec_id").collect()])
    mean, components, variances = vectors.principal(rows, 3)
    assert np.allclose(mean, data.mean(0)) and np.allclose(variances, np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1][:3])
    low = np.array([r.vec for r in vectors.project(rows, mean, components).orderBy("vec_id").collect()])
    assert np.allclose(np.cov(low.T), np.diag(variances), atol=1e-9)
    params = gmm.full(rows)
    got = {(r.vec_id, r.label): r.ll for r in gmm.full_log_likelihood(rows, params, ["vec_id"]).collect()}
    for label in "xy":
        own = data[["xy"[i % 2] == label for i in range(120)]]
        cov = np.cov(own.T, bias=True) + gmm.REGULARISE * np.eye(5)
        d = data - own.mean(0)
        want = -0.5 * (5 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + (d * np.linalg.solve(cov, d.T).T).sum(1))
        assert all(abs(got[i, label] - want[i]) < 1e-6 for i in range(120))


def test_variants_by_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)) + np.repeat(np.eye(4)[:3] * 1.5, 20, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mentions = spark.createDataFrame([(i, "abc"[i // 20], x[i].tolist()) for i in range(60)], "vec_id long, gold string, vec array<double>")
    start = np.eye(4)[:3] + 0.1
    start /= np.linalg.norm(start, axis=1, keepdims=True)
    protos = spark.createDataFrame([(c, start[i].tolist()) for i, c in enumerate("abc")], "label string, vec array<double>")
    got = {}
    for r in vectors.variants(mentions, {"context": protos, "multi": protos.union(protos)}, "vec_id").collect():
        got.setdefault(r.variant, {})[r.vec_id] = r.pred
    assert set(got) == {"context", "context+calib", "context+refine", "context+refine+calib", "multi-proto"}
    c = start
    for _ in range(3):
        own = (x @ c.T).round(6).argmax(1)
        c = np.stack([(m := x[own == j].mean(0)) / np.linalg.norm(m) if (own == j).any() else c[j] for j in range(3)])
    for name, p in (("context", start), ("context+refine", c)):
        sims = x @ p.T
        assert [got[name][i] for i in range(60)] == ["abc"[j] for j in sims.round(6).argmax(1)]
        assert [got[f"{name}+calib"][i] for i in range(60)] == ["abc"[j] for j in (sims - sims.mean(0)).round(6).argmax(1)]
    assert got["multi-proto"] == got["context"]


def test_hold_out(spark):
    items = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id long, label string")
    held = linear.hold_out(items, 0.2, "s").filter("held_out").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in held} == {"a": 18, "b": 2}
    lone = linear.hold_out(items.union(spark.createDataFrame([(1000, "z")], items.schema)), 0.2, "s")
    assert lone.count() == 101 and 5 < lone.filter("held_out").count() < 40


def test_realignment():
    pairs = [("Marie", "B-per"), ("extra", "O"), ("CURIE", " I-per "), ("won", ""), ("x", "B-loc")]
    assert parsing.realigned_tags(["Marie", "Curie", "missing", "won", "a"], pairs) == ["B-per", "I-per", "O", "O", "O"]
    assert parsing.realigned_tags(["far"], [("1", "O"), ("2", "O"), ("3", "O"), ("4", "O"), ("far", "B-x")]) == ["O"]
    assert parsing.realigned_tags(["w"], []) == ["O"] and parsing.realigned_tags([], pairs) == []


def test_placed_and_typed_entities(spark):
    row = spark.createDataFrame([("abab ab Paris", '[{"text": "ab", "type": "Creative Work"}, {"text": "bab", "type": "LOC"}, {"text": "ab", "type": "loc"}, {"text": "Paris", "type": "none"}]')], "t string, o string")
    got = row.select(parsing.typed_entities(F.col("o"), F.col("t"), ["creative_work", "LOC"]).alias("s"), parsing.typed_entities(F.lit("no list"), F.col("t"), ["LOC"]).alias("n")).first()
    assert [tuple(s) for s in got.s] == [(0, 2, "creative_work"), (2, 4, "LOC")] and got.n == []


def test_open_report_without_a_declared_label(spark):
    typed = spark.createDataFrame([("x", "OOD", "a", -1.0), ("x", "a", "a", -2.0)], "gold string, pred string, best string, ll double")
    rows = {(r.section, r.name, r.metric): r.value for r in metrics.open_report(typed, ["a", "b"]).collect()}
    assert rows["total", "all", "accuracy_in_schema"] == 0.0 and rows["unknown", "x", "recall"] == 0.5 and rows["confusion", "b", "OOD"] == 0.0 and rows["loglik", "x", "max"] == -1.0


def test_bootstrap_by_definition(spark):
    rng = random.Random(9)
    gold = [rng.choice("abc") for _ in range(90)]
    pred = [g if rng.random() < 0.7 else rng.choice("abc") for g in gold]
    pairs = spark.createDataFrame(list(zip(gold, pred)), "gold string, pred string")
    drawn = {}
    for r in metrics.resamples(pairs, 6, 5).collect():
        drawn.setdefault(r.replicate, []).extend([(r.gold, r.pred)] * r.weight)
    assert sorted(drawn) == list(range(6)) and all(len(d) == 90 and set(d) <= set(zip(gold, pred)) for d in drawn.values())
    assert len({tuple(sorted(d)) for d in drawn.values()}) > 1
    rows = {r.metric: r for r in metrics.bootstrap(pairs, 6, 5).collect()}
    amis = [plain_ami(*zip(*d)) for d in drawn.values()]

    def f1(d):
        labels = {x for p in d for x in p}
        one = lambda c: 2 * sum(p == (c, c) for p in d) / (sum(p[0] == c for p in d) + sum(p[1] == c for p in d))
        return sum(map(one, labels)) / len(labels)

    for metric, values in (("ami", amis), ("macro_f1", [f1(d) for d in drawn.values()])):
        want = (np.mean(values), np.std(values, ddof=1), *np.percentile(values, [2.5, 97.5]))
        assert all(abs(x - y) < 5e-6 for x, y in zip(tuple(rows[metric])[1:], want))
    assert metrics.bootstrap(pairs.limit(0), 6, 5).count() == 0


def test_threshold_tuning_by_plain_descent(spark):
    rng = np.random.default_rng(11)
    probs = rng.dirichlet([2, 1, 1], 60)
    gold = ["abc"[int(np.argmax(p + rng.normal(0, 0.2, 3) + [-0.15, 0, 0.1]))] for p in probs]
    rows = spark.createDataFrame([(g, list("abc"), p.tolist()) for g, p in zip(gold, probs)], "gold string, labels array<string>, probs array<double>")
    got = {r.label: r.threshold for r in linear.tune_thresholds(rows, 1).collect()}

    def score(t):
        pred = ["abc"[int(np.argmax(p - t))] for p in probs]
        labels = set(gold) | set(pred)
        return round(sum(2 * sum(g == p == c for g, p in zip(gold, pred)) / (gold.count(c) + pred.count(c)) for c in labels) / len(labels), 6)

    t = np.zeros(3)
    for at in range(3):
        options = [round(-0.3 + 0.025 * i, 3) for i in range(25)]
        t[at] = max(options, key=lambda v: (score(np.where(np.arange(3) == at, v, t)), -abs(v), -v))
    assert [got[c] for c in "abc"] == t.tolist()


def test_anchored_mixtures_start_at_their_anchor(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(-3, 1, (80, 2)), rng.normal(3, 1, (80, 2))])
    _, mean, _ = gmm.em(x, 2, 0, 1, np.array([5.0, 5.0]))
    assert mean[0].tolist() == [5.0, 5.0] and 0 < np.abs(mean[1] - 5).max() < 6 * gmm.JITTER
    points = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    anchors_ = spark.createDataFrame([("low", [-3.0, -3.0]), ("high", [3.0, 3.0])], "label string, vec array<double>")
    got = gmm.fit_anchored(points, anchors_, 2).collect()
    assert sorted((r.label, r.component) for r in got) == [("high", 0), ("high", 1), ("low", 0), ("low", 1)]
    assert all(abs(sum(r.weight for r in got if r.label == label) - 1) < 1e-9 for label in ("low", "high"))
    with pytest.raises(ValueError):
        gmm.fit_anchored(points.limit(0), anchors_, 2)
