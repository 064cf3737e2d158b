"""Stores that resume, reports of any shape, runs that do not share their fate, and decoding."""

import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge import runs
from spanforge.operators import decode as d
from spanforge.sources import reports, resumable


def inputs(spark, change=None):
    return {k: spark.createDataFrame([(i, f"{k}{i}" + (change or "") * (k == "b/ü")) for i in range(n)], "i long, t string") for k, n in (("a", 3), ("b/ü", 2), ("01", 4))}


def test_killed_and_run_again(spark, tmp_path):
    store, calls = resumable.Results(spark, str(tmp_path / "s")), []

    def compute(key, rows):
        calls.append(key)
        if key == "b/ü" and len(calls) < 3:
            return rows.select(F.raise_error(F.lit("killed")).cast("string").alias("t"), "i")
        return rows.select("t", F.col("i").alias("n"))

    with pytest.raises(Exception, match="killed"):
        store.run(inputs(spark), compute)
    assert set(store.manifest()) == {"a"} and store.read("t string, n long").count() == 3
    assert not [f for f in os.listdir(tmp_path / "s") if f.startswith("_work")]
    again = store.run(inputs(spark), compute)
    assert (again.computed, again.reused) == (["b/ü", "01"], ["a"])
    third = store.run({k: v.orderBy(F.desc("i")) for k, v in inputs(spark).items()}, compute)
    assert third.reused == ["a", "b/ü", "01"] and len(calls) == 4  # a, b twice, 01: order changes nothing
    got = sorted(map(tuple, store.read("t string, n long").collect()))
    assert got == sorted((k, f"{k}{i}", i) for k, n in (("a", 3), ("b/ü", 2), ("01", 4)) for i in range(n))
    changed = store.run(inputs(spark, "!"), compute)
    assert changed.computed == ["b/ü"] and store.read("t string, n long").filter("t like '%!'").count() == 2
    assert store.run(inputs(spark, "!"), compute, "other parameter").computed == ["a", "b/ü", "01"]


def test_errors_are_noted(spark, tmp_path):
    store = resumable.Results(spark, str(tmp_path))

    def compute(key, rows):
        if key == "a":
            raise ValueError("no\nmore")
        return rows

    assert store.run(inputs(spark), compute, go_on=True).crashed == {"a": "ValueError: no"}
    assert store.read("i long, t string").count() == 6
    assert resumable.Results(spark, str(tmp_path / "none")).read("i long").count() == 0


def test_cache_of_triplets(spark, tmp_path):
    from spanforge.operators import triplets

    items, made = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, label string"), []

    def compute(rows):
        made.append(1)
        return triplets.sample(rows, 2, "s")

    one, two = (resumable.cached(spark, str(tmp_path / "t"), items.repartition(n), compute, "s") for n in (2, 3))
    assert len(made) == 1 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 40
    assert resumable.cached(spark, str(tmp_path / "t"), items.filter("id > 1"), compute, "s").count() == 36 and len(made) == 2


def plain(v, path=""):
    if isinstance(v, dict | list) and v:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from plain(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]")
    else:
        yield path, None if v is None or isinstance(v, dict | list) else str(v).lower() if isinstance(v, bool) else str(v)


def test_reports_of_any_shape(spark):
    shapes = [{"a": {"b": [1, {"c": None}], "d": "x"}}, [True, [], {}], 7, "text", None, {"deep": [[[[{"e": 1.5}]]]]}, {"odd.key": {"": 2}}]
    rows = [(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(90, "{not json"), (91, None)]
    got = {}
    for r in reports.flattened(spark.createDataFrame(rows, "id long, text string"), "id").collect():
        got.setdefault(r.id, []).append((r.path, r.value))
        assert r.kind in ("BIGINT", "STRING", "BOOLEAN", "NULL", "DECIMAL", "DOUBLE", "OBJECT", "ARRAY", "INVALID")
    for i, s in enumerate(shapes):
        assert sorted(got[i], key=str) == sorted(plain(s), key=str)
    assert got[90] == [("", None)] and 91 not in got


def test_newest_report(spark, tmp_path):
    for i, (name, when) in enumerate((("m-1.json", 300), ("m-2.json", 100), ("n-1.json", 200), ("n-2.json", 200))):
        (tmp_path / name).write_text(json.dumps({"v": i}))
        os.utime(tmp_path / name, (when, when))
    rows = reports.files(spark, str(tmp_path / "*.json")).withColumn("name", F.regexp_extract("file", r"([a-z])-\d\.json$", 1))
    best = reports.newest(rows, "name")
    assert sorted((r.name, r.file.rpartition("/")[2]) for r in best.collect()) == [("m", "m-1.json"), ("n", "n-2.json")]
    assert sorted((r.name, r.path, r.value) for r in reports.flattened(best, "name").collect()) == [("m", ".v", "0"), ("n", ".v", "3")]


def test_runs_do_not_share_their_fate(spark):
    def broken():
        raise OSError("gone\nfor good")

    def fit(name, rows):
        if name == "odd":
            raise ValueError("nothing to fit")

    def evaluate(name, rows):
        return rows.select(F.when((F.lit(name) == "late") & (F.col("id") == 7), F.raise_error(F.lit("row 7"))).otherwise(F.col("id")).cast("long").alias("x")).filter("x % 2 = 0")

    warm = []
    data = {"one": lambda: spark.range(10), "bad": broken, "none": lambda: spark.range(0), "odd": lambda: spark.range(3), "late": lambda: spark.range(20), "two": lambda: spark.range(5)}
    status, results = runs.run_all(spark, data, evaluate, "x long", fit, lambda: warm.append(1))
    got = {r.dataset: r for r in status.collect()}
    assert {k: r.status for k, r in got.items()} == {"one": "ok", "bad": "failed_load", "none": "no_rows", "odd": "failed_fit", "late": "crashed", "two": "ok"}
    assert (got["one"].n_rows, got["one"].n_out, got["two"].n_out) == (10, 5, 3) and got["bad"].error == "OSError: gone" and "row 7" in got["late"].error
    assert sorted(map(tuple, results.collect())) == sorted([("one", x) for x in range(0, 10, 2)] + [("two", x) for x in range(0, 5, 2)]) and warm == [1]


@pytest.mark.parametrize("seed", range(30))
def test_best_sequence_against_all(seed):
    rng = np.random.default_rng(seed)
    tags = d.bio_tags(["X", "Y"])
    start, step = d.allowed(tags)
    scores = rng.integers(0, 4, size=(rng.integers(1, 6), len(tags))).astype(float)
    every = [p for p in itertools.product(range(len(tags)), repeat=len(scores)) if start[p[0]] and all(step[a, b] for a, b in zip(p, p[1:]))]
    best = max(sum(scores[i, t] for i, t in enumerate(p)) for p in every)
    got = tuple(d.best_sequence(scores, start, step))
    assert got in every and sum(scores[i, t] for i, t in enumerate(got)) == best
    assert len(d.best_sequence(scores[:0], start, step)) == 0


def test_decode_merges_and_decodes(spark):
    # tags: O B-X I-X; the middle word has two pieces
    rows = [(1, 0, 0, 3, [0.0, 0.9, 0.1]), (1, 1, 4, 6, [0.5, 0.1, 0.4]), (1, 1, 6, 9, [0.1, 0.1, 0.8]), (1, 2, 10, 12, [0.9, 0.0, 0.1]), (2, 0, 0, 2, [0.1, 0.2, 0.7])]
    words = d.merge_pieces(spark.createDataFrame(rows, "id long, pos int, start_off int, end_off int, scores array<double>"), ["id"])
    assert words.count() == 4
    got = sorted((r.id, r.start_off, r.end_off, r.label, round(r.score, 6)) for r in d.decode(words, ["id"], ["X"]).collect())
    assert got == [(1, 0, 9, "X", 0.75), (2, 0, 2, "X", 0.2)]
    free = sorted((r.id, r.start_off, r.end_off, round(r.score, 6)) for r in d.decode(words, ["id"], ["X"], constrained=False).collect())
    assert free == [(1, 0, 9, 0.75), (2, 0, 2, 0.7)]
    assert d.decode(words.limit(0), ["id"], ["X"]).count() == 0


def test_ablation_of_each_axis(spark):
    from spanforge.operators import ablation as a

    rng = np.random.default_rng(2)
    x = np.concatenate([np.eye(3)[np.arange(90) % 3] * 3 + rng.normal(size=(90, 3)) * 0.3, rng.normal(size=(90, 3))], axis=1)
    rows = spark.createDataFrame([(i, "abc"[i % 3], x[i].tolist()) for i in range(90)], "vec_id long, gold string, vec array<double>")
    got = {(r.embedder, r.dim, r.head): r for r in a.ablate({"plain": rows, "centred": a.centred(rows)}, [1, 3, 6], {"centroid": a.centroid_head, "gaussian": a.gaussian_head}, "vec_id % 4 = 0").collect()}
    assert len(got) == 12 and all(r.n == 23 for r in got.values())
    assert got["plain", 3, "centroid"].accuracy == 1.0 and got["plain", 3, "gaussian"].macro_f1 > 0.9 and got["plain", 1, "centroid"].accuracy < 0.9
    mean = np.array([r.vec for r in a.centred(rows).collect()]).mean(0)
    assert np.allclose(mean, 0)


def test_scores_of_spans(spark):
    from spanforge.models import WordPatterns

    gold = spark.createDataFrame([(1, 0, 3, "a"), (1, 4, 6, "b"), (2, 0, 3, "a")], "sent_id long, start_off int, end_off int, label string")
    typed = spark.createDataFrame([(1, 0, 3, "a"), (1, 4, 6, "a"), (3, 0, 1, "b")], "sent_id long, start_off int, end_off int, label string")
    one = runs.score_spans(gold, typed).first()
    assert (one.n_gold, one.n_pred, one.n_matched, one.recall, one.accuracy) == (3, 3, 2, 0.666667, 0.25)
    # labels a, b and the two sentinels: only a has a hit, with 2 gold and 2 predicted
    assert one.macro_f1 == round((2 * 1 / 4) / 4, 6)
    none = runs.score_spans(gold.limit(0), typed).first()
    assert (none.n_gold, none.n_matched, none.recall) == (0, 0, 0.0)
    found = WordPatterns({"CAP": "[A-Z]", "LONG": ".{5}"}).detect(["Ab longer  x Élan", ""])
    assert found == [[(0, 2, "CAP", 1.0), (3, 9, "LONG", 1.0)], []]
    assert WordPatterns({"CAP": "[A-Z]"}).detect(["Ab"], ["LONG"]) == [[]]
