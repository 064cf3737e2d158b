import json

import pytest
from pyspark.sql import functions as F

from spanforge.api import GaussianPipeline, SupervisedTyper, ZeroShotTyper
from spanforge.models import Gazetteer, HashedNgrams, detect, prototypes
from spanforge.streaming import typing as streaming

NAMES = {"Marie Curie": "person", "Curie": "person", "radium": "substance", "Paris": "city"}
TEXT = "Marie Curie found radium in Paris."


def test_detector(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "sent_id long, text string")
    got = sorted((r.start_off, r.end_off, r.span, r.cand_label) for r in detect(texts, Gazetteer(NAMES)).collect())
    assert got == [(0, 11, "Marie Curie", "person"), (18, 24, "radium", "substance"), (28, 33, "Paris", "city")]
    assert detect(texts, Gazetteer(NAMES), ["city"]).count() == 1
    assert detect(texts, Gazetteer(NAMES, 0.2), None, 0.5).count() == 0


def test_zero_shot(spark):
    typer = ZeroShotTyper(Gazetteer(NAMES, 0.9), HashedNgrams(), beta=100.0)
    for transductive in (True, False):
        got = {(r.span, r.label, r.score) for r in typer.predict(TEXT, ["person", "substance", "city"], transductive, spark).collect()}
        assert got == {("Marie Curie", "person", 0.9), ("radium", "substance", 0.9), ("Paris", "city", 0.9)}  # a large beta is the detector alone
    with pytest.raises(ValueError):
        typer.predict([TEXT], [], spark=spark)


@pytest.mark.parametrize("mode", ["raw", "context", "ensemble", "multi"])
def test_prototypes_are_unit_vectors(spark, mode):
    anchors = spark.createDataFrame([("a", ["one", "two"]), ("b", ["three"])], "label string, words array<string>")
    rows = prototypes(anchors, HashedNgrams(), mode).collect()
    assert len(rows) == (3 if mode == "multi" else 2)
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        prototypes(anchors, HashedNgrams(), "other")


@pytest.mark.parametrize("head", ["svc", "logistic"])
def test_supervised(spark, tmp_path, head):
    texts = spark.createDataFrame([(i, TEXT) for i in range(6)], "sent_id long, text string")
    gold = spark.createDataFrame([(i, s, e, x) for i in range(6) for s, e, x in ((0, 11, "person"), (18, 24, "substance"), (28, 33, "city"))], "sent_id long, start_off int, end_off int, label string")
    typer = SupervisedTyper(Gazetteer(NAMES), HashedNgrams(), head)
    with pytest.raises(RuntimeError):
        typer.predict(TEXT)
    with pytest.raises(ValueError):
        typer.fit(texts, gold.limit(0))
    typer.fit(texts, gold).save(str(tmp_path / "m"))
    again = SupervisedTyper(Gazetteer(NAMES), HashedNgrams(), head).load(spark, str(tmp_path / "m"))
    assert again.fitted.converged and again.fitted.labels == ["city", "person", "substance"]
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3  # weights, not what they come from
    assert {(r.span, r.label) for r in again.predict(TEXT).collect()} == {("Marie Curie", "person"), ("radium", "substance"), ("Paris", "city")}


def test_gaussian(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"{w} {i}") for i, w in enumerate(["Paris", "Berlin", "radium", "cobalt"] * 3)], "sent_id long, text string")
    gold = texts.select("sent_id", F.lit(0).alias("start_off"), F.lit(5).alias("end_off"), F.when(F.col("sent_id") % 4 < 2, "city").otherwise("metal").alias("label"))
    pipe = GaussianPipeline(["city", "metal", "unseen"], HashedNgrams(16))
    report = pipe.fit_supervised(texts, gold)
    assert report == {"spans": {"city": 6, "metal": 6}, "skipped": ["unseen"]}
    pipe.save(str(tmp_path / "g"))
    rows = GaussianPipeline([], HashedNgrams(16)).load(spark, str(tmp_path / "g")).predict(texts.withColumn("t", F.concat(F.lit("[ENT] "), F.substring("text", 1, 5), F.lit(" [/ENT]"), F.expr("substring(text, 6)"))), "t", "sent_id").collect()
    assert len(rows) == 12 and all(r.runner_ups[0].label == r.label for r in rows)
    assert sum((r.sent_id % 4 < 2) == (r.label == "city") for r in rows) >= 10
    assert pipe.hierarchy(0.0).count() == 1  # each includes the other: the larger bubble is the parent
    with pytest.raises(ValueError):
        GaussianPipeline(["none"], HashedNgrams()).fit_supervised(texts, gold)


def test_gaussian_from_anchors(spark, tmp_path):
    names = {"person Anna": "person", "person Bert": "person", "city Rome": "city", "city Oslo": "city"}
    texts = [f"{n} and then" for n in names] * 3 + ["nothing here", None]
    pipe = GaussianPipeline(["person", "city"], HashedNgrams(32), detector=Gazetteer(names), components=2)
    report = pipe.fit(texts, spark)
    assert (report["n_texts"], report["n_spans"], report["dim"]) == (14, 12, 32) and set(report["bubble_sizes"]) == {"person", "city"}
    assert pipe.mixtures.count() == 4 and pipe.limits.count() == 2
    pipe.save(str(tmp_path / "a"))
    again = GaussianPipeline([], HashedNgrams(32)).load(spark, str(tmp_path / "a"))
    rows = spark.createDataFrame([(i, f"[ENT] {n} [/ENT] and then") for i, n in enumerate(names)], "id long, t string")
    got = again.predict(rows, "t", "id").collect()
    assert len(got) == 4 and all(len(r.runner_ups) == 2 for r in got)
    assert again.hierarchy(0.0, 50).count() == 1
    with pytest.raises(RuntimeError):
        pipe.fit(["no name"], spark)
    with pytest.raises(ValueError):
        GaussianPipeline(["x"], HashedNgrams()).fit(texts, spark)
    with pytest.raises(RuntimeError):
        GaussianPipeline(["x"], HashedNgrams()).predict(rows, "t", "id")


def test_supervised_mixtures_begin_at_anchors(spark):
    texts = spark.createDataFrame([(i, f"{w} {i}") for i, w in enumerate(["Paris", "Berlin"] * 5)], "sent_id long, text string")
    gold = texts.select("sent_id", F.lit(0).alias("start_off"), F.lit(5).alias("end_off"), F.lit("city").alias("label"))
    pipe = GaussianPipeline(["city", "metal"], HashedNgrams(16), components=3)
    assert pipe.fit_supervised(texts, gold) == {"spans": {"city": 10}, "skipped": ["metal"]}
    assert {(r.label, r.component) for r in pipe.mixtures.collect()} == {("city", 0), ("city", 1), ("city", 2)}


def test_head(spark):
    import numpy as np

    from spanforge.operators import linear

    rows = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 2) * 2 - 1 + 0.01 * i, 1.0]) for i in range(40)], "vec_id long, label string, vec array<double>")
    test = rows.withColumnRenamed("label", "gold")
    for fit, apply in ((linear.fit_squared_hinge, linear.squared_hinge), (linear.fit_logistic, linear.logistic)):
        head = fit(rows)
        assert {r.vec_id: r.pred for r in head.predict(test).collect()} == {r.vec_id: r.pred for r in apply(rows, test).collect()}
    assert not linear.fit_squared_hinge(rows, rounds=2).converged and linear.fit_squared_hinge(rows).converged
    odd = linear.Head(["x"], np.zeros((1, 3))).predict(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, vec array<double>")).collect()
    assert [r.pred for r in odd] == [None, "x"]


def test_streaming(spark, tmp_path):
    for i, text in enumerate([TEXT, "Curie", "nothing"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"sent_id": i, "text": text}))
    protos = prototypes(spark.createDataFrame([(x, [n]) for n, x in NAMES.items() if n != "Curie"], "label string, words array<string>"), HashedNgrams(), "raw")
    query = streaming.typed(streaming.texts(spark, str(tmp_path)), Gazetteer(NAMES), HashedNgrams(), protos).writeStream.format("memory").queryName("typed").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.span, r.label) for r in spark.sql("SELECT * FROM typed").collect()} == {("Marie Curie", "person"), ("radium", "substance"), ("Paris", "city"), ("Curie", "person")}


def test_latency_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 00:11:00", "a", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.p50_ms) for r in streaming.latency_windows(rows).orderBy("window_start").collect()] == [(2, 2.0), (1, 5.0)]
