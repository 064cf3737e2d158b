"""Public typers: zero-shot, supervised and Gaussian, each DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import anchors
from .models import Detector, Embedder, embed, mentions, prototypes
from .operators import em, gmm, linear, spans, vectors
from .session import cut


def as_texts(spark: SparkSession, texts: str | Iterable[str] | DataFrame) -> DataFrame:
    """(sent_id, text) of one text, several, or a table that has them."""
    if isinstance(texts, DataFrame):
        return texts.select("sent_id", "text")
    items = [texts] if isinstance(texts, str) else list(texts)
    return spark.createDataFrame(list(enumerate(items)), "sent_id long, text string")


def _mentions(found: DataFrame, embedder: Embedder, prefix: str) -> DataFrame:
    """Detections with their texts, a key and a vector of the mention in its text; written once, as detectors and embedders are costly."""
    rows = found.withColumn("context", spans.in_context("text", "start_off", "end_off", prefix))
    rows = embed(rows, embedder, "context").withColumn("vec_id", F.struct("sent_id", "start_off", "end_off", "cand_label"))
    return cut(rows.select("vec_id", "sent_id", "start_off", "end_off", "span", "cand_label", "score", "vec"))


ENTITY = ["sent_id", "start_off", "end_off", "span"]


@dataclass
class ZeroShotTyper:
    """Types mentions by the nearest label; the score that comes out is the detector's."""

    detector: Detector
    embedder: Embedder
    beta: float = 0.05
    rounds: int = 3
    mode: str = "context"
    prefix: str = "classification: "

    def predict(self, texts, labels: list[str], transductive: bool = True, spark: SparkSession | None = None) -> DataFrame:
        spark = texts.sparkSession if isinstance(texts, DataFrame) else spark or SparkSession.getActiveSession()
        if not labels:
            raise ValueError("no labels to choose from")
        texts = as_texts(spark, texts)
        found = _mentions(mentions(texts, self.detector, labels), self.embedder, self.prefix)
        named = spark.createDataFrame([(x,) for x in labels], "label string").select("label", anchors.short_anchors(F.col("label")).alias("words"))
        protos = prototypes(named, self.embedder, self.mode)
        if transductive:
            protos = vectors.refine(found, protos, self.rounds)
        return vectors.nearest(found, protos, [*ENTITY, "score"], self.beta).select(*ENTITY, "label", "score")


@dataclass
class SupervisedTyper:
    """A balanced linear head over gold spans (sent_id, start_off, end_off, label) of texts."""

    detector: Detector
    embedder: Embedder
    head: str = "svc"
    threshold: float = 0.0
    prefix: str = "classification: "
    fitted: linear.Head | None = None

    def fit(self, texts: DataFrame, gold: DataFrame) -> SupervisedTyper:
        """Fits the head once; predict only applies it."""
        rows = gold.join(as_texts(texts.sparkSession, texts), "sent_id").withColumn("context", spans.in_context("text", "start_off", "end_off", self.prefix))
        train = cut(embed(rows, self.embedder, "context").select("label", "vec"))
        if train.isEmpty():
            raise ValueError("no spans to learn from")
        one = train.first()
        if train.filter(F.col("label") != one.label).isEmpty():
            self.fitted = linear.Head([one.label], np.zeros((1, len(one.vec) + 1)))
        else:
            self.fitted = (linear.fit_squared_hinge if self.head == "svc" else linear.fit_logistic)(train, balanced=True)
        return self

    def predict(self, texts, spark: SparkSession | None = None) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit() comes first")
        spark = texts.sparkSession if isinstance(texts, DataFrame) else spark or SparkSession.getActiveSession()
        texts = as_texts(spark, texts)
        found = _mentions(mentions(texts, self.detector, self.fitted.labels, self.threshold), self.embedder, self.prefix)
        return self.fitted.predict(found).select(*ENTITY, F.col("pred").alias("label"), "score")

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """The head's labels and weights, and nothing of what it learned from."""
        if self.fitted is None:
            raise RuntimeError("fit() comes first")
        self.fitted.save(spark or SparkSession.getActiveSession(), path)

    def load(self, spark: SparkSession, path: str) -> SupervisedTyper:
        self.fitted = linear.Head.load(spark, path)
        return self


@dataclass
class GaussianPipeline:
    """A Gaussian mixture for each declared label, thresholds for what is out of domain, and a label hierarchy.

    fit learns from texts alone, begun at the labels' anchor words; fit_supervised
    from gold spans. components is the number of each label's mixture.
    """

    labels: list[str]
    embedder: Embedder
    quantile: float = 0.05
    detector: Detector | None = None
    components: int = 1
    threshold: float = 0.0
    mode: str = "context"
    seed: int = 42
    mixtures: DataFrame | None = None
    limits: DataFrame | None = None

    def _anchors(self, spark: SparkSession) -> DataFrame:
        """(label, vec): the centroid of each label's anchor words."""
        named = spark.createDataFrame([(x,) for x in self.labels], "label string").select("label", anchors.short_anchors(F.col("label")).alias("words"))
        return vectors.centroids(prototypes(named, self.embedder, self.mode))

    def fit(self, texts, spark: SparkSession | None = None) -> dict:
        """Mixtures of all mentions that the detector finds, each begun at its label's anchors; says what was found.

        Thresholds are the quantile of the likelihoods of the mentions that a label
        wins. Without a mention there is nothing to fit, which is an error.
        """
        if self.detector is None:
            raise ValueError("fit() needs a detector")
        if not self.labels:
            raise ValueError("no labels to choose from")
        spark = texts.sparkSession if isinstance(texts, DataFrame) else spark or SparkSession.getActiveSession()
        texts = as_texts(spark, texts)
        found = _mentions(mentions(texts, self.detector, self.labels, self.threshold), self.embedder, "")
        n_spans, size = found.agg(F.count("*"), F.max(F.size("vec"))).first()
        if not n_spans:
            raise RuntimeError("the detector finds no mention in these texts")
        self.mixtures = cut(em.fit(found, em.around(self._anchors(spark), self.components, self.seed), every=True))
        scored = cut(gmm.score_mixtures(found, self.mixtures, ["vec_id"]))
        self.limits = cut(gmm.assigned_thresholds(scored, "vec_id", self.quantile))
        n_texts = texts.count()
        sizes = {r.label: r.size for r in em.sizes(self.mixtures).collect()}
        return {"n_texts": n_texts, "n_spans": n_spans, "spans_per_text": n_spans / n_texts, "dim": size, "bubble_sizes": sizes}

    def fit_supervised(self, texts: DataFrame, gold: DataFrame) -> dict:
        spark = texts.sparkSession
        declared = spark.createDataFrame([(x,) for x in self.labels], "label string")
        kept = gold.join(F.broadcast(declared), "label", "left_semi")
        rows = kept.join(as_texts(spark, texts), "sent_id").withColumn("context", spans.in_context("text", "start_off", "end_off"))
        train = cut(embed(rows, self.embedder, "context").select("label", "vec"))
        counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        if not counts:
            raise ValueError("no span has a declared label")
        if self.components == 1:
            packed = gmm.diagonal(train).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "var"))).alias("p"))
            one = packed.select("label", F.lit(0).alias("component"), F.lit(1.0).alias("weight"), F.col("p.mean").alias("mean"), F.col("p.var").alias("var"))
            self.mixtures = cut(one)
        else:
            self.mixtures = cut(em.fit(train, em.around(self._anchors(spark), self.components, self.seed)))
        scored = gmm.score_mixtures(train.withColumnRenamed("label", "gold"), self.mixtures, ["gold"])
        self.limits = cut(gmm.thresholds(scored, self.quantile))
        return {"spans": counts, "skipped": sorted(set(self.labels) - set(counts))}

    def hierarchy(self, least: float = 0.5, draws: int = 1000) -> DataFrame:
        """(child, parent, fraction), by so many draws from each label's mixture."""
        if self.mixtures is None:
            raise RuntimeError("fit() or fit_supervised() comes first")
        return em.hierarchy(self.mixtures, draws, self.seed, least)

    def predict(self, mentions: DataFrame, text: str, key: str) -> DataFrame:
        """(key, label, ll, is_ood, runner_ups) of mentions by their text; runner_ups[0] is the winner whatever its domain."""
        if self.mixtures is None:
            raise RuntimeError("fit() or fit_supervised() comes first")
        scored = cut(gmm.score_mixtures(embed(mentions, self.embedder, text), self.mixtures, [key]))
        best = gmm.classify(scored, self.limits, key)
        top = vectors.runner_ups(scored.withColumnRenamed("ll", "sim"), [key], 3)
        packed = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "label", F.round("sim", 4).alias("score")))).alias("x"))
        return best.join(packed.select(key, F.transform("x", lambda v: F.struct(v["label"].alias("label"), v["score"].alias("score"))).alias("runner_ups")), key).select(key, "label", "ll", "is_ood", "runner_ups")

    def save(self, path: str) -> None:
        self.mixtures.write.mode("overwrite").parquet(f"{path}/mixtures")
        self.limits.write.mode("overwrite").parquet(f"{path}/limits")

    def load(self, spark: SparkSession, path: str) -> GaussianPipeline:
        self.mixtures, self.limits = (spark.read.parquet(f"{path}/{n}") for n in ("mixtures", "limits"))
        return self
