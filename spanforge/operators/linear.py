"""Linear heads: balanced weights, logistic regression, squared-hinge SVM, thresholds, folds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import macro_f1
from ..session import ship
from .triplets import number, places


def balanced_weights(rows: DataFrame) -> DataFrame:
    """(label, weight): n / (k n_label)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def _weighted(train: DataFrame, balanced: bool) -> DataFrame:
    if not balanced:
        return train.withColumn("weight", F.lit(1.0))
    return train.join(F.broadcast(balanced_weights(train)), "label")


@dataclass
class Head:
    """A fitted linear head: labels in order, a row of weights and an intercept for each; converged tells whether fitting ended by itself."""

    labels: list[str]
    weights: np.ndarray
    converged: bool = True

    def predict(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        """rows with pred, the label of the largest score, of equal ones the first; null where the vector is."""
        ship(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast((np.array(self.labels, object), self.weights))

        @F.pandas_udf("string")
        def label(x: pd.Series) -> pd.Series:
            labels, w = shared.value
            out = pd.Series([None] * len(x), dtype=object)
            there = np.flatnonzero(x.notna())
            if len(there):
                out.iloc[there] = labels[(np.stack(x.iloc[there]).astype(float) @ w[:, :-1].T + w[:, -1]).argmax(1)]
            return out

        return rows.withColumn("pred", label(F.col(vec)))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each label with its weights, in order."""
        rows = [(i, label, w.tolist(), self.converged) for i, (label, w) in enumerate(zip(self.labels, self.weights))]
        spark.createDataFrame(rows, "place int, label string, weights array<double>, converged boolean").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Head:
        rows = spark.read.parquet(path).orderBy("place").collect()
        return Head([r.label for r in rows], np.array([r.weights for r in rows], float), all(r.converged for r in rows))


def _logistic_model(train: DataFrame, c: float, balanced: bool):
    """The fitted model and its labels in order."""
    rows = _weighted(train, balanced)
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    ready = indexer.transform(rows).withColumn("features", array_to_vector("vec")).select("features", "y", "weight").persist()
    total = ready.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", standardization=False, regParam=1 / (c * total), elasticNetParam=0.0, maxIter=200, tol=1e-8).fit(ready)
    ready.unpersist()
    return model, list(indexer.labels)


def fit_logistic(train: DataFrame, c: float = 1.0, balanced: bool = False) -> Head:
    model, labels = _logistic_model(train, c, balanced)
    weights = np.concatenate([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]], axis=1)
    return Head(labels, weights, model.summary.totalIterations < 200)


def logistic_probabilities(train: DataFrame, test: DataFrame, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """(vec_id, gold, labels, probs): multinomial logistic regression, C as in the primal sum of losses."""
    model, labels = _logistic_model(train, c, balanced)
    scored = model.transform(test.withColumn("features", array_to_vector("vec")))
    return scored.select("vec_id", "gold", F.array(*map(F.lit, labels)).alias("labels"), vector_to_array("probability").alias("probs"))


def _argmax(rows: DataFrame, scores: str) -> DataFrame:
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return rows.withColumn("pred", F.element_at("labels", best))


def logistic(train: DataFrame, test: DataFrame, c: float = 1.0, balanced: bool = False) -> DataFrame:
    return _argmax(logistic_probabilities(train, test, c, balanced), "probs")


def fit_squared_hinge(train: DataFrame, c: float = 1.0, balanced: bool = False, rounds: int = 300) -> Head:
    """One-vs-rest linear SVM with squared hinge loss, by gradient steps whose sums Spark computes; the head tells whether `rounds` were enough.

    Each round is one aggregation of per-partition gradients of all classes;
    the driver holds only the weight matrix (classes by dimensions).
    """
    ship(train.sparkSession)
    rows = _weighted(train, balanced).select("label", "weight", "vec").persist()
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    dim = rows.select(F.size("vec")).first()[0]

    def sums(w: np.ndarray):
        def run(frames):
            grad, loss, gram = np.zeros_like(w), np.zeros(len(w)), 0.0
            for f in frames:
                x = np.concatenate([np.array(f["vec"].tolist(), float), np.ones((len(f), 1))], axis=1)
                y = np.where(f["label"].to_numpy()[:, None] == np.array(labels)[None], 1.0, -1.0)
                short = np.maximum(0, 1 - y * (x @ w.T)) * f["weight"].to_numpy()[:, None]
                grad -= 2 * (short * y).T @ x
                loss += (short * np.maximum(0, 1 - y * (x @ w.T))).sum(0)
                gram += float((f["weight"].to_numpy() * (x * x).sum(1)).sum())
            yield pd.DataFrame({"grad": [grad.ravel()], "loss": [float(loss.sum())], "gram": [gram]})

        got = rows.mapInPandas(run, "grad array<double>, loss double, gram double").collect()
        return sum(np.array(r.grad) for r in got).reshape(w.shape), sum(r.gram for r in got)

    w = np.zeros((len(labels), dim + 1))
    look, t, step, moved = w.copy(), 1.0, None, np.inf
    for _ in range(rounds):  # accelerated gradient descent on |w|^2 / 2 + C * sum of losses
        grad, gram = sums(look)
        step = step or 1 / (1 + 2 * c * gram)
        new = look - step * (look + c * grad)
        if ((look - new) * (new - w)).sum() > 0:  # momentum points uphill: begin it again
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, moved = new + (t - 1) / after * (new - w), np.abs(new - w).max()
        w, t = new, after
        if moved < 1e-5:
            break
    rows.unpersist()
    return Head(labels, w, bool(moved < 1e-5))


def squared_hinge(train: DataFrame, test: DataFrame, c: float = 1.0, balanced: bool = False, rounds: int = 300) -> DataFrame:
    """test with labels, scores and pred by the squared-hinge head of train."""
    head = fit_squared_hinge(train, c, balanced, rounds)
    labels, w = head.labels, head.weights
    scores = F.array(*[F.aggregate(F.zip_with("vec", F.array(*map(F.lit, map(float, r[:-1]))), lambda x, y: x * y), F.lit(float(r[-1])), lambda s, x: s + x) for r in w])
    return _argmax(test.withColumn("labels", F.array(*map(F.lit, labels))).withColumn("scores", scores), "scores")


def tune_thresholds(probs: DataFrame, rounds: int = 2) -> DataFrame:
    """(label, threshold) by coordinate descent on macro F1 of argmax(p - t) over -0.3 to 0.3 in steps of 0.025.

    All values of a coordinate are scored in one job, crossed with the rows.
    """
    spark = probs.sparkSession
    labels = probs.select("labels").first().labels
    rows = probs.select("gold", "probs").persist()
    grid = [round(-0.3 + 0.025 * i, 3) for i in range(25)]
    best = dict.fromkeys(labels, 0.0)
    for _ in range(rounds):
        for at, label in enumerate(labels):
            options = spark.createDataFrame([(v, [v if i == at else best[x] for i, x in enumerate(labels)]) for v in grid], "value double, t array<double>")
            crossed = rows.crossJoin(F.broadcast(options)).withColumn("s", F.zip_with("probs", "t", lambda p, t: p - t))
            pairs = crossed.select("value", "gold", F.element_at(F.array(*map(F.lit, labels)), F.array_position("s", F.array_max("s")).cast("int")).alias("pred"))
            scored = macro_f1(pairs, ["value"]).collect()
            best[label] = max(scored, key=lambda r: (r.macro_f1, -abs(r.value), -r.value)).value
    rows.unpersist()
    return spark.createDataFrame(sorted(best.items()), "label string, threshold double")


def folds(rows: DataFrame, k: int, key: str) -> DataFrame:
    """(key, label, fold): a stratified fold by the place of each row among its label's, in order of hashes; no label is ordered in one task."""
    placed, _ = places(rows.select(F.col(key).alias("id"), "label"), None)
    return placed.select(F.col("id").alias(key), "label", F.pmod("place", F.lit(k)).cast("int").alias("fold"))


def out_of_fold(rows: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, gold, pred): each row's label by a head that has not seen it.

    Fewer folds where the smallest label has fewer rows; with one label that label; with a label of one row the head sees all.
    """
    counts = [r["count"] for r in rows.groupBy("label").count().collect()]
    if len(counts) < 2:
        return rows.select("vec_id", F.col("label").alias("gold"), F.col("label").alias("pred"))
    n = next((x for x in (5, 3, 2) if x <= k and min(counts) >= x), 1)
    test = rows.withColumnRenamed("label", "gold")
    if n == 1:
        return logistic(rows, test).select("vec_id", "gold", "pred")
    dealt = rows.join(folds(rows, n, "vec_id").select("vec_id", "fold"), "vec_id")
    out = None
    for f in range(n):
        part = logistic(dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f).withColumnRenamed("label", "gold")).select("vec_id", "gold", "pred")
        out = part if out is None else out.unionByName(part)
    return out


def hold_out(items: DataFrame, share: float, seed: str) -> DataFrame:
    """items(id, label) with held_out: the rounded share of each label, by md5; where a label has one item alone, that share of all items whatever their label."""
    placed, sizes = places(items, seed)
    least = sizes.agg(F.min("size").alias("least"))
    rows = placed.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(least))
    any_ = number("id", F.lit(seed)) / float(1 << 32) < share
    return rows.select("id", "label", F.when(F.col("least") > 1, F.col("place") < F.round(F.col("size") * share)).otherwise(any_).alias("held_out"))
