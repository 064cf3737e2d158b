"""Gaussian heads: one component in closed form as expressions, several by EM; scores, thresholds, hierarchy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

REGULARISE = 1e-4
#: Spread of the components around an anchor.
JITTER = 0.05


def diagonal(vectors: DataFrame) -> DataFrame:
    """(label, pos, mean, var): population variance and the regulariser."""
    long = vectors.select("label", F.posexplode("vec").alias("pos", "x"))
    return long.groupBy("label", "pos").agg(F.avg("x").alias("mean"), (F.var_pop("x") + REGULARISE).alias("var"))


def log_likelihood(vectors: DataFrame, params: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, label, ll) of each vector under each label's diagonal Gaussian; the parameters are broadcast as arrays."""
    packed = params.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "var"))).alias("p"))
    pairs = vectors.crossJoin(F.broadcast(packed))
    terms = F.zip_with("vec", "p", lambda x, p: F.log(2 * math.pi * p["var"]) + (x - p["mean"]) * (x - p["mean"]) / p["var"])
    return pairs.select(*keep, "label", (F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) * -0.5).alias("ll"))


def thresholds(ll: DataFrame, quantile: float = 0.05) -> DataFrame:
    """(label, threshold): the quantile of the log-likelihoods of a label's own gold. ll: gold, label, ll."""
    return ll.filter("gold = label").groupBy("label").agg(F.percentile("ll", F.lit(quantile)).alias("threshold"))


def classify(ll: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """(key, label, ll, is_ood): the likeliest label (rounded to 4 places, ties by name); out of domain strictly below its threshold."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("ll", 4)), "label")
    best = ll.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
    return best.join(F.broadcast(limits), "label", "left").withColumn("is_ood", F.coalesce(F.round("ll", 4) < F.round("threshold", 4), F.lit(False)))


def inclusion(ll: DataFrame, bubbles: DataFrame, least: float = 0.5) -> DataFrame:
    """(child, parent, fraction): labels of which at least that share of points lies above the parent's own median likelihood.

    Where two labels include each other the larger bubble is the parent, and of
    equal ones each is. ll holds every point's likelihood under every label, so
    label pairs arise from one aggregation and no self join of points is needed.
    """
    medians = ll.filter("gold = label").groupBy("label").agg(F.percentile("ll", F.lit(0.5)).alias("median"))
    over = ll.filter("gold <> label").join(F.broadcast(medians), "label")
    share = F.round(F.avg((F.round("ll", 4) > F.round("median", 4)).cast("int")), 6)
    shares = over.groupBy(F.col("gold").alias("child"), F.col("label").alias("parent")).agg(share.alias("fraction"))
    back = shares.select(F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("fraction").alias("back"))
    side = lambda s: bubbles.select(F.col("label").alias(s), F.round("size", 6).alias(f"size_{s}"))
    both = shares.join(back, ["child", "parent"], "left").join(side("child"), "child").join(side("parent"), "parent")
    kept = (F.col("fraction") >= least) & ((F.coalesce("back", F.lit(0.0)) < least) | (F.col("size_parent") >= F.col("size_child")))
    return both.filter(kept).select("child", "parent", "fraction")


def sizes(params: DataFrame) -> DataFrame:
    """(label, size): the trace of each label's covariance."""
    return params.groupBy("label").agg(F.sum("var").alias("size"))


def em(x: np.ndarray, k: int, rounds: int, seed: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a diagonal mixture; k is at most the number of points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    if start is None:
        mean = x[rng.choice(len(x), k, replace=False)]
    else:  # the anchor itself, and others around it
        mean = start + np.concatenate([np.zeros((1, x.shape[1])), rng.normal(0, JITTER, (k - 1, x.shape[1]))])
    var = np.tile(x.var(0) + REGULARISE, (k, 1))
    weight = np.full(k, 1 / k)
    last = -np.inf
    for _ in range(rounds):
        log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
        top = log.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
        r = np.exp(log - norm[:, None])
        n = r.sum(0) + 10 * np.finfo(float).eps
        weight, mean = n / len(x), r.T @ x / n[:, None]
        var = np.maximum(r.T @ (x * x) / n[:, None] - mean**2, 0) + REGULARISE
        if abs(norm.mean() - last) < 1e-3:
            break
        last = norm.mean()
    return weight, mean, var


def fit_mixtures(vectors: DataFrame, k: int, rounds: int = 200, seed: int = 42, most: int = 20_000) -> DataFrame:
    """(label, component, weight, mean, var) fitted per label on at most `most` of its points, those of least hash.

    The bound keeps a label that holds most rows from gathering in one task.
    """
    order = Window.partitionBy("label", "part").orderBy("h")
    dealt = vectors.select("label", "vec", F.xxhash64("vec").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    some = dealt.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= math.ceil(most / 64))
    ship(vectors.sparkSession)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h")
        w, m, v = em(np.array(frame["vec"].tolist(), float), k, rounds, seed)
        return pd.DataFrame({"label": frame["label"].iloc[0], "component": range(len(w)), "weight": w, "mean": list(m), "var": list(v)})

    return some.select("label", "vec", "h").groupBy("label").applyInPandas(fit, "label string, component int, weight double, mean array<double>, var array<double>")


def fit_anchored(vectors: DataFrame, anchors: DataFrame, k: int, rounds: int = 200, seed: int = 42, most: int = 20_000) -> DataFrame:
    """(label, component, weight, mean, var): for each label of anchors (label, vec) a mixture of all vectors, begun at the label's anchor.

    No vector has a label; the start alone tells the mixtures apart. They are
    fitted on one bounded sample, at most `most` vectors of least hash, and a label
    is a task.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(most).collect()
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r.vec for r in rows], float))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        w, m, v = em(shared.value, k, rounds, seed, np.array(frame["vec"].iloc[0], float))
        return pd.DataFrame({"label": frame["label"].iloc[0], "component": range(len(w)), "weight": w, "mean": list(m), "var": list(v)})

    if not rows:
        raise ValueError("no vectors to fit on")
    return anchors.select("label", "vec").groupBy("label").applyInPandas(fit, "label string, component int, weight double, mean array<double>, var array<double>")


def assigned_thresholds(ll: DataFrame, key: str, quantile: float = 0.05) -> DataFrame:
    """(label, threshold): the quantile of the likelihoods of the points that a label wins; a label that wins none has that of all its points."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("ll", 4)), "label")
    ranked = ll.withColumn("rank", F.row_number().over(order))
    own = F.percentile(F.when(F.col("rank") == 1, F.col("ll")), F.lit(quantile))
    return ranked.groupBy("label").agg(F.coalesce(own, F.percentile("ll", F.lit(quantile))).alias("threshold"))


def score_mixtures(vectors: DataFrame, mixtures: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, label, ll) by log-sum-exp over components; mixtures are a few rows per label, so they are broadcast."""
    comp = mixtures.groupBy("label").agg(F.collect_list(F.struct("weight", "mean", "var")).alias("c"))
    pairs = vectors.crossJoin(F.broadcast(comp))

    def one(c):
        quad = F.aggregate(F.zip_with("vec", F.arrays_zip(c["mean"].alias("m"), c["var"].alias("v")), lambda x, p: F.log(2 * math.pi * p["v"]) + (x - p["m"]) * (x - p["m"]) / p["v"]), F.lit(0.0), lambda s, t: s + t)
        return F.log(c["weight"]) - quad * 0.5

    scored = pairs.select(*keep, "label", F.transform("c", one).alias("l"))
    top = F.array_max("l")
    return scored.withColumn("top", top).select(*keep, "label", (F.col("top") + F.log(F.aggregate(F.transform("l", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda s, v: s + v))).alias("ll"))


def full(vectors: DataFrame) -> DataFrame:
    """(label, n, mean, precision, log_det): a Gaussian of full covariance for each label, REGULARISE on its diagonal.

    Tasks add up d x d sums for each label, which are added by cell; a label's
    d x d numbers meet in one row, however many vectors it has.
    """
    ship(vectors.sparkSession)

    def sums(frames):
        total: dict = {}
        for f in frames:
            for label, rows in f.groupby("label"):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows["vec"])])
                total[label] = total.get(label, 0) + x.T @ x
        for label, t in total.items():
            yield pd.DataFrame({"label": label, "i": range(len(t)), "row": list(t)})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        t = np.stack(frame.sort_values("i")["row"])
        n, mean = t[0, 0], t[0, 1:] / t[0, 0]
        cov = t[1:, 1:] / n - np.outer(mean, mean) + REGULARISE * np.eye(len(mean))
        return pd.DataFrame({"label": frame["label"].iloc[:1], "n": [int(n)], "mean": [mean], "precision": [np.linalg.inv(cov).ravel()], "log_det": [np.linalg.slogdet(cov)[1]]})

    cells = vectors.select("label", "vec").mapInPandas(sums, "label string, i int, row array<double>").select("label", "i", F.posexplode("row").alias("j", "x"))
    added = cells.groupBy("label", "i", "j").agg(F.sum("x").alias("x")).groupBy("label", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("row"))
    return added.groupBy("label").applyInPandas(solve, "label string, n long, mean array<double>, precision array<double>, log_det double")


def full_log_likelihood(vectors: DataFrame, params: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, label, ll) of vectors under each label's Gaussian of full covariance; a row of parameters a label is broadcast."""

    @F.pandas_udf("double")
    def ll(vec: pd.Series, mean: pd.Series, precision: pd.Series, log_det: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=float)
        x = np.stack(vec) - np.stack(mean)
        d = x.shape[1]
        q = np.einsum("ni,nij,nj->n", x, np.stack(precision).reshape(-1, d, d), x)
        return pd.Series(-0.5 * (d * np.log(2 * np.pi) + log_det.to_numpy() + q))

    pairs = vectors.crossJoin(F.broadcast(params))
    return pairs.select(*keep, params["label"], ll("vec", "mean", "precision", "log_det").alias("ll"))
