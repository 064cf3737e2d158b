"""Typing accuracy along several axes at once: embedder, dimension and head, each combination on the same split."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from . import gmm, vectors

#: A head takes train(vec_id, label, vec) and test(vec_id, gold, vec) and gives (vec_id, gold, pred).
Head = Callable[[DataFrame, DataFrame], DataFrame]


def centroid_head(train: DataFrame, test: DataFrame) -> DataFrame:
    best = vectors.best_label(vectors.similarities(test, vectors.centroids(train), ["vec_id", "gold"]), ["vec_id"])
    return best.select("vec_id", "gold", F.col("label").alias("pred"))


def gaussian_head(train: DataFrame, test: DataFrame) -> DataFrame:
    """The likeliest diagonal Gaussian, rounded to 4 places, of equal ones the first by name."""
    scored = gmm.log_likelihood(test, gmm.diagonal(train), ["vec_id", "gold"]).withColumn("sim", F.round("ll", 4))
    return vectors.best_label(scored, ["vec_id"]).select("vec_id", "gold", F.col("label").alias("pred"))


def centred(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rows with the mean of all vectors taken off each; the mean is one row."""
    mean = rows.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(vec, F.zip_with(vec, "_mean", lambda x, m: x - m)).drop("_mean")


def ablate(embedders: dict[str, DataFrame], dims: list[int], heads: dict[str, Head], held_out: str) -> DataFrame:
    """(embedder, dim, head, n, accuracy, macro_f1) of each combination.

    embedders: rows (vec_id, gold, vec) by name, each cut to every dimension and made
    unit vectors; held_out is the condition on vec_id of the rows that are typed, the
    others are learned from. Combinations are branches of one union, which is counted
    once by gold and predicted label; all metrics come from these counts.
    """
    parts = []
    for name, rows in embedders.items():
        for dim in dims:
            short = rows.select("vec_id", "gold", vectors.truncate(F.col("vec"), dim).alias("vec"))
            train, test = short.filter(~F.expr(held_out)).withColumnRenamed("gold", "label"), short.filter(held_out)
            for head, fit in heads.items():
                parts.append(fit(train, test).select(F.lit(name).alias("embedder"), F.lit(dim).alias("dim"), F.lit(head).alias("head"), "gold", "pred"))
    by = ["embedder", "dim", "head"]
    table = metrics.cells(reduce(DataFrame.unionByName, parts), by)
    count = table.groupBy(*by).agg(F.sum("weight").alias("n"))
    return count.join(metrics.accuracy(table, by), by).join(metrics.macro_f1(table, by), by)
