"""Vector functions and zero-shot typing over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, scratch, ship

EPSILON = 1e-12
#: Vectors of a block that brute-force neighbours are asked for.
BLOCK = 2048


def doubles(v: str) -> Column:
    return F.col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(EPSILON)))


def truncate(v: Column, dim: int) -> Column:
    return l2_normalize(F.slice(v, 1, dim))


def centroids(vectors: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """(label, vec): the normalised mean vector of each label; partial sums before the shuffle."""
    long = vectors.select(label, F.posexplode(vec).alias("pos", "x"))
    means = long.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(label, l2_normalize(F.transform("v", lambda s: s["x"])).alias("vec"))


def similarities(mentions: DataFrame, prototypes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, label, sim) of each mention with each label: its largest cosine to any of the label's prototypes.

    Prototypes are a few rows per label and are broadcast; nothing is shuffled
    where a label has one prototype a row.
    """
    protos = prototypes.groupBy("label").agg(F.collect_list("vec").alias("protos"))
    pairs = mentions.crossJoin(F.broadcast(protos))
    best = F.array_max(F.transform("protos", lambda p: dot(F.col("vec"), p)))
    return pairs.select(*keep, "label", best.alias("sim"))


def calibrate(sims: DataFrame) -> DataFrame:
    """Similarity less the label's mean similarity over all mentions; the means are a small broadcast table."""
    means = sims.groupBy("label").agg(F.avg("sim").alias("mean"))
    return sims.join(F.broadcast(means), "label").withColumn("sim", F.col("sim") - F.col("mean")).drop("mean")


def fuse(sims: DataFrame, beta: Column | float) -> DataFrame:
    """Adds beta times the detector's score where the label is the detector's candidate."""
    beta = F.lit(beta) if isinstance(beta, int | float) else beta
    return sims.withColumn("sim", F.col("sim") + F.when(F.col("label") == F.col("cand_label"), beta * F.col("score")).otherwise(0.0))


def best_label(sims: DataFrame, keys: list[str]) -> DataFrame:
    """The label of the largest similarity, rounded to 6 places; of equal ones the first by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("sim", 6)), "label")
    return sims.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def nearest(mentions: DataFrame, prototypes: DataFrame, keep: list[str], beta: float | None = None) -> DataFrame:
    """(keep, label) of each mention: what best_label chooses of similarities, fused with the detector's candidates if there is a beta.

    All labels' prototypes are one broadcast row, so a mention finds its label where
    it lies and none is shuffled; mentions are as many rows as come in.
    """
    every = prototypes.groupBy("label").agg(F.collect_list("vec").alias("protos")).agg(F.collect_list(F.struct("label", "protos")).alias("every"))

    def order(x: Column) -> Column:
        sim = F.array_max(F.transform(x["protos"], lambda p: dot(F.col("vec"), p)))
        if beta is not None:
            sim = sim + F.when(x["label"] == F.col("cand_label"), beta * F.col("score")).otherwise(0.0)
        return F.transform(F.array(F.round(sim, 6)), lambda s: F.struct(s.isNull().alias("a"), (~F.isnan(s)).alias("b"), (-s).alias("c"), x["label"].alias("label")))[0]

    rows = mentions.crossJoin(F.broadcast(every)).filter(F.size("every") > 0)
    return rows.select(*keep, F.array_min(F.transform("every", order))["label"].alias("label"))


def runner_ups(sims: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("sim", 6)), "label")
    return sims.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def refine(mentions: DataFrame, prototypes: DataFrame, rounds: int) -> DataFrame:
    """Seeded spherical k-means: prototypes move to the mean of their mentions, empty ones stay."""
    protos = prototypes.select("label", "vec")
    for _ in range(rounds):
        moved = centroids(nearest(mentions, protos, ["vec"]))
        protos = cut(protos.withColumnRenamed("vec", "old").join(moved, "label", "left").select("label", F.coalesce("vec", "old").alias("vec")))
    return protos


#: The zero-shot variants, as name, prototype mode, rounds of refinement and calibration.
VARIANTS = [
    ("raw", "raw", 0, False),
    ("context", "context", 0, False),
    ("context+calib", "context", 0, True),
    ("context+refine", "context", 3, False),
    ("context+refine+calib", "context", 3, True),
    ("ensemble", "ensemble", 0, False),
    ("ensemble+refine", "ensemble", 3, False),
    ("multi-proto", "multi", 0, False),
]


def variants(mentions: DataFrame, modes: dict[str, DataFrame], key: str) -> DataFrame:
    """(variant, key, gold, pred) of mentions(key, gold, vec) under every variant whose prototypes modes has; a refinement is made once."""
    made: dict[tuple[str, int], DataFrame] = {}
    out = None
    for name, mode, rounds, calibrated in VARIANTS:
        if mode not in modes:
            continue
        if (mode, rounds) not in made:
            made[mode, rounds] = refine(mentions, modes[mode], rounds) if rounds else cut(modes[mode].select("label", "vec"))
        sims = similarities(mentions, made[mode, rounds], [key, "gold"])
        best = best_label(calibrate(sims) if calibrated else sims, [key]).select(F.lit(name).alias("variant"), key, "gold", F.col("label").alias("pred"))
        out = best if out is None else out.unionByName(best)
    if out is None:
        raise ValueError("no prototypes of a known mode")
    return out


def knn(train: DataFrame, test: DataFrame, k: int = 15, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """Majority label of the k nearest training vectors by cosine; ties by vector id, then by label.

    Brute force without a shuffle of vectors: test vectors are broadcast a block of
    some `block` rows at a time, training vectors are read where they lie, and a task
    keeps the best k of each test vector, so k rows for each test vector and task are
    all that moves. Neither the broadcast nor what the driver holds grows with either
    table; the passes over the training vectors do, with the test vectors.
    """
    spark = train.sparkSession
    ship(spark)
    id_type = train.schema[key].dataType.simpleString()
    kept = f"{key} {id_type}, n_id {id_type}, n_label string, sim double"
    many = max(1, -(-test.count() // block))
    known = train.select(F.col(key).alias("n_id"), F.col("label").alias("n_label"), F.col("vec").alias("n_vec"))
    known = cut(known) if many > 1 else known
    path = scratch(spark, "neighbours")
    for b in range(many):
        asked = test.select(key, "vec").filter(F.pmod(F.xxhash64(key), F.lit(many)) == b).toPandas()
        if not len(asked):
            continue
        shared = spark.sparkContext.broadcast((asked[key].to_numpy(), np.stack(asked["vec"]).astype(float)))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, x = shared.value
            held: list[np.ndarray] | None = None
            for f in frames:
                if not len(f):
                    continue
                sims = np.round(x @ np.stack(f["n_vec"]).astype(float).T, 6)
                new = [sims, *(np.broadcast_to(np.array(f[c].tolist()), sims.shape) for c in ("n_id", "n_label"))]
                every = new if held is None else [np.concatenate(p, axis=1) for p in zip(held, new)]
                order = np.lexsort((every[1], -every[0]), axis=-1)[:, :k]
                held = [np.take_along_axis(e, order, 1) for e in every]
            if held is not None:
                yield pd.DataFrame({key: np.repeat(names, held[0].shape[1]), "n_id": held[1].ravel(), "n_label": held[2].ravel(), "sim": held[0].ravel()})

        known.mapInPandas(best, kept).write.mode("append").parquet(path)
    if test.isEmpty():
        scored = spark.createDataFrame([], kept)
    else:
        scored = spark.read.schema(kept).parquet(path)
    order = Window.partitionBy(key).orderBy(F.desc("sim"), "n_id")
    nearest = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    votes = nearest.groupBy(key, "n_label").agg(F.count("*").alias("votes"))
    top = Window.partitionBy(key).orderBy(F.desc("votes"), "n_label")
    return votes.withColumn("rank", F.row_number().over(top)).filter("rank = 1").select(key, F.col("n_label").alias("pred"), "votes")


def principal(vectors: DataFrame, n: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the n leading components as rows and their variances (n - 1 in the divisor) of the vectors.

    Tasks add up d x d sums, which are added by cell; d x d numbers come to the driver.
    """
    ship(vectors.sparkSession)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = np.column_stack([np.ones(len(f)), np.stack(f["v"])])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    cells = vectors.select(F.col(vec).alias("v")).mapInPandas(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((c.i for c in cells), default=0)
    total = np.zeros((d + 1, d + 1))
    for c in cells:
        total[c.i, c.j] = c.x
    count, mean = total[0, 0], total[0, 1:] / max(total[0, 0], 1)
    value, component = np.linalg.eigh((total[1:, 1:] - count * np.outer(mean, mean)) / max(count - 1, 1))
    order = np.argsort(-value)[:n]
    return mean, component[:, order].T, value[order]


def project(vectors: DataFrame, mean: np.ndarray, components: np.ndarray, vec: str = "vec") -> DataFrame:
    """vectors with vec replaced by its coordinates along the components."""
    ship(vectors.sparkSession)

    @F.pandas_udf("array<double>")
    def onto(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v) - mean) @ components.T)) if len(v) else pd.Series([], dtype=object)

    return vectors.withColumn(vec, onto(vec))
