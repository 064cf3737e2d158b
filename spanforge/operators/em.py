"""Gaussian mixtures by expectation-maximisation over all rows.

A round is one aggregation: tasks add up, for each label and component, the
responsibilities of their rows and the sums of their values and squares, and the
sums of all tasks are added. Rows never move and no label gathers in a task. The
parameters of a block of labels, bounded in bytes, are what is broadcast and what
the driver holds; there are as many blocks as the labels need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..session import cut, ship
from . import gmm
from .gmm import JITTER, REGULARISE

MIXTURES = "label string, component int, weight double, mean array<double>, var array<double>"
#: Parameters of the labels that are fitted together.
BLOCK_BYTES = 8 << 20
TOLERANCE = 1e-3
_EPS = 10 * np.finfo(float).eps

#: Weights (k), means (k, d) and variances (k, d) of a label.
Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]


def seeds(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(label, seeds): up to k of each label's vectors(id, label, vec), each next one drawn by the squared distance to those before.

    A weighted draw is the least of -ln(u) / weight over all rows, with u from the
    md5 of seed, place and id, so it is an aggregation like any other and does not
    depend on how rows are dealt. Labels with fewer different vectors have fewer.
    """
    u = lambda i: -F.log(draws.uniform(F.lit(seed), F.lit(i), "id"))
    found = vectors.groupBy("label").agg(F.array(F.min_by("vec", F.struct(u(0), "id"))).alias("seeds"))
    for i in range(1, k):
        found = cut(found)
        apart = lambda s: F.aggregate(F.zip_with("vec", s, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
        near = vectors.join(found, "label").withColumn("d", F.array_min(F.transform("seeds", apart))).filter("d > 0")
        drawn = near.groupBy("label").agg(F.min_by("vec", F.struct(u(i) / F.col("d"), "id")).alias("next"))
        found = found.join(drawn, "label", "left").select("label", F.when(F.col("next").isNull(), F.col("seeds")).otherwise(F.concat("seeds", F.array("next"))).alias("seeds"))
    return found


def around(anchors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(label, seeds): the anchor vector of each label of anchors(label, vec), and k - 1 at a jitter around it."""
    others = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda c: F.transform("vec", lambda x, j: x + draws.normal(F.lit(seed), "label", c, j) * JITTER)) if k > 1 else F.array().cast("array<array<double>>")
    return anchors.select("label", F.concat(F.array("vec"), others).alias("seeds"))


def expect(x: np.ndarray, mixture: Mixture) -> tuple[np.ndarray, float]:
    """Sums (component, [n, values, squares]) weighed by the responsibilities of rows x, and their log-likelihood."""
    weight, mean, var = mixture
    log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
    top = log.max(1, keepdims=True)
    norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
    r = np.exp(log - norm[:, None])
    return r.T @ np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1), float(norm.sum())


def maximise(sums: np.ndarray) -> Mixture:
    d = (sums.shape[1] - 1) // 2
    n = sums[:, 0] + _EPS
    mean = sums[:, 1 : d + 1] / n[:, None]
    return sums[:, 0] / sums[:, 0].sum(), mean, np.maximum(sums[:, d + 1 :] / n[:, None] - mean**2, 0) + REGULARISE


def _sums(rows: DataFrame, mixtures: dict[str, Mixture], every: bool = False) -> dict[str, tuple[np.ndarray, float]]:
    """By label the sums of one expectation over all rows(label, vec) of the label, or over every row, and the log-likelihood."""
    shared = rows.sparkSession.sparkContext.broadcast(mixtures)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for f in frames:
            for label, part in [(label, f) for label in shared.value if len(f)] if every else f.groupby("label"):
                if label in shared.value:
                    sums, ll = expect(np.stack(part["vec"]).astype(float), shared.value[label])
                    held = total.setdefault(label, [0.0, 0.0])
                    held[0], held[1] = held[0] + sums, held[1] + ll
        for label, (sums, ll) in total.items():
            yield pd.DataFrame({"label": label, "component": range(len(sums)), "sums": list(np.concatenate([sums, np.full((len(sums), 1), ll)], axis=1))})

    parts = rows.select("label", "vec").mapInPandas(run, "label string, component int, sums array<double>")
    cells = parts.select("label", "component", F.posexplode("sums").alias("j", "x")).groupBy("label", "component", "j").agg(F.sum("x").alias("x"))
    out: dict[str, list] = {}
    for label, group in cells.toPandas().sort_values(["label", "component", "j"]).groupby("label", sort=False):
        table = group["x"].to_numpy().reshape(group["component"].nunique(), -1)
        out[label] = [table[:, :-1], float(table[0, -1])]
    return out


def fit(vectors: DataFrame, start: DataFrame, rounds: int = 200, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, every: bool = False) -> DataFrame:
    """MIXTURES of vectors(label, vec), one for each label of start(label, seeds), its components begun at the seeds.

    With every, no vector has a label, and each mixture is one of all vectors(vec):
    its start alone tells it apart. Rows are not copied for it.

    Variances begin at the label's own, weights alike. A label is done when its
    mean log-likelihood moves by less than the tolerance, or after `rounds` rounds;
    it then takes no part in later ones. A label has at most as many components as
    vectors. Labels of start without vectors are left out, as vectors of other
    labels are; null vectors and labels count for nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    start = start.select(F.col("label").cast("string").alias("label"), "seeds")
    label = F.lit("") if every else F.col("label").cast("string")
    rows = vectors.select(label.alias("label"), F.col("vec").cast("array<double>").alias("vec")).filter("label is not null and vec is not null")
    rows = cut(rows if every else rows.join(start.select("label"), "label", "left_semi"))
    # count, sums and squares of a label are 2 d + 1 numbers, those of a component too
    size = start.agg(F.sum(F.size("seeds") * F.size(F.get("seeds", F.lit(0))) * 24)).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / block_bytes))
    block = F.pmod(F.xxhash64("label"), F.lit(blocks))
    made: list[DataFrame] = []
    for b in range(blocks):
        part = rows if every else rows.filter(block == b)
        seeded = {r.label: np.array(r.seeds, float) for r in start.filter(block == b).collect()}
        one = {label: (np.ones(1), s[:1], np.ones_like(s[:1])) for label, s in seeded.items()}
        moments = {label: sums for label, (sums, _) in _sums(part, one, every).items()}
        count = {label: m[0, 0] for label, m in moments.items()}
        open_: dict[str, Mixture] = {}
        for label, m in moments.items():
            s = seeded[label][: int(round(count[label]))]
            open_[label] = np.full(len(s), 1 / len(s)), s, np.tile(maximise(m)[2], (len(s), 1))
        done: dict[str, Mixture] = {}
        last = dict.fromkeys(open_, -np.inf)
        for _ in range(rounds):
            if not open_:
                break
            for label, (sums, ll) in _sums(part, open_, every).items():
                mixture, ll = maximise(sums), ll / count[label]
                if abs(ll - last[label]) < tolerance:
                    done[label] = mixture
                    del open_[label]
                else:
                    open_[label], last[label] = mixture, ll
        done |= open_
        out = [(label, i, float(w[i]), m[i].tolist(), v[i].tolist()) for label, (w, m, v) in sorted(done.items()) for i in range(len(w))]
        made.append(cut(spark.createDataFrame(out, MIXTURES)) if blocks > 1 else spark.createDataFrame(out, MIXTURES))
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    return found


def fit_all(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 200) -> DataFrame:
    """MIXTURES of k components for each label of vectors(id, label, vec), seeded by squared distances."""
    rows = vectors.filter("label is not null and vec is not null")
    return fit(rows, seeds(rows.select("id", F.col("label").cast("string").alias("label"), F.col("vec").cast("array<double>").alias("vec")), k, seed), rounds)


def draw(mixtures: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(gold, draw, vec): n points of each label's mixture, by md5 alone.

    A point takes the first component whose summed weight reaches its share, and in
    each dimension the component's mean and a normal draw times its spread.
    """
    parts = mixtures.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("component", "weight", "mean", "var"))).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, c: a + c["weight"])
    reached = F.aggregate("c", F.array().cast("array<double>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + c["weight"])))
    points = parts.select("label", "c", reached.alias("reached"), total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    share = draws.uniform(F.lit(seed), "label", "draw") * F.col("total")
    which = F.coalesce(F.array_position(F.transform("reached", lambda r: r >= share), True).cast("int"), F.lit(0))
    chosen = points.select("label", "draw", F.element_at("c", F.when(which > 0, which).otherwise(F.size("c"))).alias("c"))
    vec = F.transform("c.mean", lambda m, j: m + F.sqrt(F.get("c.var", j)) * draws.normal(F.lit(seed), "label", "draw", j))
    return chosen.select(F.col("label").alias("gold"), "draw", vec.alias("vec"))


def sizes(mixtures: DataFrame) -> DataFrame:
    """(label, size): the summed variances of each label's components."""
    return mixtures.groupBy("label").agg(F.sum(F.aggregate("var", F.lit(0.0), lambda a, v: a + v)).alias("size"))


def hierarchy(mixtures: DataFrame, n: int = 1000, seed: int = 42, least: float = 0.5) -> DataFrame:
    """(child, parent, fraction): labels of whose mixture's draws at least that share lies in the parent's bubble.

    A point is in a bubble where it is likelier under its mixture than the median
    of that mixture's own draws. Where two labels include each other the larger
    bubble is the parent, by the summed variances of its components, and of equal
    ones each is.
    """
    scored = gmm.score_mixtures(draw(mixtures, n, seed), mixtures, ["gold", "draw"])
    return gmm.inclusion(scored, sizes(mixtures), least)
