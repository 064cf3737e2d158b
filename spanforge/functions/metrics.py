"""Clustering and classification metrics over label pairs, grouped or not, in DataFrame expressions.

Pairs have columns gold and pred, and where they have a column weight a row
stands for so many pairs (cells() makes such a table, for several metrics of one
expensive set of pairs).
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

#: Label pairs that a resampled contingency table may have.
MOST_CELLS = 100_000
_SMALL = list(accumulate((math.log(n) for n in range(1, 17)), initial=0.0))


def log_factorial(n: Column) -> Column:
    """ln n!: exact sums below 17, Stirling's series (to 1e-13) from there."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    small = F.element_at(F.array(*map(F.lit, _SMALL)), F.least(n, F.lit(16)).cast("int") + 1)
    return F.when(n <= 16, small).otherwise(series)


def cells(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The contingency table as weighted pairs, written once."""
    return cut(pairs.groupBy(*(by or []), "gold", "pred").agg(_size(pairs).alias("weight")))


def _size(pairs: DataFrame) -> Column:
    return F.sum("weight") if "weight" in pairs.columns else F.count("*")


def _sides(pairs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    table = pairs.groupBy(*by, "gold", "pred").agg(_size(pairs).alias("n")).filter("n > 0")
    gold = table.groupBy(*by, "gold").agg(F.sum("n").alias("a"))
    pred = table.groupBy(*by, "pred").agg(F.sum("n").alias("b"))
    total = table.groupBy(*by).agg(F.sum("n").alias("total"))
    return table, gold, pred, total


def ami(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adjusted mutual information (arithmetic mean, natural log) of gold and pred, per group of `by`.

    Only the contingency table is shuffled; the expected information is a row for
    each distinct pair of marginals, which sums over counts within twelve deviations
    of the hypergeometric mean, so it grows with the root of the number of rows.
    """
    by = by or []
    table, gold, pred, total = _sides(pairs, by)
    on = (lambda left, right: left.join(right, by)) if by else (lambda left, right: left.crossJoin(F.broadcast(right)))
    n, a, b, t = F.col("n"), F.col("a"), F.col("b"), F.col("total")
    full = on(table.join(gold, [*by, "gold"]).join(pred, [*by, "pred"]), total)
    mi = full.groupBy(*by).agg(F.sum(n / t * F.log(n * t / (a.cast("double") * b))).alias("mi"))
    h = on(gold, total).groupBy(*by).agg((-F.sum(a / t * F.log(a / t))).alias("hg"), F.count("*").alias("kg"))
    k = on(pred, total).groupBy(*by).agg((-F.sum(b / t * F.log(b / t))).alias("hp"), F.count("*").alias("kp"))
    ca = gold.groupBy(*by, "a").agg(F.count("*").alias("na"))
    cb = pred.groupBy(*by, "b").agg(F.count("*").alias("nb"))
    grid = on(ca.join(cb, by) if by else ca.crossJoin(cb), total)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*by).schema.fields)
    ship(pairs.sparkSession)

    def expected(frames):
        for f in frames:
            parts = [expected_information(*(np.array([int(x)]) for x in r), int(n)) for *r, n in zip(f["a"], f["b"], f["na"], f["nb"], f["total"])]
            yield f[by].assign(part=np.array(parts, float))

    emi = grid.select(*by, "a", "b", "na", "nb", "total").mapInPandas(expected, f"{kinds}, part double" if by else "part double").groupBy(*by).agg(F.sum("part").alias("emi"))
    joined = mi.join(h, by).join(k, by).join(emi, by, "left") if by else mi.crossJoin(h).crossJoin(k).crossJoin(emi)
    top, under = F.col("mi") - F.coalesce("emi", F.lit(0.0)), (F.col("hg") + F.col("hp")) / 2 - F.coalesce("emi", F.lit(0.0))
    safe = F.when(F.abs(under) < 2.220446049250313e-16, F.lit(2.220446049250313e-16) * F.when(under < 0, -1).otherwise(1)).otherwise(under)
    value = F.when((F.col("kg") == F.col("kp")) & (F.col("kg") <= 1), F.lit(1.0)).otherwise(top / safe)
    return joined.select(*by, F.round(value, 6).alias("ami"))


def accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    weight = F.col("weight") if "weight" in pairs.columns else F.lit(1)
    right = F.sum(F.when(F.col("gold") == F.col("pred"), weight).otherwise(0))
    return pairs.groupBy(*(by or [])).agg(F.round(right / _size(pairs), 6).alias("accuracy"))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: ami, accuracy and macro_f1, from one contingency table."""
    table = cells(pairs)
    return ami(table).crossJoin(accuracy(table)).crossJoin(macro_f1(table))


def in_schema(pairs: DataFrame, declared: list[str], sentinel: str = "OOD") -> DataFrame:
    """One row: pairs, those whose gold label is declared, predictions of the sentinel, and accuracy over the declared ones alone.

    best is the likeliest label whatever its domain; both accuracies are null
    where no gold label is declared.
    """
    inside = F.col("gold").isin(declared)
    share = lambda c: F.round(F.avg(F.when(inside, (F.col("gold") == F.col(c)).cast("int"))), 6)
    return pairs.agg(F.count("*").alias("n_total"), F.count_if(inside).alias("n_in"), F.count_if(F.col("pred") == sentinel).alias("n_ood"), share("pred").alias("accuracy_in"), share("best").alias("accuracy_in_best"))


def unknown_recall(pairs: DataFrame, declared: list[str], sentinel: str = "OOD") -> DataFrame:
    """(gold, n, n_ood, recall) of each gold label that is not declared: the share of it that the sentinel was predicted for."""
    rows = pairs.filter(~F.col("gold").isin(declared)).groupBy("gold")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == sentinel).alias("n_ood"), F.round(F.avg((F.col("pred") == sentinel).cast("int")), 6).alias("recall"))


def open_confusion(pairs: DataFrame, declared: list[str], sentinel: str = "OOD") -> DataFrame:
    """(gold, pred, n) dense: every declared label and every other gold label, by every declared label and the sentinel."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("gold", "pred").agg(_size(pairs).alias("n"))
    rows = spark.createDataFrame([(x,) for x in declared], "gold string").union(counts.select("gold")).distinct()
    columns = F.broadcast(spark.createDataFrame([(x,) for x in [*declared, sentinel]], "pred string"))
    return rows.crossJoin(columns).join(counts, ["gold", "pred"], "left").na.fill(0, ["n"])


def open_report(typed: DataFrame, declared: list[str], sentinel: str = "OOD") -> DataFrame:
    """(section, name, metric, value): the whole evaluation of typed(gold, pred, best, ll) against the declared labels.

    Sections: total, label (each declared one: a prediction counts as false where
    the gold label is another declared one), unknown (recall of the sentinel on
    gold labels that are not declared), confusion (dense) and loglik (spread of ll
    by gold label). All but the last come from one table of (gold, pred, best).
    """
    table = cut(typed.groupBy("gold", "pred", "best").agg(F.count("*").alias("weight")))
    inside = F.col("gold").isin(declared)
    cell = lambda *c: F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in c])).alias("m")
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    labels = typed.sparkSession.createDataFrame([(x,) for x in declared], "name string")
    held = table.filter(inside)
    support = held.groupBy(F.col("gold").alias("name")).agg(F.sum("weight").alias("support"), count(F.col("gold") == F.col("pred")).alias("tp"))
    predicted = held.groupBy(F.col("pred").alias("name")).agg(F.sum("weight").alias("predicted"))
    each = cut(labels.join(support, "name", "left").join(predicted, "name", "left").na.fill(0))
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    f1 = ratio(2 * tp, F.col("support") + F.col("predicted"))
    by_label = each.select("name", cell(("support", F.col("support")), ("tp", tp), ("fp", fp), ("fn", fn), ("precision", ratio(tp, F.col("predicted"))), ("recall", ratio(tp, F.col("support"))), ("f1", f1)))
    sums = each.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("support").alias("s"), F.round(F.avg(f1), 6).alias("macro"))
    whole = table.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"), count(inside).alias("n_in"), count(inside & (F.col("gold") == F.col("pred"))).alias("right"), count(inside & (F.col("gold") == F.col("best"))).alias("right_best"), count(F.col("pred") == sentinel).alias("ood"))
    total = whole.crossJoin(sums).select(F.lit("all").alias("name"), cell(
        ("n_eval_spans", F.col("n")), ("n_in_schema_spans", F.col("n_in")), ("accuracy_in_schema", ratio(F.col("right"), F.col("n_in"))), ("accuracy_best_in_schema", ratio(F.col("right_best"), F.col("n_in"))), ("ood_rate", ratio(F.col("ood"), F.col("n"))),
        ("micro_precision", ratio(F.col("tp"), F.col("p"))), ("micro_recall", ratio(F.col("tp"), F.col("s"))), ("micro_f1", ratio(2 * F.col("tp"), F.col("p") + F.col("s"))), ("macro_f1", F.col("macro")),
    ))
    unknown = table.filter(~inside).groupBy(F.col("gold").alias("name")).agg(F.sum("weight").alias("n"), count(F.col("pred") == sentinel).alias("ood"))
    unknown = unknown.select("name", cell(("support", F.col("n")), ("n_detected_ood", F.col("ood")), ("recall", ratio(F.col("ood"), F.col("n")))))
    grid = open_confusion(table.select("gold", "pred", "weight"), declared, sentinel).select(F.col("gold").alias("name"), F.struct(F.col("pred").alias("metric"), F.col("n").cast("double").alias("value")).alias("m"))
    p = F.percentile("ll", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    spread = typed.groupBy(F.col("gold").alias("name")).agg(F.min("ll").alias("lo"), p.alias("p"), F.max("ll").alias("hi"))
    spread = spread.select("name", cell(*[(n, F.round(v, 4)) for n, v in (("min", F.col("lo")), ("p05", F.col("p")[0]), ("median", F.col("p")[1]), ("p95", F.col("p")[2]), ("max", F.col("hi")))]))
    parts = [part.select(F.lit(section).alias("section"), "name", "m.metric", "m.value") for section, part in (("total", total), ("label", by_label), ("unknown", unknown), ("confusion", grid), ("loglik", spread))]
    return reduce(DataFrame.unionByName, parts)


def diagnosis(pairs: DataFrame, k: int = 3) -> DataFrame:
    """per_label with class_bias's counts and the k labels that each is mostly taken for, as 'label:count' in order."""
    table = cells(pairs)
    wrong = table.filter("gold <> pred").withColumn("r", F.row_number().over(Window.partitionBy("gold").orderBy(F.desc("weight"), "pred"))).filter(F.col("r") <= k)
    taken = wrong.groupBy(F.col("gold").alias("label")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "pred", "weight").alias("t")))), lambda x: x["t"]), " ").alias("taken_for"))
    every = Window.partitionBy()
    out = per_label(table).join(taken, "label", "left").na.fill("", ["taken_for"])
    bias = F.when((F.col("support") == 0) & (F.col("predicted") > 0), F.lit(float("inf"))).otherwise(F.round(F.coalesce(F.try_divide("predicted", "support"), F.lit(0.0)), 6))
    share = lambda c: F.round(F.col(c) / F.sum("support").over(every), 6)
    return out.withColumn("bias", bias).withColumn("gold_share", share("support")).withColumn("pred_share", share("predicted"))


def _bounded_cells(pairs: DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The contingency table in order and its counts; one of more than MOST_CELLS is refused."""
    table = cells(pairs).orderBy("gold", "pred").limit(MOST_CELLS + 1).toPandas()
    if len(table) > MOST_CELLS:
        raise ValueError("too many label pairs to resample")
    return table, table["weight"].to_numpy(np.int64)


def _drawn(counts: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    return np.random.default_rng([seed, replicate]).multinomial(counts.sum(), counts / counts.sum())


def resamples(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, gold, pred, weight): the contingency tables of so many resamples with replacement.

    Drawing n rows of n with replacement is one multinomial draw over the cells
    of the table, so no row is copied and the work grows with the cells. The table
    is a row for each pair of labels; a larger one than MOST_CELLS is refused.
    """
    ship(pairs.sparkSession)
    table, counts = _bounded_cells(pairs)

    def draw(batches):
        for frame in batches:
            for i in frame["replicate"]:
                yield pd.DataFrame({"replicate": i, "gold": table["gold"], "pred": table["pred"], "weight": _drawn(counts, seed, int(i))})

    some = pairs.sparkSession.range(replicates if len(table) else 0).withColumnRenamed("id", "replicate")
    return some.mapInPandas(draw, "replicate long, gold string, pred string, weight long").filter("weight > 0")


def expected_information(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, total: int) -> float:
    """Expected mutual information of marginals a and b, na and nb times each, of `total` pairs.

    A count's probability follows from the one before it by the hypergeometric
    ratio, over twelve deviations around the mean, and all are scaled to sum to one.
    """
    out = 0.0
    for x, many in zip(a.tolist(), na.tolist()):
        for y, more in zip(b.tolist(), nb.tolist()):
            mean = x * y / total
            spread = 12 * math.sqrt(mean * (total - x) / total * (total - y) / max(total - 1, 1)) + 30
            n = np.arange(max(0, x + y - total, math.floor(mean - spread)), min(x, y, math.ceil(mean + spread)) + 1, dtype=float)
            step = np.log((x - n[:-1]) * (y - n[:-1]) / ((n[:-1] + 1) * (total - x - y + n[:-1] + 1)))
            log = np.concatenate([[0.0], np.cumsum(step)])
            p = np.exp(log - log.max())
            some = n > 0
            out += many * more * float((n[some] / total * np.log(n[some] * total / (float(x) * y)) * p[some]).sum() / p.sum())
    return out


def scores_of_cells(gold: np.ndarray, pred: np.ndarray, weight: np.ndarray, labels: int) -> tuple[float, float]:
    """Adjusted mutual information and macro F1 of a contingency table of label numbers, as ami and macro_f1 give them."""
    some = weight > 0
    gold, pred, n = gold[some], pred[some], weight[some].astype(float)
    a, b = np.bincount(gold, n, labels), np.bincount(pred, n, labels)
    total = n.sum()
    seen = (a + b) > 0
    f1 = float((2 * np.bincount(gold[gold == pred], n[gold == pred], labels)[seen] / (a + b)[seen]).mean())
    a, b = a[a > 0], b[b > 0]
    if len(a) == len(b) == 1:
        return 1.0, f1
    information = float((n / total * np.log(n * total / (np.bincount(gold, n, labels)[gold] * np.bincount(pred, n, labels)[pred]))).sum())
    entropy = [float(-(m / total * np.log(m / total)).sum()) for m in (a, b)]
    expected = expected_information(*(np.unique(m.astype(np.int64), return_counts=True)[i] for i in (0, 1) for m in (a, b)), int(total))
    under = sum(entropy) / 2 - expected
    least = np.finfo(float).eps
    return (information - expected) / (under if abs(under) >= least else math.copysign(least, under)), f1


def resampled_scores(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, ami, macro_f1) of the tables that resamples draws, scored in the task that draws them: no table leaves it."""
    ship(pairs.sparkSession)
    table, counts = _bounded_cells(pairs)
    names, numbers = np.unique(np.concatenate([table["gold"].to_numpy(str), table["pred"].to_numpy(str)]), return_inverse=True)
    gold, pred = numbers[: len(table)], numbers[len(table) :]

    def score(batches):
        for frame in batches:
            rows = [(int(i), *scores_of_cells(gold, pred, _drawn(counts, seed, int(i)), len(names))) for i in frame["replicate"]]
            yield pd.DataFrame(rows, columns=["replicate", "ami", "macro_f1"])

    some = pairs.sparkSession.range(replicates if len(table) else 0).withColumnRenamed("id", "replicate")
    return some.mapInPandas(score, "replicate long, ami double, macro_f1 double")


def bootstrap(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(metric, mean, std, low, high) of ami and macro_f1 over resamples; low and high are the 2.5 and 97.5 percentiles."""
    each = resampled_scores(pairs, replicates, seed)
    rows = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("ami", "macro_f1")])).alias("m")).select("m.*")
    p = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    out = rows.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), p.alias("p"))
    return out.select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


def per_label(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """support, predicted, tp, fp, fn, precision, recall, f1 over the union of labels; divisions by zero give 0."""
    by = by or []
    table, gold, pred, _ = _sides(pairs, by)
    tp = table.filter("gold = pred").select(*by, F.col("gold").alias("label"), F.col("n").alias("tp"))
    out = gold.select(*by, F.col("gold").alias("label"), F.col("a").alias("support")).join(pred.select(*by, F.col("pred").alias("label"), F.col("b").alias("predicted")), [*by, "label"], "full_outer")
    out = out.join(tp, [*by, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return out.select(
        *by, "label", "support", "predicted", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def macro_f1(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over all labels of either side, sentinels among them."""
    by = by or []
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_label(pairs, by).groupBy(*by).agg(F.round(F.avg(f1), 6).alias("macro_f1"))


def micro_prf(pairs: DataFrame, schema_labels: list[str]) -> DataFrame:
    """Micro precision, recall and F1, and macro F1 over the declared labels alone."""
    rows = per_label(pairs).filter(F.col("label").isin(schema_labels))
    s = rows.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("support").alias("s"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return s.select(ratio(F.col("tp"), F.col("p")).alias("micro_p"), ratio(F.col("tp"), F.col("s")).alias("micro_r"), ratio(2 * F.col("tp"), F.col("p") + F.col("s")).alias("micro_f1"), "macro_f1")


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Dense confusion matrix, a column per predicted label."""
    spark = pairs.sparkSession
    wide = pairs.groupBy("gold").pivot("pred", labels).count().na.fill(0)
    return spark.createDataFrame([(x,) for x in labels], "gold string").join(wide, "gold", "left").na.fill(0)


def class_bias(pairs: DataFrame) -> DataFrame:
    """Predicted over gold counts per label (infinite without gold), and either side's share."""
    _, gold, pred, _ = _sides(pairs, [])
    out = gold.select(F.col("gold").alias("label"), F.col("a").alias("n_gold")).join(pred.select(F.col("pred").alias("label"), F.col("b").alias("n_pred")), "label", "full_outer").na.fill(0, ["n_gold", "n_pred"])
    every = Window.partitionBy()
    bias = F.when(F.col("n_gold") == 0, F.lit(float("inf"))).otherwise(F.round(F.col("n_pred") / F.col("n_gold"), 6))
    return out.select("label", "n_gold", "n_pred", bias.alias("bias"), F.round(F.col("n_gold") / F.sum("n_gold").over(every), 6).alias("gold_share"))


def top_confusions(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.filter("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(k)


def top_misdirections(pairs: DataFrame, k: int = 3) -> DataFrame:
    counts = pairs.filter("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n"))
    order = Window.partitionBy("gold").orderBy(F.desc("n"), "pred")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def latency(samples: DataFrame, by: list[str], ms: str) -> DataFrame:
    """count, p50, p95, p99 (linear interpolation), total seconds and items per second."""
    p = F.percentile(F.col(ms), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.groupBy(*by).agg(F.count(ms).alias("n"), p.alias("p"), F.sum(ms).alias("total"))
    pick = lambda i: F.round(F.coalesce(F.element_at("p", i), F.lit(0.0)), 6)
    return out.select(*by, "n", pick(1).alias("p50_ms"), pick(2).alias("p95_ms"), pick(3).alias("p99_ms"), F.round(F.col("total") / 1000, 6).alias("total_s"), F.round(F.try_divide(F.col("n") * 1000.0, F.col("total")), 6).alias("per_s"))


def energy(runs: DataFrame, factors: DataFrame, watts: float) -> DataFrame:
    """kWh = W s / 3.6e6 and grams of CO2 by the country's grid factor, the world's where unknown. runs: country, seconds."""
    world = factors.filter("country = 'WORLD'").select(F.col("factor").alias("world"))
    joined = runs.join(F.broadcast(factors), "country", "left").crossJoin(F.broadcast(world))
    kwh = F.col("seconds") * watts / 3.6e6
    return joined.select(*runs.columns, F.round(kwh, 9).alias("kwh"), F.round(kwh * F.coalesce("factor", "world"), 9).alias("grams"))
