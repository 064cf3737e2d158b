"""Alignment of predicted with gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The two sentinels, one for each kind of error.
GOLD_NOT_PREDICTED, PREDICTED_NOT_GOLD = "__gold_not_predicted__", "__predicted_not_gold__"


def last_wins(spans: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """One label per place: that of the last span, of several last ones the greatest."""
    return spans.groupBy(*keys).agg(F.max(F.struct(order, label)).alias("last")).select(*keys, F.col(f"last.{label}").alias(label))


def align(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of gold(keys, ord, gold) and pred(keys, ord, pred); what is missing on one side gets its sentinel."""
    g, p = last_wins(gold, keys, "ord", "gold"), last_wins(pred, keys, "ord", "pred")
    joined = g.join(p, keys, "full_outer")
    return joined.select(*keys, F.coalesce("gold", F.lit(PREDICTED_NOT_GOLD)).alias("gold"), F.coalesce("pred", F.lit(GOLD_NOT_PREDICTED)).alias("pred"))


def detection_recall(gold: DataFrame, pred: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(threshold, n_gold, n_pred, n_matched, recall) over one pass of detections(keys, score), as of the least threshold."""
    spark = gold.sparkSession
    params = F.broadcast(spark.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    kept = pred.filter(F.col("score") >= min(thresholds)).crossJoin(params).filter("score >= threshold")
    n_pred = kept.groupBy("threshold").agg(F.count("*").alias("n_pred"))
    matched = kept.select("threshold", *keys).distinct().join(gold.select(*keys).distinct(), keys).groupBy("threshold").agg(F.count("*").alias("n_matched"))
    total = gold.agg(F.count("*").alias("n_gold"))
    out = params.crossJoin(total).join(n_pred, "threshold", "left").join(matched, "threshold", "left").na.fill(0, ["n_pred", "n_matched"])
    return out.withColumn("recall", F.round(F.coalesce(F.try_divide("n_matched", "n_gold"), F.lit(0.0)), 6))
