"""Runs over datasets that do not share their fate: every dataset ends in a status, and one that fails leaves the others alone."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import metrics
from .operators import align
from .session import cut

#: How a dataset can end.
FAILED_LOAD, NO_ROWS, FAILED_FIT, CRASHED, OK = "failed_load", "no_rows", "failed_fit", "crashed", "ok"
STATUS = "dataset string, status string, n_rows long, n_out long, seconds double, error string"


PLACE = ["sent_id", "start_off", "end_off"]


class Typer(Protocol):
    def predict(self, texts: DataFrame, labels: list[str]) -> DataFrame: ...


def score_spans(gold: DataFrame, typed: DataFrame) -> DataFrame:
    """One row of typed spans against gold(sent_id, start_off, end_off, label): n_gold, n_pred, n_matched, recall, ami, accuracy and macro_f1.

    Spans are matched by place; what only one side has is an error of its own kind,
    and of two labels in one place the greatest counts. recall is of places alone, 0
    without gold; the other measures are of all aligned places.
    """
    side = lambda d, name: d.select(*PLACE, F.lit(0).alias("ord"), F.col("label").alias(name))
    pairs = cut(align.align(side(gold, "gold"), side(typed, "pred"), PLACE))
    there = lambda c, missing: F.count_if(F.col(c) != missing)
    both = F.count_if((F.col("gold") != align.PREDICTED_NOT_GOLD) & (F.col("pred") != align.GOLD_NOT_PREDICTED))
    counts = pairs.agg(there("gold", align.PREDICTED_NOT_GOLD).alias("n_gold"), there("pred", align.GOLD_NOT_PREDICTED).alias("n_pred"), both.alias("n_matched"))
    recall = F.round(F.coalesce(F.try_divide("n_matched", "n_gold"), F.lit(0.0)), 6).alias("recall")
    return counts.select("*", recall).crossJoin(metrics.summary(pairs))


def zero_shot(texts: DataFrame, gold: DataFrame, typer: Typer) -> DataFrame:
    """score_spans of a typer that is told the gold labels' names and nothing else.

    Two passes: mentions of all texts are found and embedded, and written; then the
    prototypes are refined on all of them, and each is typed.
    """
    labels = sorted(r.label for r in gold.select("label").distinct().collect())
    return score_spans(gold, typer.predict(texts, labels))


def _said(error: Exception) -> str:
    text = str(error).strip()
    return f"{type(error).__name__}: {text.splitlines()[0] if text else ''}"


def run_all(
    spark: SparkSession,
    datasets: dict[str, Callable[[], DataFrame]],
    evaluate: Callable[[str, DataFrame], DataFrame],
    schema: str,
    fit: Callable[[str, DataFrame], object] | None = None,
    warm_up: Callable[[], object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(status, results): STATUS of every dataset, and the rows that evaluate made of those that ended well, with their dataset.

    A dataset is loaded, fitted if there is a fit, and evaluated; an error of a step
    is its status (failed_load, failed_fit, crashed) and what it said. n_rows and
    n_out are observed while the results are written, not counted by jobs of their
    own; results of a dataset that crashes are not kept. seconds is the time of the
    evaluation; warm_up runs before all of it and is not part of any.
    """
    if warm_up is not None:
        warm_up()
    rows, kept = [], spark.createDataFrame([], f"dataset string, {schema}")
    for name, load in datasets.items():
        try:
            data = load()
            empty = data.isEmpty()
        except Exception as error:
            rows.append((name, FAILED_LOAD, None, None, None, _said(error)))
            continue
        if empty:
            rows.append((name, NO_ROWS, 0, None, None, None))
            continue
        try:
            if fit is not None:
                fit(name, data)
        except Exception as error:
            rows.append((name, FAILED_FIT, None, None, None, _said(error)))
            continue
        began = time.perf_counter()
        read, made = Observation(f"read-{name}"), Observation(f"made-{name}")
        try:
            out = evaluate(name, data.observe(read, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n"))
            written = cut(out)
        except Exception as error:
            rows.append((name, CRASHED, None, None, time.perf_counter() - began, _said(error)))
            continue
        rows.append((name, OK, read.get["n"], made.get["n"], time.perf_counter() - began, None))
        kept = kept.unionByName(written.select(F.lit(name).alias("dataset"), "*"))
    return spark.createDataFrame(rows, STATUS), kept
