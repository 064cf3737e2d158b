"""Spans from the tag scores of a closed-set tagger: sub-words merged, tags chosen one by one or as the best allowed sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import spans


def bio_tags(labels: list[str]) -> list[str]:
    """O, and B- and I- of each label."""
    return ["O", *[f"{p}-{x}" for x in labels for p in "BI"]]


def allowed(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, step): which tags can begin a sentence, and which can follow which: I- only after B- or I- of its label."""
    inside = np.array([t.startswith("I-") for t in tags])
    step = np.array([[not t.startswith("I-") or p != "O" and p[2:] == t[2:] for t in tags] for p in tags])
    return ~inside, step


def best_sequence(scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The allowed sequence of tags of the largest sum of scores(word, tag); of equal ones the one whose last tag is first, and so on to the front."""
    if not len(scores):
        return np.zeros(0, np.int64)
    total = np.where(start, scores[0], -np.inf)
    back = np.zeros(scores.shape, np.int64)
    for i in range(1, len(scores)):
        came = np.where(step, total[:, None], -np.inf)
        back[i] = came.argmax(0)
        total = came.max(0) + scores[i]
    out = np.zeros(len(scores), np.int64)
    out[-1] = total.argmax()
    for i in range(len(scores) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def best_sequences(scores: np.ndarray, bounds: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """best_sequence of each sentence, scores[bounds[k] : bounds[k + 1]], one after another: the nth words of all are one step."""
    out = np.zeros(len(scores), np.int64)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    if not len(order):
        return out
    begin, sizes = bounds[order], sizes[order]
    many = [np.searchsorted(-sizes, -i, "left") for i in range(sizes[0])]  # sentences of more than i words
    total = np.where(start, scores[begin], -np.inf)
    back = np.zeros(scores.shape, np.int32)
    for i in range(1, sizes[0]):
        rows = begin[: many[i]] + i
        came = np.where(step, total[: many[i], :, None], -np.inf)
        back[rows] = came.argmax(1)
        total[: many[i]] = came.max(1) + scores[rows]
    tag = total.argmax(1)
    for i in range(sizes[0] - 1, -1, -1):
        rows = begin[: many[i]] + i
        out[rows] = tag[: many[i]]
        tag[: many[i]] = back[rows, tag[: many[i]]]
    return out


def mean_scores(pieces: Column) -> Column:
    """The scores of a word from the array of its pieces' scores: the mean of each."""
    added = F.aggregate(pieces, F.transform(F.get(pieces, F.lit(0)), lambda x: F.lit(0.0)), lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return F.transform(added, lambda x: x / F.size(pieces))


def merge_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, start_off, end_off, scores): words of sub-word pieces(keys, pos, start_off, end_off, scores), each score the mean over its pieces."""
    one = pieces.groupBy(*keys, "pos").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.collect_list("scores").alias("all"))
    return one.select(*keys, "pos", "start_off", "end_off", mean_scores(F.col("all")).alias("scores"))


def decode(words: DataFrame, keys: list[str], labels: list[str], constrained: bool = True) -> DataFrame:
    """decode_lines of words(keys, pos, start_off, end_off, scores), gathered by sentence."""
    one = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "start_off", "end_off", "scores"))).alias("w"))
    part = lambda c: F.transform("w", lambda x: x[c]).alias(c)
    return decode_lines(one.select(*keys, part("start_off").alias("starts"), part("end_off").alias("ends"), part("scores")), keys, labels, constrained)


def decode_lines(lines: DataFrame, keys: list[str], labels: list[str], constrained: bool = True) -> DataFrame:
    """(keys, start_off, end_off, label, score) of lines(keys, starts, ends, scores): arrays with an entry for each word, whose scores are one for each of bio_tags(labels).

    Constrained, a sentence takes the allowed sequence of the largest sum; otherwise
    each word its best tag, and an I- without its B- begins a span. score is the
    mean of the scores of the tags that the span's words took. A sentence is read as
    a whole by one task, and its spans are made where it lies.
    """
    ship(lines.sparkSession)
    tags = bio_tags(labels)
    start, step = allowed(tags)

    def sequence(flat: pa.Array) -> pa.Array:
        bounds = np.asarray(flat.offsets).astype(np.int64)
        scores = np.asarray(flat.values.slice(bounds[0], bounds[-1] - bounds[0])).reshape(-1, len(tags))
        bounds = (bounds - bounds[0]) // len(tags)
        taken = best_sequences(scores, bounds, start, step) if constrained else scores.argmax(1)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(taken, pa.int32()))

    taken = lines.withColumn("t", F.arrow_udf(sequence, "array<int>").asNondeterministic()(F.flatten("scores")))  # kept below what is made of it, as spans.starts is
    named = F.array(*map(F.lit, tags))
    made = taken.select(*keys, spans.line_spans("starts", "starts", F.transform("t", lambda t: F.get(named, t)), ends=F.col("ends")).alias("spans"), F.zip_with("scores", "t", lambda s, t: F.get(s, t)).alias("took"))
    rows = made.select(*keys, "took", F.explode_outer("spans").alias("s")).filter("s is not null")
    own = F.slice("took", F.col("s.first_pos") + 1, F.col("s.last_pos") - F.col("s.first_pos") + 1)
    return rows.select(*keys, "s.start_off", "s.end_off", "s.label", (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)).alias("score"))
