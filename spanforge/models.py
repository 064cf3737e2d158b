"""Model boundaries: a detector finds mentions, an embedder makes vectors of them.

No neural weights come with the library. The stand-ins here are deterministic:
a gazetteer detector and hashed character n-grams. Any object with the same
methods takes their place; it is pickled to the executors and used once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.anchors import TEMPLATES
from .session import ship

DETECTIONS = "sent_id long, start_off int, end_off int, span string, cand_label string, score double"


class Detector(Protocol):
    def detect(self, texts: list[str], labels: list[str] | None) -> list[list[tuple[int, int, str | None, float]]]: ...


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Gazetteer:
    """Finds names of a list, longest first and without overlap; a label's names are its own only if labels are asked for."""

    def __init__(self, names: dict[str, str], score: float = 1.0):
        self.names, self.score = names, score

    def detect(self, texts, labels=None):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, label in self.names.items():
            if labels is None or label in labels:
                automaton.add_word(name, (name, label))
        if not len(automaton):
            return [[] for _ in texts]
        automaton.make_automaton()
        out = []
        for text in texts:
            found = sorted(((end + 1 - len(n), end + 1, label) for end, (n, label) in automaton.iter(text)), key=lambda s: (s[0], -s[1]))
            kept, free = [], 0
            for start, end, label in found:
                if start >= free:
                    kept.append((start, end, label, self.score))
                    free = end
            out.append(kept)
        return out


class WordPatterns:
    """Finds single words of a text by patterns, the first that matches from a word's start naming its label; words are parted by spaces."""

    def __init__(self, patterns: dict[str, str], score: float = 1.0):
        self.patterns, self.score = patterns, score

    def detect(self, texts, labels=None):
        import re

        known = [(label, re.compile(p)) for label, p in self.patterns.items() if labels is None or label in labels]
        out = []
        for text in texts:
            found, at = [], 0
            for word in text.split(" "):
                label = next((x for x, p in known if p.match(word)), None)
                if label:
                    found.append((at, at + len(word), label, self.score))
                at += len(word) + 1
            out.append(found)
        return out


#: Characters that are hashed, and that detections carry, at once.
_CHARS = 1 << 18


def _trigram_hashes(*points: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 of three code points each. Of bytes of one length it is the exclusive or of a part for each, so ASCII is looked up; other trigrams are hashed once each."""
    import zlib

    zero = zlib.crc32(bytes(3))
    parts = [np.array([zlib.crc32(bytes(b if k == j else 0 for k in range(3))) ^ zero for b in range(128)], np.int64) for j in range(3)]
    wide = np.flatnonzero((points[0] | points[1] | points[2]) > 127)
    out = np.full(len(points[0]), zero, np.int64)
    for part, p in zip(parts, points):
        out ^= part[p & 127]
    if len(wide):
        every, which = np.unique(points[0][wide] << 42 | points[1][wide] << 21 | points[2][wide], return_inverse=True)
        mask = (1 << 21) - 1
        out[wide] = np.array([zlib.crc32((chr(k >> 42) + chr(k >> 21 & mask) + chr(k & mask)).encode()) for k in every.tolist()], np.int64)[which]
    return out


class HashedNgrams:
    """Unit vectors of hashed character trigrams."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts):
        out = np.zeros((len(texts), self.dim))
        sizes = np.array([len(t) for t in texts], np.int64)
        part = np.cumsum(sizes) // _CHARS  # so many characters at once
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1) if len(texts) else []:
            padded = [f"  {texts[i].lower()} " for i in some]
            points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
            ends = np.cumsum([len(t) for t in padded])
            row = np.repeat(np.arange(len(some)), np.diff(ends, prepend=0))
            first = np.ones(len(points), bool)
            first[[*(ends - 1), *(ends - 2)]] = False
            at = np.flatnonzero(first)
            h = _trigram_hashes(points[at], points[at + 1], points[at + 2]) if len(at) else at
            sums = np.bincount(row[at] * self.dim + h % self.dim, np.where(h >> 16 & 1, 1.0, -1.0), len(some) * self.dim)
            out[some] = sums.reshape(len(some), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def detect(texts: DataFrame, detector: Detector, labels: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """DETECTIONS of texts(sent_id, text) of at least the threshold's score; null texts have none."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, s, e, t[s:e], label, float(score)) for i, t, found in zip(f["sent_id"], f["text"], detector.detect(f["text"].tolist(), labels)) for s, e, label, score in found if score >= threshold]
            yield pd.DataFrame(rows, columns=["sent_id", "start_off", "end_off", "span", "cand_label", "score"])

    return texts.select("sent_id", "text").filter("text is not null").mapInPandas(run, DETECTIONS)


def mentions(texts: DataFrame, detector: Detector, labels: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """detect's rows with the text that each is of, so texts are not met again; a place and label that a detector gives twice is one, of the greater score."""
    ship(texts.sparkSession)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["sent_id", "start_off", "end_off", "span", "cand_label", "score", "text"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, many = [], 0
            for i, t, found in zip(f["sent_id"], f["text"], detector.detect(f["text"].tolist(), labels)):
                best: dict[tuple, float] = {}
                for s, e, label, score in found:
                    if score >= threshold:
                        best[s, e, label] = max(float(score), best.get((s, e, label), float(score)))
                for (s, e, label), score in best.items():
                    rows.append((i, s, e, t[s:e], label, score, t))
                    many += len(t)
                    if many >= 4 * _CHARS:
                        yield frame(rows)
                        rows, many = [], 0
            yield frame(rows)

    return texts.select("sent_id", "text").filter("text is not null").mapInPandas(run, f"{DETECTIONS}, text string")


def embed(rows: DataFrame, embedder: Embedder, text: str, out: str = "vec") -> DataFrame:
    """rows with a unit vector of the text column."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(np.asarray(embedder.encode(part.fillna("").tolist()), dtype=float)), dtype=object)

    return rows.withColumn(out, encode(F.col(text)))


def prototypes(anchors: DataFrame, embedder: Embedder, mode: str = "context") -> DataFrame:
    """(label, vec) from anchors(label, words).

    raw averages the bare words, context the words in the mention's own form,
    ensemble the words in all templates; multi keeps a vector for each word.
    """
    from .operators.vectors import centroids

    words = anchors.select("label", F.explode("words").alias("word"))
    if mode == "raw":
        return centroids(embed(words, embedder, "word"))
    framed = words.withColumn("t", F.concat(F.lit("[ENT] "), F.col("word"), F.lit(" [/ENT]")))
    if mode == "context":
        return centroids(embed(framed, embedder, "t"))
    if mode == "multi":
        return embed(framed, embedder, "t").select("label", "vec")
    if mode == "ensemble":
        forms = words.withColumn("p", F.explode(F.array(*map(F.lit, TEMPLATES)))).withColumn("w", F.concat(F.lit("[ENT] "), F.col("word"), F.lit(" [/ENT]"))).withColumn("t", F.replace("p", F.lit("{a}"), F.col("w")))
        return centroids(embed(forms, embedder, "t"))
    raise ValueError(f"unknown mode {mode}")
