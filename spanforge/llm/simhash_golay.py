"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded with zero bits to
the 23 bits of the perfect binary Golay code, whose 4,096 codewords lie within
three bits of every word. A segment's keys are the indices of the codewords
that it and each of its one-bit neighbours decode to: mostly one or six. If two
fingerprints differ in at most three bits, two of the three segments differ in
at most one bit each (3+0+0, 2+1+0 or 1+1+1), and a segment's own codeword is
among the keys of any segment one bit away. So a join of the own codewords of
two segments with the keys of the same two segments meets every pair within
radius; the exact distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import LOWER, SLICE_BYTES, Words, buffers, packed, slices
from .components import components

SEED = 42
RADIUS = 3
#: Bits of the three segments, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101  # of the binary Golay code
PAIRS = ((0, 1), (0, 2), (1, 2))
_BLOCK = 1 << 16


@cache
def decoder() -> np.ndarray:
    """Index of the nearest Golay codeword of each 23-bit word."""
    messages = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for i in range(12):
        code ^= np.where(messages >> i & 1, GENERATOR << i, 0)
    bits = 1 << np.arange(23, dtype=np.int64)
    one = bits
    two = np.array([a | b for i, a in enumerate(bits) for b in bits[:i]])
    three = np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]])
    table = np.zeros(1 << 23, np.int16)
    for error in np.concatenate([[0], one, two, three]):
        table[code ^ error] = messages
    return table


def _fingerprint(text: memoryview, starts: np.ndarray, ends: np.ndarray, width: int) -> int:
    """SimHash of one row's words, given in packed text."""
    n = len(starts)
    if not n:
        return 0
    k = max(1, n - width + 1)
    last = ends[min(width, n) - 1 :]
    sums = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, k, _BLOCK):  # bounded however long the text is
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : min(k, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist())], np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > k, bitorder="little").view(np.int64)[0])


def fingerprint_rows(column: pa.Array, width: int = 3) -> np.ndarray:
    """Fingerprints (as signed longs) of a string column."""
    data, offsets = buffers(column)
    words = Words(LOWER[data], offsets)
    text, starts, ends = packed(words)
    view = memoryview(text)
    f = words.first
    return np.array([_fingerprint(view, starts[a:b], ends[a:b], width) for a, b in zip(f[:-1], f[1:])], np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp): one for each row of docs. Null and empty texts have fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint_rows(b.column("text"), width))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segment_keys(fp: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own codeword of each fingerprint's segment; its keys, and how many of each row's columns count."""
    table = decoder()
    word = (fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
    keys = table[np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(bits))], axis=1)]
    own = keys[:, 0].copy()
    keys.sort(axis=1)
    fresh = np.concatenate([np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return own, keys, fresh


def golay_keys(fp: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(key, row) of the own codewords of segment pairs, and of all keys of segment pairs."""
    parts = [segment_keys(fp, *s) for s in SEGMENTS]
    own_key, own_row, all_key, all_row = [], [], [], []
    for p, (i, j) in enumerate(PAIRS):
        (own_i, key_i, new_i), (own_j, key_j, new_j) = parts[i], parts[j]
        own_key.append(own_i.astype(np.int64) << 12 | own_j | p << 24)
        own_row.append(np.arange(len(fp)))
        ri, ci = np.nonzero(new_i)
        n_j = new_j.sum(1)
        left = np.repeat(np.arange(len(ri)), n_j[ri])
        _, cj = np.nonzero(new_j)
        start_j = np.concatenate([[0], np.cumsum(n_j)])[:-1]
        step = np.arange(len(left)) - np.repeat(np.concatenate([[0], np.cumsum(n_j[ri])])[:-1], n_j[ri])
        row = ri[left]
        a, b = key_i[row, ci[left]].astype(np.int64), key_j[row, cj[start_j[row] + step]].astype(np.int64)
        all_key.append(a << 12 | b | p << 24)
        all_row.append(row)
    return (np.concatenate(own_key), np.concatenate(own_row)), (np.concatenate(all_key), np.concatenate(all_row))


def _keys(fps: DataFrame, own: bool, *carried: str) -> DataFrame:
    """Rows (key, fp, carried): the own codewords of each fingerprint's segment pairs, or all their keys; carried columns are longs."""
    columns = ["fp", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, row = golay_keys(np.asarray(part.column("fp")))[0 if own else 1]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(c).take(pa.array(row)) for c in columns)], ["key", *columns])

    return fps.select(columns).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in columns))


def _distance() -> F.Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All edges (a, b) between the distinct fingerprints of fps(fp) that differ in 1 to radius bits, RADIUS at most."""
    own = _keys(fps, True).select(F.col("key").alias("own"), F.col("fp").alias("b"))
    every = _keys(fps, False).select("key", F.col("fp").alias("a"))
    return every.join(own, (F.col("key") == F.col("own")) & (F.col("a") < F.col("b")) & (_distance() <= radius)).select("a", "b").distinct()


def stars(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For distinct fingerprints of fps(fp) the edge (a, b) to the nearest smaller one of those that stand for a key.

    The least fingerprint that owns a key stands for it, so there is an edge a
    fingerprint at most, however many share a key.
    """
    centres = _keys(fps, True).groupBy("key").agg(F.min("fp").alias("b")).withColumnRenamed("key", "own")
    every = _keys(fps, False).select("key", F.col("fp").alias("a"))
    met = every.join(centres, (F.col("key") == F.col("own")) & (F.col("a") > F.col("b")) & (_distance() <= radius))
    return met.groupBy("a").agg(F.min(F.struct(_distance().alias("d"), "b")).alias("m")).select("a", "m.b")


def bridges(named: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between components of named(fp, component) that hold fingerprints at most radius bits apart; none within a component."""
    own = _keys(named, True, "component").select(F.col("key").alias("own"), F.col("fp").alias("b"), F.col("component").alias("cb"))
    every = _keys(named, False, "component").select("key", F.col("fp").alias("a"), F.col("component").alias("ca"))
    return every.join(own, (F.col("key") == F.col("own")) & (F.col("ca") < F.col("cb")) & (_distance() <= radius)).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def grouped(fps: DataFrame) -> DataFrame:
    """(fp, component) of distinct fingerprints, over all links of at most RADIUS bits.

    Stars make forests of the dense groups first, an edge a fingerprint; after that
    only links between what they left apart are made, so a group of many near
    fingerprints never comes out as all its pairs.
    """

    def renamed(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        return rows.join(found.select(F.col("id").alias(name), F.col("component").alias("_to")), name, "left").withColumn("component", F.coalesce("_to", name)).drop("_to")

    named = cut(renamed(fps.select("fp"), components(stars(fps)), "fp"))
    return renamed(named, components(bridges(named)), "component")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs.

    component_id is the smallest doc_id reachable over links of at most RADIUS
    bits, the row's own included. Null and empty texts have fingerprint 0 and
    link like any other; rows with a null doc_id take part but never name a
    component (a component of only such rows has a null id); repeated rows stay
    repeated; very long texts are taken whole; other columns are ignored. An empty
    table gives an empty table.
    """
    fps = cut(fingerprints(docs, width))
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = cut(own.join(grouped(own), "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
