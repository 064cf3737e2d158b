"""Importance resampling towards a target: hashed word n-grams by an integer word dictionary.

Within a stretch of some text of a task, distinct words get ids, an n-gram is a
tuple of ids packed in one integer, and the bytes of each distinct tuple are put
together and hashed once; its bucket goes back to all its places. The dictionary
lives as long as the stretch: one for the whole corpus would need all words, or
all tuples, shuffled, and buckets are the same either way.

Documents are read twice, for the counts of the buckets and for the weights
under them, as buckets of all features would take as much room as the texts.
Between the two only bucket counts move: at most a number for each bucket and
task, and BUCKETS gains that are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import Words, buffers, give_back, octets, packed, same_bytes, slices, word_hash
from .lexicon import terms

ORDER = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
#: Words of a stretch; ids and their packed tuples fit 21 and 63 bits.
STRETCH = 1 << 17
_ID_BITS = 21
#: The reflected polynomial of CRC-32, a fixed value.
_POLYNOMIAL = 0xEDB88320


def _crc_tables() -> np.ndarray:
    """Table k: what a byte becomes after k more zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    out = [t]
    for _ in range(7):
        out.append(t[out[-1] & 0xFF] ^ out[-1] >> np.uint32(8))
    return np.stack(out)


_TABLES = _crc_tables()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for every span, eight bytes at a time."""
    eight = octets(data)
    at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)

    def step(some: np.ndarray | slice, n: int) -> None:
        word = eight[at[some]] ^ crc[some]
        new = crc[some] >> np.uint32(8 * n) if n < 4 else np.zeros(len(word), np.uint32)
        for i in range(n):
            new ^= _TABLES[n - 1 - i][(word >> np.uint64(8 * i) & np.uint64(0xFF)).astype(np.intp)]
        crc[some] = new
        at[some] += n

    some = np.flatnonzero(left >= 8)
    while len(some):
        step(some, 8)
        left[some] -= 8
        some = some[left[some] >= 8]
    for n in (4, 2, 1):
        if len(some := np.flatnonzero(left & n)):
            step(some, n)
    return crc ^ np.uint32(0xFFFFFFFF)


def dictionary(words: Words, a: int, b: int) -> np.ndarray:
    """An id below the number of words for each of the words a to b; equal words, and only these, share one."""
    starts, ends = words.starts[a:b], words.ends[a:b]
    _, first, ids = np.unique(word_hash(words.data, starts, ends), return_index=True, return_inverse=True)
    if not same_bytes(words.data, starts, ends, first[ids]).all():  # two words under one hash
        view = memoryview(np.ascontiguousarray(words.data))
        _, ids = np.unique(np.array([bytes(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], object), return_inverse=True)
    return ids.astype(np.int64)


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of 1 to ORDER words of a row, a stretch of words at a time."""
    text, text_starts, text_ends = packed(words)
    n_words = len(words.starts)
    row_end = words.first[1:]
    for a in range(0, n_words, STRETCH):
        b = min(a + STRETCH, n_words)
        ids = dictionary(words, a, min(b + ORDER - 1, n_words)) + 1
        at = np.arange(a, b)
        row = np.searchsorted(words.first, at, side="right") - 1
        room = row_end[row] - at
        tuples, first, last, rows = [], [], [], []
        packed_ids = np.zeros(b - a, np.int64)
        for n in range(ORDER):
            fits = np.flatnonzero(room > n)
            packed_ids[fits] |= ids[fits + n] << (_ID_BITS * n)
            tuples.append(packed_ids[fits])
            first.append(at[fits])
            last.append(at[fits] + n)
            rows.append(row[fits])
        _, one, back = np.unique(np.concatenate(tuples), return_index=True, return_inverse=True)
        first, last = np.concatenate(first)[one], np.concatenate(last)[one]
        buckets = crc32(text, text_starts[first], text_ends[last]) % np.uint32(BUCKETS)
        yield np.concatenate(rows), buckets.astype(np.int64)[back]


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """Rows (bucket, name): how many features of column text fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            for _, bucket in features(terms(*buffers(batch.column("text")))):
                counts += np.bincount(bucket, minlength=BUCKETS)
        give_back()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: how much likelier it is in target than in docs, in thousandths of a natural logarithm."""
    found = bucket_counts(docs, "s").join(bucket_counts(target, "t"), "bucket", "full_outer").toArrow()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(found.column("bucket"))
    s[at], t[at] = (np.asarray(found.column(c).fill_null(0)) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight), one for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = terms(*buffers(batch.column("text")))
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, bucket in features(words):
                n += np.bincount(row, minlength=len(n))
                np.add.at(weight, row, shared.value[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with rank, from 1 by falling score, by range partitions and their sizes: no task sees all of them."""
    places = cut(rows.sort(F.desc("score"), F.asc_nulls_last("doc_id"), "key").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = places.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_part = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return places.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + in_part + 1)


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each document; target and docs have a column text.

    Of the documents of LEAST_WORDS words or more PER_CENT in a hundred are drawn,
    rounded down: those of the highest scores, equal ones by the smaller doc_id, null
    last. rank is null for the others. The noise of a score comes from the doc_id
    alone (null: as if empty), so repeated rows score alike and each may be drawn.
    Null and empty texts have no features and weight 0. Texts of any length are
    taken whole. Empty docs give no rows; an empty target makes all gains those of
    no occurrence. Other columns are ignored.
    """
    ship(docs.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut(weigh(docs, gains(docs, target)).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("key", F.monotonically_increasing_id()))
    eligible = scored.filter(F.col("n_words") >= LEAST_WORDS)
    drawn = eligible.count() * PER_CENT // 100
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = _in_order(eligible).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < LEAST_WORDS).select(*out, F.lit(None).cast("long").alias("rank")))
