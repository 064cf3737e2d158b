"""Ranked lexical search with block-max pruning.

1. Documents are read once. Each range of BLOCK documents becomes a row of a
   forward index: for each document its length and the numbers and counts of the
   query terms it holds. N, L and the document frequencies are added up from it.
2. Each term has in each block a maximum of what it adds to a score, and the sum
   of these over an item's terms bounds the scores of the block.
3. Every task scores, for each item, its block with the highest bound. The 20th
   best of these scores, over all tasks, is a threshold that no result is below.
4. Every task takes an item's blocks by falling bound and scores them until the
   bound is below the threshold, or below the task's own 20th score. The best of
   all tasks are ranked.

Nothing is shuffled but at most k rows for each task and item. Items are taken in
blocks of a bounded number of terms, which is all that is broadcast; tasks hold
some blocks of documents at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, scratch, ship
from .arrays import buffers, give_back, slices
from .lexicon import Vocabulary, terms

K = 20
#: Documents of a block of the forward index, and blocks that a task looks at together.
BLOCK, TOGETHER = 128, 64
#: Terms of a block of items, repeats included, and of the items that a task bounds at once.
MOST_TERMS, TILE_TERMS = 200_000, 8_192
_INDEX = "docs long, words long, ids array<long>, lengths array<long>, counts array<int>, terms array<int>, tfs array<long>"
_RESULT = "item long, item_id long, doc_id long, score long"


def item_terms(benchmark: DataFrame) -> DataFrame:
    """Rows (item, item_id, term, n): how often each item's text holds each of its terms. item is unique to the row of benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            words = terms(data, offsets)
            view = memoryview(np.ascontiguousarray(words.data))
            found = [bytes(view[a:b]).decode() for a, b in zip(words.starts.tolist(), words.ends.tolist())]
            row = pa.array(words.row)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(row), batch.column("item_id").take(row), pa.array(found, pa.string())], ["item", "item_id", "term"])

    items = cut(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"))
    found = items.mapInArrow(run, "item long, item_id long, term string")
    return cut(found.groupBy("item", "item_id", "term").agg(F.count("*").alias("n")), items)


class Items:
    """A bounded block of items: their terms by number, grouped by item."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("item", "ascending"), ("term", "ascending")])
        term = table.column("term").combine_chunks().dictionary_encode()
        self.vocabulary = Vocabulary(term.dictionary.to_pylist())
        self.term, self.n = np.asarray(term.indices).astype(np.int64), np.asarray(table.column("n")).astype(np.int64)
        item = np.asarray(table.column("item"))
        self.first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        self.last = np.append(self.first[1:], len(item))
        self.item, self.item_id = item[self.first], table.column("item_id").take(pa.array(self.first)).combine_chunks()

    def __len__(self) -> int:
        return len(self.first)

    def tiles(self) -> Iterator[range]:
        at = 0
        while at < len(self):
            to = at + 1
            while to < len(self) and self.last[to] - self.first[at] <= TILE_TERMS:
                to += 1
            yield range(at, to)
            at = to


def forward_index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each range of documents: its documents and words, and for those with terms of the vocabulary which and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "text"):
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                words = terms(*buffers(batch.column("text")))
                place, term = shared.value.find(words)
                row = np.searchsorted(words.first, place, side="right") - 1
                key, tf = np.unique(row << 32 | term, return_counts=True)
                row, term = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
                holds, counts = np.unique(row, return_counts=True)
                ids = batch.column("doc_id").take(pa.array(holds))
                lists = [ids, pa.array(words.counts[holds]), pa.array(counts.astype(np.int32)), pa.array(term), pa.array(tf.astype(np.int64))]
                one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
                yield pa.RecordBatch.from_arrays([pa.array([int((words.counts > 0).sum())]), pa.array([int(words.counts.sum())]), *one], ["docs", "words", "ids", "lengths", "counts", "terms", "tfs"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


class Corpus:
    """What scores need of all documents: N, L and the terms' weights."""

    def __init__(self, n: int, total: int, frequency: np.ndarray):
        self.n, self.total = n, total
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)

    def parts(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * length * self.n) // max(self.total, 1)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def statistics(index: DataFrame, terms_known: int) -> Corpus:
    n, total = index.agg(F.sum("docs"), F.sum("words")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms_known, np.int64)
        for batch in batches:
            held += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=terms_known)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    found = index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(terms_known, np.int64)
    frequency[np.asarray(found.column("term"))] = np.asarray(found.column("n"))
    return Corpus(n or 0, total or 0, frequency)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): the places of all spans one after another, and whose they are."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


class Blocks:
    """Some blocks of the index, by term: what each term adds to its documents, and its maximum in each block."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        per_block = np.diff(np.asarray(batch.column("ids").offsets))
        self.ids = batch.column("ids").flatten()
        doc_block = np.repeat(np.arange(batch.num_rows), per_block)
        doc = np.repeat(np.arange(len(self.ids)), np.asarray(batch.column("counts").flatten()))
        term, tf = np.asarray(batch.column("terms").flatten()), np.asarray(batch.column("tfs").flatten())
        part = corpus.parts(term, tf, np.asarray(batch.column("lengths").flatten())[doc])
        order = np.argsort(term, kind="stable")  # documents stay in order, so blocks do
        term, self.doc, self.part = term[order], doc[order], part[order]
        block = doc_block[self.doc]
        self.start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.end = np.append(self.start[1:], len(term))[: len(self.start)]
        self.term, self.block = term[self.start], block[self.start]
        self.most = np.maximum.reduceat(self.part, self.start) if len(term) else self.start
        self.n = batch.num_rows
        self.doc_first = np.concatenate([[0], np.cumsum(per_block)])

    def bounds(self, items: Items, tile: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds by item of the tile and block, and (item, entry, repeats) of all their entries, by item."""
        a, b = items.first[tile.start], items.last[tile.stop - 1]
        term, n = items.term[a:b], items.n[a:b]
        owner = np.repeat(np.arange(len(tile)), items.last[tile.start : tile.stop] - items.first[tile.start : tile.stop])
        which, entry = ranges(np.searchsorted(self.term, term), np.searchsorted(self.term, term, side="right"))
        bound = np.zeros((len(tile), self.n), np.int64)
        np.add.at(bound, (owner[which], self.block[entry]), n[which] * self.most[entry])
        return bound, owner[which], entry, n[which]

    def score(self, block: int, entry: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) above 0 of one block."""
        a, b = self.doc_first[block], self.doc_first[block + 1]
        total = np.zeros(b - a, np.int64)
        which, place = ranges(self.start[entry], self.end[entry])
        np.add.at(total, self.doc[place] - a, repeats[which] * self.part[place])
        some = np.flatnonzero(total)
        return a + some, total[some]


def best(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best of hits (score, null, doc_id): highest score, then smallest doc_id, null last."""
    return hits[:, np.lexsort((hits[2], hits[1], -hits[0]))[:k]]


def search_block(blocks: Blocks, items: Items, tile: range, held: dict[int, np.ndarray], least: np.ndarray, k: int, most_blocks: int | None = None) -> None:
    """Adds to held, by item, the k best of the blocks whose bound reaches the threshold; most_blocks: of the best bounds only."""
    bound, owner, entry, repeats = blocks.bounds(items, tile)
    missing = np.asarray(blocks.ids.is_null())
    ids = np.asarray(blocks.ids.fill_null(0))
    edge = np.searchsorted(owner, np.arange(len(tile) + 1))
    for i, item in enumerate(tile):
        order = np.argsort(-bound[i], kind="stable")[:most_blocks]
        mine = slice(edge[i], edge[i + 1])
        at = blocks.block[entry[mine]]
        by_block = np.argsort(at, kind="stable")
        first = np.searchsorted(at[by_block], np.arange(blocks.n + 1))
        top = held.get(item, np.zeros((3, 0), np.int64))
        for b in order.tolist():
            floor = max(int(least[item]), int(top[0, -1]) if top.shape[1] == k else 1)
            if bound[i, b] < floor:
                break
            chosen = by_block[first[b] : first[b + 1]]
            doc, score = blocks.score(b, entry[mine][chosen], repeats[mine][chosen])
            good = score >= floor
            if good.any():
                doc, score = doc[good], score[good]
                top = best(np.concatenate([top, np.stack([score, missing[doc], ids[doc]])], axis=1), k)
        if top.shape[1]:
            held[item] = top


def _search(index: DataFrame, items: Items, corpus: Corpus, least: np.ndarray, k: int, most_blocks: int | None) -> DataFrame:
    """Rows (item, item_id, doc_id, score): of each task the k best of each item, or of its best blocks only."""
    shared = index.sparkSession.sparkContext.broadcast((items, corpus, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus, least = shared.value
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                blocks = Blocks(whole.slice(at, TOGETHER), corpus)
                for tile in items.tiles():
                    search_block(blocks, items, tile, held, least, k, most_blocks)
        give_back()
        if held:
            item = np.repeat(np.array(list(held)), [h.shape[1] for h in held.values()])
            score, missing, ids = np.concatenate(list(held.values()), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(items.item[item]), items.item_id.take(pa.array(item)), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return index.select("ids", "lengths", "counts", "terms", "tfs").mapInArrow(run, _RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each item of benchmark its k highest-scoring documents with a score above 0.

    Equal scores rank by ascending doc_id, null last. Null and empty texts have
    no terms: such items find nothing, and such documents are not counted. Texts
    of any length are taken whole. Each row is an item or a document of its own,
    so repeated rows rank as often as they are there, also under one id. Empty
    tables give no rows; other columns are ignored. Scores are exact in 64 bits
    while 25 * n * N of a document stays below 2**63.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = item_terms(benchmark)
    total = wanted.count()
    # dealt by hash, at a half of the bound on average; one item is never split
    rounds = max(1, math.ceil(2 * total / MOST_TERMS)) if total else 0
    wanted = wanted.withColumn("round", F.pmod(F.xxhash64("item"), F.lit(max(rounds, 1))))
    path = scratch(spark, "search")
    for r in range(rounds):
        table = wanted.filter(F.col("round") == r).drop("round").toArrow()
        if not table.num_rows:
            continue
        items = Items(table)
        index = cut(forward_index(docs, items.vocabulary))
        corpus = statistics(index, len(items.vocabulary.hashes))
        seen = _ranked(_search(index, items, corpus, np.ones(len(items), np.int64), k, 1), k).filter(F.col("rank") == k).select("item", "score").toArrow()
        least = np.ones(len(items), np.int64)
        least[np.searchsorted(items.item, np.asarray(seen.column("item")))] = np.asarray(seen.column("score"))
        _ranked(_search(index, items, corpus, least, k, None), k).write.mode("append").parquet(path)
    found = spark.read.schema(_RESULT + ", rank int").parquet(path) if rounds else spark.createDataFrame([], _RESULT + ", rank int")
    return found.select("item_id", "rank", "doc_id", "score")
