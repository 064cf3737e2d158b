"""Exact top-k search by inner product, by distributed histogram selection.

Every query is scored against every row, and no scores are kept. A pass makes a
histogram of each query's scores: tasks count scores in BINS bins of the query's
interval, the counts are added up, and the bin that holds the k-th score becomes
the interval of the next pass, until it is one value wide. Then the k-th score
is known exactly, with the number of scores above it. The last pass keeps scores
above it and, of the scores equal to it, those of the smallest ids.

A task's bins below its own k-th score are left out: the k-th score of all is
never lower. Queries are taken in blocks whose size is bounded by rows and by
bytes, so what is broadcast, and what the driver sees of a pass (k bins for each
query of the block), does not grow with the data; rows are read where they lie
and never shuffled. Passes depend on the range of the scores alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, scratch, ship

SCALE = 256
K = 5
BITS = 10
BINS = 1 << BITS
#: Largest block of queries.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Scores that a task makes at once.
TILE = 1 << 18
#: Inner products beyond this count as this.
MOST = 1 << 61
_NEVER = -(1 << 62)
_KTH = "q int, bin int, n long"
_HITS = "query_id long, query_row long, vec_id long, row long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """Rows (row, vec_id, x) of those that take part: x holds floor(SCALE * component), row is unique."""
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite)
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda v: F.floor(F.lit(float(SCALE)) * v).cast("long")).alias("x")))


class Block:
    """Some queries, by the length of their vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]):
        self.rows, self.ids = rows, ids
        lengths = np.array([len(v) for v in vectors])
        self.by_length = {int(n): (at := np.flatnonzero(lengths == n), np.stack([vectors[i] for i in at])) for n in np.unique(lengths)}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: in doubles where no sum can pass 2**53."""
    if a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


def scored(batches: Iterator[pa.RecordBatch], block: Block, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, ids, scores) tile by tile, for the queries that are active; a query's own row scores _NEVER."""
    for batch in batches:
        x = batch.column("x")
        offsets = np.asarray(x.offsets)
        values = np.asarray(x.values)
        row, ids = np.asarray(batch.column("row")), np.asarray(batch.column("vec_id"))
        lengths = np.diff(offsets)
        for n in np.unique(lengths).tolist():
            if n not in block.by_length:
                continue
            at, queries = block.by_length[n]
            chosen = np.flatnonzero(active[at])
            here = np.flatnonzero(lengths == n)
            vectors = values[offsets[here][:, None] + np.arange(n)]
            step = max(1, TILE // len(here))
            for i in range(0, len(chosen), step):
                part = chosen[i : i + step]
                s = products(queries[part], vectors)
                s[block.rows[at[part]][:, None] == row[here][None, :]] = _NEVER
                yield at[part], row[here], ids[here], s


def best(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best of each query of hits (query, score, id, row): highest score, then smallest id."""
    hits = hits[:, np.lexsort((hits[3], hits[2], -hits[1], hits[0]))]
    new = np.concatenate([[True], hits[0, 1:] != hits[0, :-1]])
    first = np.flatnonzero(new)
    return hits[:, np.arange(hits.shape[1]) - first[np.cumsum(new) - 1] < k]


def _histograms(rows: DataFrame, block: Block, low: np.ndarray, high: np.ndarray, shift: np.ndarray, active: np.ndarray, k: int) -> DataFrame:
    """Rows (q, bin, n): the uppermost bins of each query's interval from low up to high, as far down as its k-th score can be."""
    shared = rows.sparkSession.sparkContext.broadcast((block, low, high, shift, active))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high, shift, active = shared.value
        counts = np.zeros((len(low), BINS), np.int64)
        for q, _, _, s in scored(batches, block, active):
            i, j = np.nonzero((s >= low[q][:, None]) & (s < high[q][:, None]))
            bins = (s[i, j] - low[q][i]) >> shift[q][i]
            counts[q] += np.bincount(i * BINS + bins, minlength=len(q) * BINS).reshape(len(q), BINS)
        over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (over < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[q, at])], ["q", "bin", "n"])

    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    total = rows.select("row", "vec_id", "x").mapInArrow(count, _KTH).groupBy("q", "bin").agg(F.sum("n").alias("n"))
    return total.withColumn("over", F.sum("n").over(down) - F.col("n")).filter(F.col("over") < k)


def kth_scores(rows: DataFrame, block: Block, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query of the block its k-th highest score (_NEVER: fewer rows), and how many scores are above it. most: bounds of its scores."""
    n = len(block.rows)
    low, high, above = -most, most + 1, np.zeros(n, np.int64)
    shift = np.array([max(0, int(2 * m + 1).bit_length() - BITS) for m in most.tolist()], np.int64)
    active = np.ones(n, bool)
    while active.any():
        found = _histograms(rows, block, low, high, shift, active, k).toArrow()
        q, at, count, over = (np.asarray(found.column(c)).astype(np.int64) for c in ("q", "bin", "n", "over"))
        holds = (above[q] + over < k) & (above[q] + over + count >= k)
        missing = active.copy()
        missing[q[holds]] = False
        low[missing], above[missing], active[missing] = _NEVER, 0, False
        q, at, over = q[holds], at[holds], over[holds]
        low[q] += at << shift[q]
        high[q] = low[q] + (1 << shift[q])
        above[q] += over
        active[q] = shift[q] > 0
        shift[q] = np.maximum(0, shift[q] - BITS)
    return low, above


def _hits(rows: DataFrame, block: Block, kth: np.ndarray, k: int) -> DataFrame:
    """Scores above each query's k-th and, of those equal to it, k of each task with the smallest ids."""
    shared = rows.sparkSession.sparkContext.broadcast((block, kth))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kth = shared.value
        held = np.zeros((4, 0), np.int64)
        for q, row, ids, s in scored(batches, block, np.ones(len(kth), bool)):
            i, j = np.nonzero((s >= kth[q][:, None]) & (s != _NEVER))
            if len(i):
                held = best(np.concatenate([held, np.stack([q[i], s[i, j], ids[j], row[j]])], axis=1), k)
        q, s, ids, row = held
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (block.ids[q], block.rows[q], ids, row, s)], ["query_id", "query_row", "vec_id", "row", "score"])

    return rows.select("row", "vec_id", "x").mapInArrow(keep, _HITS)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest inner products of floor(SCALE * component), with all rows but its own.

    is_query is a condition on vec_id. All rows are returned where there are
    fewer than k; equal scores rank by the smaller vec_id. Rows take no part if
    their vector is null, empty, or holds a null or non-finite component, or if
    their vec_id is null. Vectors of unlike length have no inner product and do
    not meet. Rows with the same vec_id are rows of their own, as queries too.
    Inner products beyond 2**61 count as 2**61. An empty table gives no rows;
    other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = quantised(embeddings)
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    longest = rows.agg(F.max(size("x"))).first()[0] or 0.0
    asked = rows.filter(is_query)
    n, values = asked.agg(F.count("*"), F.sum(F.size("x"))).first()
    # dealt by hash, at a half of the bound on average
    blocks = int(np.ceil(max(2 * n / BLOCK_ROWS, 16 * (values or 0) / BLOCK_BYTES)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))))
    path = scratch(spark, "top-k")
    for b in range(blocks):
        t = asked.filter(F.col("block") == b).select("row", "vec_id", "x").toArrow()
        if not t.num_rows:
            continue
        vectors = [np.array(v, np.int64) for v in t.column("x").to_pylist()]
        block = Block(np.asarray(t.column("row")), np.asarray(t.column("vec_id")), vectors)
        bound = [min(MOST, int(np.linalg.norm(v.astype(float)) * longest * (1 + 1e-9)) + 1) for v in vectors]
        kth, _ = kth_scores(rows, block, np.array(bound, np.int64), k)
        _hits(rows, block, kth, k).write.mode("append").parquet(path)
    hits = spark.read.schema(_HITS).parquet(path) if n else spark.createDataFrame([], _HITS)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
