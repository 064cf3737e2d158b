"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its NEAREST nearest pivots in order. Two vectors are
candidates if they share enough of these and the places of the shared ones differ
little in sum (with NEAREST for each that is not shared). Among more pivots fewer
of the nearest agree, so what is enough depends on their number (AGREE).

1. Lists of ids. Vectors that share s pivots share two of the first
   NEAREST - s + 2 by number, so an inverted list is kept for each pair of pivots
   there. Lists hold ids and permutations; shared pivots are counted
   in them, and a pair belongs to the list of its two first shared pivots. Long
   lists are dealt in blocks, every block with every other, so no list gathers in
   one task and none is capped. Ids that meet a candidate stay.
2. Vectors are joined to what stayed, and the candidates there are verified by
   exact cosine. A list tells counts and a spanning forest, never all its pairs.

Equal vectors are one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import groups
from .components import components

LEAST_COSINE = 0.95
NEAREST = 8
#: (pivots, shared, moved): up to so many pivots so many of the nearest must be shared, at places that differ by so much in sum at most.
#: Measured: at a cosine of 0.95 exactly each finds 0.94 of the pairs or more, of 16 to 768 dimensions.
AGREE = ((64, 5, 40), (256, 4, 45), (1 << 30, 3, 50))
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
#: The bounded sample that pivots are chosen from.
SAMPLE_ROWS = 8192
#: Largest cosine of two pivots.
SEPARATION = 0.75
BLOCK = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        rows = rows / np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)
        return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each next one is the farthest of the sample from those chosen.

    None is closer to another than SEPARATION, far outside the linking radius,
    so pivots do not crowd into a large group and tell its members apart.
    """
    nearest = sample @ sample[0]
    picked = [0]
    while len(picked) < n and nearest[far := int(nearest.argmin())] < SEPARATION:
        picked.append(far)
        np.maximum(nearest, sample @ sample[far], out=nearest)
    return sample[picked]


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Ordered nearest pivots of unit vectors."""
    k = min(NEAREST, len(pivots))
    near = x @ pivots.T
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def agree(n_pivots: int) -> tuple[int, int]:
    """How many pivots two vectors must share, and how far these may move in sum."""
    return next((shared, moved) for most, shared, moved in AGREE if n_pivots <= most)


def list_keys(perms: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, row): the pairs among the first pivots by number of each permutation."""
    first = np.sort(perms, axis=1)[:, : NEAREST - agree(n_pivots)[0] + 2].astype(np.int64)
    pairs = list(combinations(range(first.shape[1]), 2)) or [(0, 0)]
    return np.concatenate([first[:, i] * n_pivots + first[:, j] for i, j in pairs]), np.tile(np.arange(len(perms)), len(pairs))


#: Pairs of rows that are looked at together.
PAIRS = 1 << 17
_APART = np.abs(np.arange(NEAREST)[:, None] - np.arange(NEAREST)[None, :])


def agreeing(key: np.ndarray, left: np.ndarray, right: np.ndarray, n_pivots: int) -> np.ndarray:
    """Which pairs of permutations are candidates and belong to the list key, that of their two first shared pivots."""
    k = left.shape[1]
    least, most_moved = agree(n_pivots)
    equal = left[:, :, None] == right[:, None, :]
    ours = equal.any(2)
    shared = ours.sum(1)
    moved = equal.reshape(len(left), k * k) @ _APART[:k, :k].ravel().astype(np.float32)
    first, second = (key // n_pivots)[:, None], (key % n_pivots)[:, None]
    before = (ours & (left < second) & (left != first)).any(1)
    return (shared >= min(least, k)) & ~before & (moved + (k - shared) * k <= most_moved)


Block = tuple[int, int, np.ndarray, np.ndarray]


def candidates(blocks: Iterable[Block], perms: np.ndarray, n_pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of rows of perms in blocks (key, start, left, right), PAIRS or so at a time over as many blocks; left and right count from start."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, i, j = (np.concatenate(h) for h in zip(*held))
        held.clear()
        good = agreeing(key, perms[i], perms[j], n_pivots)
        if good.any():
            yield i[good], j[good]

    for key, start, left, right in blocks:
        step = max(1, PAIRS // len(right))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            i, j = np.repeat(some, len(right)), np.tile(right, len(some))
            if left is right:
                once = i < j
                i, j = i[once], j[once]
            held.append((np.full(len(i), key, np.int64), start + i, start + j))
            size += len(i)
            if size >= PAIRS:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that it reaches by the links (i, j)."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        if (least[i] == low).all() and (least[j] == low).all():
            break
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
    return least


def _blocks(t: pa.Table) -> Iterator[Block]:
    """(key, start, left, right) of each pair of blocks in rows sorted by key, low and high."""
    key, low, high, part = (np.asarray(t.column(c)) for c in ("key", "low", "high", "part"))
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    for a, b in zip(new.tolist(), np.append(new[1:], len(key)).tolist()):
        every = np.arange(b - a)
        left = every if low[a] == high[a] else every[part[a:b] == low[a]]
        right = left if low[a] == high[a] else every[part[a:b] == high[a]]
        if b - a > 1 and len(left) and len(right):
            yield int(key[a]), a, left, right


def meetings(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (key, low, high, part, id): the ids in each pair of blocks of a list that are part of a candidate. vectors: id, vector."""
    n_pivots, size = len(pivots), pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                perms = permutations(unit(np.asarray(batch.column("vector").flatten()).reshape(-1, size)), shared.value)
                key, row = list_keys(perms, n_pivots)
                raw = pa.array([p.tobytes() for p in perms.astype("<i2")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(pa.array(row)), raw.take(pa.array(row))], ["key", "id", "perm"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "low", "high"]):
            perms = np.frombuffer(b"".join(t.column("perm").to_pylist()), "<i2").reshape(t.num_rows, -1)
            stay = np.zeros(t.num_rows, bool)
            for i, j in candidates(_blocks(t), perms, n_pivots):
                stay[i] = stay[j] = True
            yield from t.select(["key", "low", "high", "part", "id"]).filter(pa.array(stay)).to_batches()

    postings = vectors.select("id", "vector").mapInArrow(describe, "key long, id long, perm binary")
    many = postings.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    dealt = postings.join(many, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "perm")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(count, "key long, low int, high int, part int, id long")


def links(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, links, least): some of a vector's link weights, and a vector it reaches. vectors: id, weight, vector."""
    n_pivots, size = len(pivots), pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "low", "high"]):
            weight = np.asarray(t.column("weight"))
            x = unit(np.asarray(t.column("vector").combine_chunks().flatten()).reshape(-1, size))
            perms = permutations(x, shared.value)
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in candidates(_blocks(t), perms, n_pivots):
                near = np.concatenate([(x[i[at : at + BLOCK]] * x[j[at : at + BLOCK]]).sum(1) for at in range(0, len(i), BLOCK)]) >= LEAST_COSINE
                hits.append((i[near], j[near]))
            i, j = (np.concatenate(h) for h in zip(*hits))
            counts = (np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))).astype(np.int64)
            hit = np.flatnonzero(counts)
            ids = t.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.array(counts[hit]), ids.take(pa.array(lowest(len(x), i, j)[hit]))], ["id", "links", "least"])

    met = cut(meetings(vectors, pivots))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = met.join(vectors, "id").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cut(both.mapInArrow(verify, "id long, links long, least long"), met)


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of embeddings.

    n_links counts the other rows at a cosine of LEAST_COSINE or more that the
    index finds; component_id is the smallest vec_id reachable. Vectors that are
    null, empty or zero, or hold a null or non-finite component, or are not of
    the commonest length, link with nothing and are components of their own.
    Rows with a null vec_id take part; a component of only such rows has a null
    id and none of it is kept. Repeated rows link with each other. Other columns
    are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    length = rows.filter("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = length.n if length else 0
    finite = F.forall("vector", lambda v: F.coalesce((v == v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("vector", lambda v: v != 0)
    good = F.coalesce((F.size("vector") == size) & finite, F.lit(False)) if size > 0 else F.lit(False)
    node = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), "vector")), 16, "0") for s in (1, 2)])
    rows = rows.select("vec_id", F.when(good, F.col("vector")).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), node))
    distinct = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("vector").alias("vector"))
    reps = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    sample = [r.vector for r in reps.orderBy("node").limit(SAMPLE_ROWS).select("vector").collect()]
    if not sample:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    wanted = 1 << max(0, int(np.ceil(np.log2(np.sqrt(reps.count())))))
    pivots = choose_pivots(unit(np.array(sample)), min(max(wanted, LEAST_PIVOTS), MOST_PIVOTS))
    found = links(reps.select("id", "weight", "vector"), pivots)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("id", "node", "first", "weight").join(counts, "id", "left")
    named = cut(named.join(components(found.select(F.col("id").alias("a"), F.col("least").alias("b"))), "id", "left").withColumn("component", F.coalesce("component", "id")), reps, found)
    # written, so that a join with a large component can be split
    ids = cut(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = cut(named.join(ids, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"), named, ids)
    out = rows.select("vec_id", "node").join(named, "node", "left")
    linked = F.coalesce("links", F.lit(0).cast("long"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", linked.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
