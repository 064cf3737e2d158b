"""Benchmark decontamination in DataFrame functions alone.

A document is contaminated by an item if some item-sized window of it has a
weighted similarity of 0.8 or more to the item: shared five-word shingles, each
weighing its number of occurrences, over all of either. Words are in lower case
and end at SEPARATORS, so punctuation is no part of them.

1. A window of w shingles so similar to an item of m shares at least
   4/9 (m + w) of them, so a document with fewer is out. w is m, or all of the
   document's shingles where it is shorter than the item. A join of all shingle
   hashes with the items' finds the rest, and where item shingles lie.
2. The windows to judge are those that hold so many item shingles, in whatever
   order: a sliding count over their places gives each of them once.
3. Windows and items get 64-bit SimHash fingerprints, cut into RADIUS + 1
   blocks. Fingerprints within RADIUS bits agree in some block, so a join on
   (item, block, value) loses none. At similarity 0.8 some 10 of 64 bits differ,
   with a deviation of 3, so RADIUS lies over four deviations off.
4. The shingles of what is left are counted and the similarity is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rows import KEY, keyed

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
#: What stands between words: ASCII but letters and digits, and the spaces and punctuation of three further blocks.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+"


def words(text: str) -> Column:
    return F.coalesce(F.array_remove(F.split(F.lower(F.col(text).cast("string")), SEPARATORS), ""), F.array().cast("array<string>"))


def _shingles(w: str, k: Column | int, hashed: bool) -> Column:
    """Every k consecutive words of array w, in order; none if there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    one = (lambda i: F.xxhash64(F.slice(w, i, k))) if hashed else (lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), one)).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of longs: a bit is set if it is in over half of them."""

    def bit(b: Column) -> Column:
        count = F.aggregate(hashes, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
        return (count * 2 > F.size(hashes)).cast("long")

    return F.aggregate(F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), bit), F.lit(0).cast("long"), lambda v, x: F.shiftleft(v, 1).bitwiseOR(x))


def blocks(fp: Column) -> Column:
    """RADIUS + 1 numbered blocks of a fingerprint, three bits and then two each."""
    three = 64 - 2 * (RADIUS + 1)
    cuts = [(3 * i, 3) for i in range(three)] + [(3 * three + 2 * i, 2) for i in range(RADIUS + 1 - three)]
    return F.array(*[F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) + (i << 3) for i, (at, n) in enumerate(cuts)])


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, iw, k, m): distinct items with their words, shingle width and number of shingles."""
    rows = benchmark.select(F.col("item_id").cast("long"), words("text").alias("iw")).filter(F.size("iw") > 0).distinct()
    width = F.least(F.size("iw"), F.lit(WIDTH))
    return rows.select(F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", width.alias("k"), (F.size("iw") - width + 1).alias("m"))


def _least(width: Column) -> Column:
    """Shingles that a window of `width` shingles must share with an item of m for SIMILARITY."""
    return F.ceil(SIMILARITY * (F.col("m") + width) / (1 + SIMILARITY) - 1e-9).cast("int")


def _windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, start): windows that may be similar enough. rows has KEY and array w."""
    # written, so that Spark knows its size and decides by it whether to broadcast
    codes = cut(items.select("item", F.col("k").alias("ck"), "m", F.explode(_shingles("iw", F.col("k"), True)).alias("h")).distinct())
    widths = codes.agg(F.collect_set("ck")).first()[0]
    found = None
    for k in sorted(widths):  # five, and the lengths of shorter items
        part = rows.select(KEY, (F.size("w") - k + 1).alias("d"), F.posexplode(_shingles("w", int(k), True)).alias("at", "h")).join(codes.filter(F.col("ck") == k), "h")
        part = part.select(KEY, "item", "m", "d", "at")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(KEY, F.lit(0).cast("long").alias("item"), F.lit(0).alias("start")).limit(0)
    width = F.least("m", "d")
    grouped = found.groupBy(KEY, "item", "m", "d").agg(F.sort_array(F.collect_list("at")).alias("p"))
    many = grouped.filter(F.size("p") >= _least(width)).select(KEY, "item", "p", "d", width.alias("width"), _least(width).alias("c"))

    def starts(i: Column) -> Column:
        """First and last start of the windows whose first shingle of the item is the i-th found and that hold c of them."""
        after = F.when(i > 0, F.get("p", i - 1) + 1).otherwise(0)
        return F.struct(F.greatest(after, F.get("p", i + F.col("c") - 1) - F.col("width") + 1).alias("a"), F.least(F.get("p", i), F.col("d") - F.col("width")).alias("b"))

    ranges = many.select(KEY, "item", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("c")), starts)).alias("r"))
    return ranges.filter("r.a <= r.b").select(KEY, "item", F.explode(F.sequence("r.a", "r.b")).alias("start"))


def matches(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, similarity, start, n_words) of the best window of each row of keyed docs for each item; of equal ones the first."""
    items = _items(benchmark)
    lengths = items.select("item", F.col("k").alias("wk"), F.size("iw").alias("length"))
    hashes = cut(items.select("item", _shingles("iw", F.col("k"), True).alias("h")))
    indexed = cut(hashes.select("item", fingerprint(F.col("h")).alias("ifp"))).select("item", "ifp", F.explode(blocks(F.col("ifp"))).alias("block"))
    places = cut(_windows(rows.select(KEY, words("text").alias("w")), items).join(lengths, "item"))
    # only texts with a place to judge are split again; Spark broadcasts their keys while they are few
    texts = rows.join(cut(places.select(KEY).distinct()), KEY).select(KEY, words("text").alias("w"))
    # a window that would run past the end moves back; a text shorter than the item is one window
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.size("w") - F.col("length")))
    windows = places.join(texts, KEY).select(KEY, "item", "wk", start.alias("start"), F.slice("w", start + 1, F.col("length")).alias("w")).distinct()
    # written, as the optimizer would compute the shingles anew for each bit and the fingerprint for each block
    hashed = cut(windows.withColumn("h", _shingles("w", F.col("wk"), True)))
    marked = cut(hashed.select(KEY, "item", "wk", "start", "w", fingerprint(F.col("h")).alias("fp")))
    probes = marked.select(KEY, "item", "wk", "start", "w", "fp", F.explode(blocks(F.col("fp"))).alias("block"))
    near = probes.join(indexed.select("item", "block", "ifp"), ["item", "block"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    near = near.select(KEY, "item", "wk", "start", "w").distinct()
    shared = near.select(KEY, "item", "start", F.size("w").alias("n"), F.explode(_shingles("w", F.col("wk"), False)).alias("s")).groupBy(KEY, "item", "start", "n", "s").agg(F.count("*").alias("c"))
    known = items.select("item", "item_id", "m", "k", F.explode(_shingles("iw", F.col("k"), False)).alias("s")).groupBy("item", "item_id", "m", "k", "s").agg(F.count("*").alias("ic"))
    scored = shared.join(known, ["item", "s"]).groupBy(KEY, "item", "item_id", "start", "n", "m", "k").agg(F.sum(F.least("c", "ic")).alias("both"))
    similarity = F.col("both") / (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("k") + 1) - F.col("both"))
    good = scored.withColumn("similarity", similarity).filter(F.col("similarity") >= SIMILARITY)
    best = good.groupBy(KEY, "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("n"))).alias("b"))
    return best.select(KEY, "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start, n_words): each contaminated document and item once.

    start and n_words give the best window in words, of equal ones the first.
    Null or empty texts of either table match nothing; items under five words
    are one shingle, all their words; null ids stay null; rows that share an id
    are judged one by one and the best is returned, so repeated rows change
    nothing; very long texts are judged whole; other columns are ignored. Without
    items or without documents there are no rows.
    """
    rows, key = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    found = matches(rows.select(F.col(key).alias(KEY), "text"), benchmark).join(rows.select(F.col(key).alias(KEY), "doc_id"), KEY)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("n_words"))).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).alias("start"), "b.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item contaminates.

    Each row is judged by itself, so repeated rows stay or go together; null and
    empty texts stay, very long texts are judged whole. Without items or without
    documents all rows stay. Other columns stay as they are, whatever their names.
    """
    rows, key = keyed(docs)
    # written, so that Spark sees how few they are
    gone = cut(matches(rows.select(F.col(key).alias(KEY), "text"), benchmark).select(F.col(KEY).alias(key)).distinct())
    return rows.join(gone, key, "left_anti").select(docs.columns)
