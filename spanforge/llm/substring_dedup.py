"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words of one document. A word goes if a window
that covers it has the same words as a window that starts earlier (smaller
document, or the same document and an earlier start).

1. Phrases. Of the 8-word phrases in a window the one with the least hash is
   the window's anchor, so equal windows have equal anchors. One pass gives each
   document's anchors; those met only once in the corpus cannot be in a
   repeated window and end here. Documents whose whole word sequence equals an
   earlier one's (by SHA-256) are wholly repeated and settled by that alone.
2. Segments. Runs of windows with a recurring anchor go, as text, to the shard
   of that anchor. Equal segments of a batch are combined before the shuffle:
   all but the first are repeats. Anchors met very often are dealt out by
   window instead, so no anchor gathers in one shard.
3. Automata. Each shard, in chunks of whole anchors, confirms which windows
   recur in exact words, compiles them to an Aho-Corasick automaton over word
   numbers and streams all its segments through it; every occurrence but the
   first marks its words.
4. The marks of a document are joined to it and its marked words removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import U, Words, buffers, digests, give_back, packed, slices, span_hash
from .rows import KEY, keyed

WINDOW = 20
GRAM = 8
#: Anchors met more often than this are dealt out by window.
HOT = 1000
#: Text of the segments that one automaton is compiled from.
CHUNK_BYTES = 1 << 19
_NONE = U(0)


def _sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """op over each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor hash of the window at each word (0 where no window starts), the words where an anchor phrase starts, and its hash."""
    n = len(words.starts)
    least = np.zeros(n, U)
    if n < window:
        return least, np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - gram + 1)
    grams = span_hash(words.hashes(), at, at + gram) | U(1)
    of = window - gram + 1
    low = _sliding(grams, of, np.minimum)
    ends = np.repeat(words.first[1:], words.counts)
    starts = np.arange(n - window + 1)
    fits = starts + window <= ends[: len(starts)]
    least[: len(starts)] = np.where(fits, low, _NONE)
    high = _sliding(np.concatenate([np.zeros(of - 1, U), least]), of, np.maximum)
    where = np.flatnonzero(high[: len(grams)] == grams)
    return least, where, grams[where]


def _profile(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = Words(*buffers(b.column("text")))
            _, where, value = anchors(words, window, gram)
            row = np.searchsorted(words.first, where, side="right") - 1
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            same = np.zeros(len(row), bool)  # a phrase counts twice at most in a document
            same[2:] = (row[2:] == row[:-2]) & (value[2:] == value[:-2])
            row, value = row[~same], value[~same]
            offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(KEY), pa.array(words.counts), pa.array(digests(words), pa.binary()), lists], ["k", "n", "s", "grams"])

    return run


def _segments(window: int, gram: int):
    """(shard, k, start, stop, text): segments to compare, or words already known as repeats (text null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            keys = np.asarray(b.column(KEY))
            words = Words(*buffers(b.column("text")))
            least, _, _ = anchors(words, window, gram)
            wanted, hot = (np.unique(np.asarray(b.column(c).flatten(), dtype=np.int64)).view(U) for c in ("often", "hot"))
            if not len(wanted) + len(hot):
                continue
            every = np.unique(np.concatenate([wanted, hot]))
            at = np.flatnonzero((least != _NONE) & np.isin(least, every))
            if not len(at):
                continue
            value, is_hot = least[at], np.isin(least[at], hot)
            row = np.searchsorted(words.first, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = is_hot[1:] | (value[1:] != value[:-1]) | (np.diff(at) != 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            shard = value[first].copy()
            h = np.flatnonzero(is_hot[first])
            shard[h] = span_hash(words.hashes(1), at[first[h]], at[first[h]] + window, 1)
            text, starts, ends = packed(words)
            text = text.tobytes()
            lo, hi = starts[at[first]].tolist(), ends[at[last] + window - 1].tolist()
            key = keys[row[first]]
            start = at[first] - words.first[row[first]]
            stop = at[last] + window - words.first[row[first]]
            body: list = [text[x:y] for x, y in zip(lo, hi)]
            order = np.lexsort((start, key))
            seen: dict = {}
            for i in order.tolist():
                if seen.setdefault(body[i], i) != i:
                    body[i] = None
            shard = shard.view(np.int64)
            alone = np.array([x is None for x in body])
            shard[alone] = (key[alone] * np.int64(31) + start[alone]) if alone.any() else shard[alone]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key), pa.array(start), pa.array(stop), pa.array(body, pa.binary())], ["shard", "k", "start", "stop", "text"])

    return run


def _merged(starts: list[int], width: int) -> Iterator[tuple[int, int]]:
    """Word ranges that windows at these ascending starts cover."""
    begin = end = None
    for s in starts:
        if begin is None:
            begin = s
        elif s > end:
            yield begin, end
            begin = s
        end = s + width
    if begin is not None:
        yield begin, end


def repeats(segments: list[tuple[int, int, bytes]], window: int) -> Iterator[tuple[int, int, int]]:
    """(k, start, stop) of the repeated words in segments (k, start, text) that stand in order of (k, start)."""
    number: dict[bytes, int] = {}
    streams = [tuple([number.setdefault(w, len(number)) for w in t.split(b" ")]) for _, _, t in segments]
    first: dict[tuple, tuple[int, int] | None] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for (k, start, _), ids in zip(segments, streams):
        for i in range(len(ids) - window + 1):
            phrase = ids[i : i + window]
            if phrase not in first:
                first[phrase] = (k, start + i)
            elif first[phrase]:  # met again: the phrase is confirmed
                automaton.add_word(phrase, first[phrase])
                first[phrase] = None
    if not len(automaton):
        return
    del first
    automaton.make_automaton()
    for (k, start, _), ids in zip(segments, streams):
        found = [at for end, origin in automaton.iter(ids) if origin != (k, at := start + end - window + 1)]
        for a, b in _merged(found, window):
            yield k, a, b


def _shards(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        chunk: list[tuple[int, int, bytes]] = []
        size, shard, seen = 0, None, set()

        def flush() -> pa.RecordBatch:
            out.extend(repeats(chunk, window))
            chunk.clear()
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["k", "start", "stop"])

        for batch in batches:
            for s, k, start, stop, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if text is None:
                    out.append((k, start, stop))
                    continue
                if s != shard:
                    shard = s
                    seen.clear()
                    if size > CHUNK_BYTES:
                        yield flush()
                        size = 0
                if text in seen:  # rows come in order, so the first of equal segments is the earliest
                    out.append((k, start, stop))
                    continue
                seen.add(text)
                chunk.append((k, start, text))
                size += len(text)
        yield flush()
        give_back()

    return run


def _without(fields: list[str]):
    """Rows with their marked words removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = Words(*buffers(b.column("text")))
            marks = b.column("marks")
            flat = marks.flatten()
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(marks), 0)))])
            change = np.zeros(len(words.starts) + 1, np.int64)
            if len(flat):
                base = np.repeat(words.first[:-1], np.diff(bounds))
                np.add.at(change, base + np.asarray(flat.field("start")), 1)
                np.add.at(change, base + np.asarray(flat.field("stop")), -1)
            kept = np.cumsum(change[:-1]) == 0
            removed = words.counts - np.diff(np.concatenate([[0], np.cumsum(kept)])[words.first])
            words.starts, words.ends = words.starts[kept], words.ends[kept]
            first = np.concatenate([[0], np.cumsum(words.counts - removed)])
            text, starts, _ = packed(words)
            edge = np.append(starts, len(text))[first]
            raw = text.tobytes()
            texts = pa.array([raw[x : max(x, y - 1)].decode() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), texts, pa.array(words.counts), pa.array(removed)], [*fields, "text", "n_words", "n_removed"])

    return run


def marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (k, marks), written: the repeated word ranges of each row of docs (KEY, text) that has some."""
    gram = min(gram, window)
    profile = cut(docs.mapInArrow(_profile(window, gram), "k long, n long, s binary, grams array<long>").filter(F.col("n") >= window))
    # written, so that a join with a large group of copies can be split
    whole = cut(profile.groupBy("s").agg(F.min("k").alias("least"), F.count("*").alias("c")).filter("c > 1").select("s", "least"))
    copies = cut(profile.select("k", "n", "s").join(whole, "s").filter("k <> least").select("k", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")), whole)
    phrases = profile.join(copies.select("k"), "k", "left_anti").select("k", F.explode("grams").alias("g"))
    recurring = phrases.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1")
    hits = cut(phrases.join(recurring, "g").groupBy("k").agg(F.collect_set(F.when(F.col("c") <= HOT, F.col("g"))).alias("often"), F.collect_set(F.when(F.col("c") > HOT, F.col("g"))).alias("hot")), profile)
    pieces = docs.join(hits, F.col(KEY) == F.col("k")).drop("k").mapInArrow(_segments(window, gram), "shard long, k long, start long, stop long, text binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces.repartition(parts, "shard").sortWithinPartitions("shard", "k", "start").mapInArrow(_shards(window), "k long, start long, stop long")
    return cut(found.unionByName(copies).groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("marks")), hits, copies)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words removed from text, and n_words and n_removed.

    Words are runs of bytes outside 0x20 and 0x09-0x0D, unchanged; kept words
    are joined by one space. A null or empty text has no words and gives an
    empty text. Very long texts are taken whole. Rows of one doc_id, repeated
    rows among them, stand in the order of their texts, so a repeated row counts
    as a copy of the row before; null ids come first. Other columns stay,
    whatever their names, but for those named n_words or n_removed, which are
    replaced. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rows, key = keyed(docs.select(columns))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in columns if c != "text"]).alias("rest")
    rows = rows.select(F.col(key).alias(KEY), F.col("text").cast("string"), rest)
    joined = rows.join(marks(rows.select(KEY, "text"), window), F.col(KEY) == F.col("k"), "left").select("rest", "text", "marks")
    rest_type = joined.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(_without(["rest"]), f"rest {rest_type}, text string, n_words long, n_removed long")
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns], "n_words", "n_removed")
