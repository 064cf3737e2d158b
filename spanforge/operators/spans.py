"""Span algebra over token and sentence tables, all as window and join expressions.

Offsets are code points, end-exclusive, into the tokens joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

ENT_OPEN, ENT_CLOSE = "[ENT] ", " [/ENT]"


def sentences(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, line, text): the non-blank lines of each document, with what other columns of it are named; a null text has none."""
    lines = docs.select("doc_id", *also, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.filter(F.trim("text") != "")


def tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per token of a single-spaced text: keys, pos, token."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return lines.select(*keys, F.posexplode(words).alias("pos", "token"))


def token_offsets(toks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds start_off and end_off: a token starts after all earlier tokens and a space for each."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("token") + 1).over(before), F.lit(0)).cast("int")
    return toks.withColumn("start_off", start).withColumn("end_off", start + F.char_length("token"))


def _starts(lengths: pa.Array) -> pa.Array:
    """Where each word starts, of the lengths of words that a space parts: sums over the batch, less what each line began at."""
    bounds = np.asarray(lengths.offsets)
    sizes = np.asarray(lengths.values.slice(bounds[0], bounds[-1] - bounds[0]), np.int64) + 1
    bounds = bounds - bounds[0]
    before = np.concatenate([[0], np.cumsum(sizes)])
    starts = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(starts.astype(np.int32)))


def line_words(lines: DataFrame, keys: list[str], tag: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(keys, words, tags, starts): the words of each single-spaced text that has one, the tag of each by its word and place if there is a rule, and where they start; a line stays a row, so nothing is shuffled."""
    ship(lines.sparkSession)
    rows = lines.select(*keys, F.filter(F.split("text", " "), lambda w: w != "").alias("words")).filter("size(words) > 0")
    rows = rows if tag is None else rows.withColumn("tags", F.transform("words", tag))
    return rows.withColumn("starts", starts("words"))


def starts(words: str) -> Column:
    """Where each word of an array starts in the text that they make, joined by one space.

    Spark moves no filter below what is not deterministic. Else it would put filters
    on spans below the arrays that they are made of, and make those anew for every word.
    """
    return F.arrow_udf(_starts, "array<int>").asNondeterministic()(F.transform(words, lambda w: F.coalesce(F.char_length(w), F.lit(-1))))


def word_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each word of line_words: keys, pos, token, start_off, end_off and, where lines have tags, tag."""
    more = [c for c in ("tags",) if c in lines.columns]
    rows = lines.select(*keys, F.posexplode(F.arrays_zip("words", "starts", *more)).alias("pos", "z"))
    token, start = F.col("z.words"), F.col("z.starts")
    return rows.select(*keys, "pos", token.alias("token"), start.alias("start_off"), (start + F.char_length(token)).alias("end_off"), *[F.col("z.tags").alias("tag") for _ in more])


def line_spans(words: str | Column, starts: str | Column, tags: str | Column, strict: bool = False, ends: Column | None = None) -> Column:
    """bio_spans of a line's arrays of words (or, if given, where they end), starts and tags: structs (start_off, end_off, label, first_pos, last_pos) in order."""
    words, starts, tags = (F.col(c) if isinstance(c, str) else c for c in (words, starts, tags))

    stop = lambda b: F.get(starts, b) + F.char_length(F.get(words, b)) if ends is None else F.get(ends, b)

    def found(line: Column) -> Column:
        label, begins = (lambda i: F.get(line["labels"], i)), (lambda i: F.get(line["begins"], i))
        opens = lambda i: begins(i) | ~label(i).eqNullSafe(label(i - 1))
        first = F.filter(line["marked"], opens)
        last = F.filter(line["marked"], lambda i: label(i + 1).isNull() | opens(i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(F.get(starts, a).alias("start_off"), stop(b).alias("end_off"), label(a).alias("label"), a.alias("first_pos"), b.alias("last_pos"), begins(a).alias("begins")))

    labels = F.transform(tags, _label)
    marked = F.filter(F.transform(tags, lambda t, i: F.when(_label(t).isNotNull(), i)), lambda i: i.isNotNull())
    line = F.struct(labels.alias("labels"), F.transform(tags, lambda t: _bio(t) == "B").alias("begins"), marked.alias("marked"))
    every = F.get(F.transform(F.array(line), found), F.lit(0))  # the arrays of a line are made once
    kept = F.filter(every, lambda s: s["begins"]) if strict else every
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start_off", "end_off", "label", "first_pos", "last_pos")]))


def _covering(starts: pa.Array, ends: pa.Array, begin: pa.Array, stop: pa.Array) -> pa.Array:
    """Places [a, b) of the words that each span touches; none touches: nulls. Each line has a stretch of numbers of its own, so one search serves a batch."""

    def flat(lists: pa.Array, missing: int) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.asarray(lists.offsets).astype(np.int64)
        values = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).fill_null(missing)
        return np.asarray(values, np.int64), bounds - bounds[0]

    most = np.iinfo(np.int32)
    (s, words), (e, _), (x, spans), (y, _) = flat(starts, most.min), flat(ends, most.min), flat(begin, most.max), flat(stop, most.min)
    line, of = np.repeat(np.arange(len(starts)), np.diff(words)), np.repeat(np.arange(len(starts)), np.diff(spans))
    a = np.searchsorted(e + line * (1 << 33), x + of * (1 << 33), "right") - words[of]
    b = np.searchsorted(s + line * (1 << 33), y + of * (1 << 33), "left") - words[of]
    none = a >= b
    places = pa.StructArray.from_arrays([pa.array(v.astype(np.int32), mask=none) for v in (a, b)], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(spans, pa.int32()), places)


def covering(starts: Column, ends: Column, begin: Column, stop: Column) -> Column:
    """For each span [begin, stop) of a line the structs (a, b) of the places of its words, by their starts and ends in order; null where no word overlaps."""
    return F.arrow_udf(_covering, "array<struct<a:int,b:int>>").asNondeterministic()(starts, ends, begin, stop)


def _bio(tag: Column) -> Column:
    return F.when(tag == "O", None).when(tag.contains("-"), F.substring_index(tag, "-", 1)).otherwise("B")


def _label(tag: Column) -> Column:
    return F.when(tag == "O", None).when(tag.contains("-"), F.substring(tag, F.instr(tag, "-") + 1, F.char_length(tag))).otherwise(tag)


def _parts(tagged: DataFrame) -> DataFrame:
    """Splits a tag into bio and label; a tag without a dash opens a span of its own, O has no label."""
    return tagged.withColumn("bio", _bio(F.col("tag"))).withColumn("label", _label(F.col("tag")))


def bio_spans(tagged: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Spans (keys, start_off, end_off, label, first_pos, last_pos) of tagged tokens with offsets.

    A span opens at a B tag or where the label changes; an I tag after O or
    after another label opens one too, unless strict, which drops such orphans.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    opens = F.col("label").isNotNull() & ((F.col("bio") == "B") | ~F.col("label").eqNullSafe(F.lag("label").over(order)))
    marked = _parts(tagged).withColumn("opens", opens)
    marked = marked.withColumn("island", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.filter("label is not null").groupBy(*keys, "island").agg(
        F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.first("label").alias("label"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("bio", "pos").alias("first_bio")
    )
    if strict:
        spans = spans.filter("first_bio = 'B'")
    return spans.select(*keys, "start_off", "end_off", "label", "first_pos", "last_pos")


def char_to_word_spans(spans: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the covering words [word_start, word_end) of each character span; null where no word overlaps.

    The words of a sentence meet its spans as one row and are searched, so the work
    grows with words and spans, not with their product.
    """
    ship(spans.sparkSession)
    own = [c for c in spans.columns if c not in keys]
    words = offsets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("start_off").alias("ws"), F.col("end_off").alias("we")))).alias("_words"))
    rows = spans.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_spans")).join(words, keys, "left")
    found = covering(F.coalesce("_words.ws", F.array().cast("array<int>")), F.coalesce("_words.we", F.array().cast("array<int>")), F.col("_spans.start_off"), F.col("_spans.end_off"))
    rows = rows.withColumn("_found", found).select(*keys, "_words", F.explode(F.arrays_zip("_spans", "_found")).alias("_z"))
    return rows.select(*keys, *[F.col("_z._spans")[c].alias(c) for c in own], F.get("_words.pos", F.col("_z._found.a")).alias("word_start"), (F.get("_words.pos", F.col("_z._found.b") - 1) + 1).alias("word_end")).select(*spans.columns, "word_start", "word_end")


def word_to_char_spans(spans: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Character offsets of word spans [first_pos, last_pos]."""
    first = offsets.select(*keys, F.col("pos").alias("first_pos"), F.col("start_off").alias("char_start"))
    last = offsets.select(*keys, F.col("pos").alias("last_pos"), F.col("end_off").alias("char_end"))
    return spans.join(first, [*keys, "first_pos"]).join(last, [*keys, "last_pos"])


def _cut(text: str, start: Column | int, end: Column) -> Column:
    """Code points [start, end) of a text."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(F.col(text), start + 1, F.greatest(F.lit(0), end - start))


def in_context(text: str, start: str, end: str, prefix: str = "", mode: str = "context") -> Column:
    """The span marked in its whole text, or alone where mode is span."""
    s, e = F.col(start), F.col(end)
    if mode == "span":
        return F.concat(F.lit(prefix), _cut(text, s, e))
    if mode != "context":
        raise ValueError(f"unknown mode {mode}")
    return F.concat(F.lit(prefix), _cut(text, 0, s), F.lit(ENT_OPEN), _cut(text, s, e), F.lit(ENT_CLOSE), _cut(text, e, F.char_length(text)))


def windowed(text: str, start: str, end: str, width: int = 160, left: str = ENT_OPEN, right: str = ENT_CLOSE) -> Column:
    """The span marked in at most width characters of its text on either side."""
    s, e = F.col(start), F.col(end)
    return F.concat(_cut(text, F.greatest(F.lit(0), s - width), s), F.lit(left), _cut(text, s, e), F.lit(right), _cut(text, e, F.least(F.char_length(text), e + width)))


def kwic(text: str, start: str, end: str, width: int = 60) -> Column:
    return windowed(text, start, end, width, "[[", "]]")


def collapse_space(text: str) -> Column:
    return F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))


def nest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence with its spans in order."""
    return spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_off", "end_off", "label"))).alias("spans"))
