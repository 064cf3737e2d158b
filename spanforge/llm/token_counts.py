"""Token counts by finite-state tokenizer compilation.

Two transducers in a row. The splitter reads character classes and says where
pre-tokens start: its 8 states make a map of states for each chunk of text, the
maps are composed by a parallel prefix scan, and each chunk is then read from
the state in which it is entered. The counter reads the bytes of each distinct
pre-token; its transitions are annotated with the tokens they add to (or take
back from) the count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import buffers, same_bytes, slices, word_hash
from .bpe import Matcher, Merges, Node

CHUNK = 256
#: Fixed values of the format: white space, and what follows an apostrophe in a contraction.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words and states that are kept; at the bound they are dropped, which changes no result.
MOST_WORDS, MOST_STATES = 500_000, 120_000

FRESH, SPACE, LETTERS, NUMBERS, OTHERS, WHITES, ONE_MORE, TWO_MORE = range(8)
LETTER, NUMBER, OTHER, SHORT, LONG, LAST_SPACE, LAST_WHITE, INNER_WHITE = range(8)


@cache
def character_classes() -> np.ndarray:
    """LETTER, NUMBER or OTHER of each code point; INNER_WHITE for white space."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[WHITE] = INNER_WHITE
    return out


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a pre-token starts, by class (plus 8 at the start of a segment) and state."""
    go, starts = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for kind in range(16):
        for now in range(8):
            state = FRESH if kind >= 8 else now
            c = kind % 8
            if c == LETTER and state in (ONE_MORE, TWO_MORE):
                to, new = (FRESH if state == ONE_MORE else ONE_MORE), False
            elif c in (LETTER, NUMBER):
                to = LETTERS if c == LETTER else NUMBERS
                new = state not in (to, SPACE)
            elif c in (OTHER, SHORT, LONG) and (c == OTHER or state in (OTHERS, SPACE)):
                to, new = OTHERS, state not in (OTHERS, SPACE)
            elif c in (SHORT, LONG):
                to, new = (ONE_MORE if c == SHORT else TWO_MORE), True
            elif c == INNER_WHITE:
                to, new = WHITES, state != WHITES
            else:
                to, new = (SPACE if c == LAST_SPACE else FRESH), True
            go[kind, now], starts[kind, now] = to, new
    return go, starts


def classify(points: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Class of each character; segment marks those that begin a text of their own."""
    kinds = character_classes()[points]
    n = len(points)
    alone = np.append(segment[1:], True)  # no character of the same segment follows
    white = kinds == INNER_WHITE
    last = white & ~alone & ~np.append(white[1:], True)
    kinds = np.where(last, np.where(points == 0x20, LAST_SPACE, LAST_WHITE), kinds).astype(np.uint8)
    for i in np.flatnonzero(points == 0x27).tolist():
        for tail in CONTRACTIONS:
            k = len(tail)
            if i + k < n and all(points[i + 1 + j] == ord(x) for j, x in enumerate(tail)) and not segment[i + 1 : i + k + 1].any():
                kinds[i] = SHORT if k == 1 else LONG
                break
    return kinds + np.where(segment, 8, 0).astype(np.uint8)


def pretoken_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character, by composed chunk maps."""
    go, starts = splitter()
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, 8 + INNER_WHITE, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = go[column[:, None], maps]
    reach = 1
    while reach < rows:  # each map becomes that of its chunk and the chunks before it
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate([np.full(1, FRESH, np.uint8), maps[:-1, FRESH]])
    out = np.empty((CHUNK, rows), bool)
    for j, column in enumerate(columns):
        out[j] = starts[column, state]
        state = go[column, state]
    return out.T.reshape(-1)[:n]


class State:
    """A node of the matcher, with the last token and the count (less the newest place's) at each place it spans."""

    __slots__ = ("node", "tokens", "counts", "next")

    def __init__(self, node: Node, tokens: tuple, counts: tuple):
        self.node, self.tokens, self.counts, self.next = node, tokens, counts, {}


class Counter:
    """The counting transducer; its transitions say how many tokens they add to the count, or take back."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.matcher = Matcher(merges)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.root = State(self.matcher.root, (-1,), (0,))

    def step(self, state: State, symbol: str) -> tuple[State, int]:
        node = state.node.next.get(symbol) or self.matcher.step(state.node, symbol)
        known, follows, tokens = self.merges.known, self.merges.follows, state.tokens
        for size, token in node.outs:
            before = tokens[-size]
            if before < 0:
                break
            holds = known.get(pair := before << 32 | token)
            if holds or holds is None and follows(pair):
                break
        else:
            raise ValueError(f"no token ends after {node.tail!r}")
        more = state.counts[-size] + 1
        span = len(node.tail) + 1
        tokens = (*tokens, token)[-span:]
        counts = tuple([c - more for c in state.counts[1 - span :]]) + (0,) if span > 1 else (0,)
        if len(self.states) >= MOST_STATES:
            self.reset()
        got = self.states.get(key := (tokens, counts, node.tail))
        if got is None:
            got = self.states[key] = State(node, tokens, counts)
        out = state.next[symbol] = got, more
        return out

    def count(self, data: bytes) -> int:
        state, total, step = self.root, 0, self.step
        for symbol in self.merges.word(data):
            state, more = state.next.get(symbol) or step(state, symbol)
            total += more
        return total


@cache
def _counter(text: str) -> tuple[Counter, dict[bytes, int]]:
    return Counter(Merges(text)), {}


def count_rows(column: pa.Array, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each row of a string column, for the tokenizer file's text."""
    counter, known = _counter(text)
    data, offsets = buffers(column)
    sizes = np.diff(offsets)
    if not len(data):
        return sizes, np.zeros(len(sizes), np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    lengths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(lengths)])
    segment = np.zeros(len(points) + 1, bool)
    rows = np.searchsorted(byte_at, offsets)
    segment[rows] = True
    special = []
    for name in counter.merges.special:
        code, at = name.encode(), -1
        while (at := raw.find(code, at + 1)) >= 0:
            row = np.searchsorted(offsets, at, side="right") - 1
            if at + len(code) <= offsets[row + 1]:
                a = int(np.searchsorted(byte_at, at))
                special.append((a, a + len(name)))
                segment[[a, a + len(name)]] = True
    segment = segment[:-1]
    starts = pretoken_starts(classify(points, segment))
    for a, b in special:
        starts[a + 1 : b] = False
        starts[a] = True
    begin = byte_at[:-1][starts]
    end = np.append(begin[1:], len(data))
    _, index, inverse = np.unique(word_hash(data, begin, end), return_index=True, return_inverse=True)
    if len(known) > MOST_WORDS:
        known.clear()

    def count(at: int) -> int:
        word = raw[begin[at] : end[at]]
        n = known.get(word)
        if n is None:
            n = 1 if word.decode("latin-1") in counter.merges.special else counter.count(word)
            if len(word) <= 64:
                known[word] = n
        return n

    counts = np.array([count(i) for i in index.tolist()], np.int64)[inverse]
    for i in np.flatnonzero(~same_bytes(data, begin, end, index[inverse])).tolist():  # another word of the same hash
        counts[i] = count(i)
    sums = np.concatenate([[0], np.cumsum(counts)])
    first = np.searchsorted(begin, offsets)
    return sizes, np.diff(sums[first])


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs.

    Counts are those of the tokenizer file at path without added special
    tokens; special strings in a text count as one token each. Null texts are
    empty, empty texts have no bytes and no tokens; null and repeated ids and
    rows stay as they are; other columns are ignored; no text is cut, however long;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:  # read on the driver; a vocabulary file of bounded size
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sizes, tokens = count_rows(b.column("text"), spec.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
