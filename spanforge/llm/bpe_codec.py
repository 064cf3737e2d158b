"""BPE encoding and decoding as streaming transducers with bounded lookahead.

The encoder reads a word's bytes one by one and keeps the last token of the
encoding up to each place. A boundary between two tokens can still go only
within the merge list's sufficient lookahead, so tokens that end so far back are
stable: they are emitted, and what was kept of them is dropped. Memory stays
constant however long a word is. The decoder is a machine from tokens to bytes
to text that holds an unfinished character and nothing else.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import slices
from .bpe import END, Matcher, Merges, byte_letters

#: Fixed values of the format: its white space and its word pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
#: Words that are remembered; at the bound they are dropped, which changes no result.
MOST_WORDS = 300_000
#: Texts longer than this are read in pieces of as many words or tokens.
PIECE = 1 << 20


class Encoder:
    """Tokens of a word, each emitted once no symbol to come can change it."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.matcher = Matcher(merges)
        self.lookahead = max(1, merges.lookahead)
        #: Symbols read before stable tokens are looked for again.
        self.stretch = 4 * (self.lookahead + merges.longest)

    def stream(self, symbols: str) -> Iterator[list[int]]:
        """The tokens of one word, some at a time; at most `stretch` places are kept."""
        tokens, sizes = [-1], [0]  # by place since the last that was emitted
        node, step, follows, known, stretch = self.matcher.root, self.matcher.step, self.merges.follows, self.merges.known.get, self.stretch
        for symbol in symbols:
            node = node.next.get(symbol) or step(node, symbol)
            here = len(tokens)
            for size, token in node.outs:
                before = tokens[here - size]
                if before < 0:
                    break
                holds = known(key := before << 32 | token)
                if holds or holds is None and follows(key):
                    break
            else:
                raise ValueError(f"no token ends after {node.tail!r}")
            tokens.append(token)
            sizes.append(size)
            if here >= stretch:
                out, at = self._back(tokens, sizes, here, here - self.lookahead)
                yield out
                del tokens[:at], sizes[:at]
        yield self._back(tokens, sizes, len(tokens) - 1, len(tokens) - 1)[0]

    @staticmethod
    def _back(tokens: list[int], sizes: list[int], at: int, least: int) -> tuple[list[int], int]:
        """The tokens up to the last boundary at least or before, on the way back from a place, and that boundary."""
        while at > least:
            at -= sizes[at]
        out, end = [], at
        while at > 0:
            out.append(tokens[at])
            at -= sizes[at]
        return out[::-1], end


class TextMachine:
    """Decodes tokens to text, some at a time; a character comes out with its last byte.

    plain: each token as it is written and a space between two, as the library
    decodes for a file without a decoder. Else the bytes that tokens stand for,
    and a space after a word's end.
    """

    def __init__(self, merges: Merges, plain: bool = True):
        letters = byte_letters()

        def piece(written: str) -> bytes:
            if plain or written in merges.special:
                return written.encode()
            final = merges.ends and written.endswith(END)
            return bytes(letters[c] for c in (written[: -len(END)] if final else written)) + (b" " if final else b"")

        self.pieces = [b""] * (max(merges.written) + 1)
        for i, t in merges.written.items():
            self.pieces[i] = piece(t)
        self.between = b" " if plain else b""
        self.start()

    def start(self) -> None:
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.fresh = True

    def feed(self, tokens: Iterable[int]) -> str:
        pieces = self.pieces
        data = self.between.join([pieces[t] for t in tokens])
        data = data if self.fresh else self.between + data
        self.fresh = False
        return self.utf8.decode(data)

    def finish(self) -> str:
        out = self.utf8.decode(b"", True)
        self.start()
        return out


def normalised(text: str) -> str:
    """NFC, then each character in lower case by itself (so a final sigma is like any other)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Codec:
    """Texts to token ids as little-endian 32-bit integers, and such ids to text."""

    def __init__(self, text: str):
        self.merges = Merges(text)
        self.encoder = Encoder(self.merges)
        self.machine = TextMachine(self.merges)
        self.known: dict[str, bytes] = {}
        self.splitter = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None

    def word(self, word: str) -> bytes:
        data = word.encode()
        ids = b"".join([np.array(some, "<u4").tobytes() for some in self.encoder.stream(self.merges.word(data))])
        if len(data) <= 64:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _words(self, text: str) -> Iterator[list[str]]:
        """Words of a text without special strings, some at a time."""
        text = normalised(text)
        if len(text) <= PIECE:
            yield WORDS.findall(text)
            return
        some: list[str] = []
        for m in WORDS.finditer(text):
            some.append(m.group())
            if len(some) >= PIECE:
                yield some
                some = []
        yield some

    def encode(self, text: str) -> bytes:
        parts: list[bytes] = []
        get, at = self.known.get, 0
        found = list(self.splitter.finditer(text)) if self.splitter and "<|" in text else []
        for m in [*found, None]:
            for words in self._words(text[at : m.start() if m else None]):
                parts.append(b"".join([get(w) or self.word(w) for w in words]))
            if m:
                parts.append(np.array([self.merges.special[m.group()]], "<u4").tobytes())
                at = m.end()
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The machine's text of all tokens, fed PIECE at a time."""
        numbers = np.frombuffer(ids, "<u4")
        parts = [self.machine.feed(numbers[at : at + PIECE].tolist()) for at in range(0, len(numbers), PIECE)]
        return "".join([*parts, self.machine.finish()])


@cache
def _codec(text: str) -> Codec:
    return Codec(text)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), one for each row of docs.

    ids are the tokenizer file's ids of the whole text, without added special
    tokens, as little-endian unsigned 32-bit integers; special strings in a text
    are their tokens; decoded is the written tokens joined by a space. Null
    texts are empty and give no ids and an empty string; null and repeated ids
    and rows stay as they are; texts of any length are encoded whole; other columns
    are ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:  # read on the driver; a vocabulary file of bounded size
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in slices(batches, "text"):
            ids = [codec.encode(t) if t else b"" for t in b.column("text").to_pylist()]
            decoded = pa.array([codec.decode(i) for i in ids], pa.string())
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, pa.array(ids, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
