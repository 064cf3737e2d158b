"""Terms of texts: maximal runs of ASCII digits, letters and all characters beyond ASCII, A-Z in lower case."""

from __future__ import annotations

import numpy as np

from .arrays import U, Words, octets, word_hash

#: For each byte, its lower case where it belongs to a term, else a space.
TERM_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTES[_low : _high + 1] = np.arange(_low, _high + 1)
TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Terms of each row, over bytes in lower case."""
    return Words(TERM_BYTES[data], offsets)


def equal_spans(data: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes of data from at equal those of other from other_at."""
    left, right = octets(data), octets(other)
    same = np.ones(len(at), bool)
    for j in range(0, int(length.max(initial=0)), 8):
        more = np.flatnonzero(same & (length > j))
        if not len(more):
            break
        drop = U(8) * (U(8) - np.minimum(length[more] - j, 8).astype(U))
        same[more] = ((left[at[more] + j] ^ right[other_at[more] + j]) << drop) == 0
    return same


class Vocabulary:
    """A bounded set of terms, looked up by hash and confirmed by bytes."""

    def __init__(self, found: list[str]):
        raw = [t.encode() for t in found]
        lengths = np.array([len(r) for r in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        for self.k in range(64):
            hashes = word_hash(self.data, ends - lengths, ends, self.k)
            if len(np.unique(hashes)) == len(raw):
                break
        else:
            raise ValueError("the terms are not distinct")
        self.order = np.argsort(hashes)
        self.hashes, self.starts, self.ends = hashes[self.order], (ends - lengths)[self.order], ends[self.order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term): the places of words that are terms, and the number of the term in the list given."""
        if not len(self.hashes) or not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes(self.k)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hit]
        length = words.ends[hit] - words.starts[hit]
        same = length == self.ends[at] - self.starts[at]
        hit, at, length = hit[same], at[same], length[same]
        same = equal_spans(words.data, words.starts[hit], self.data, self.starts[at], length)
        return hit[same], self.order[at[same]]
