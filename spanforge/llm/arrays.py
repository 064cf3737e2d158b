"""Vectorised word, hash and batch kernels over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; these bytes never
occur inside a multi-byte UTF-8 character, so byte positions are safe.

Two kinds of hashes. Words are hashed eight bytes at a time by a function that
mixes after each step. Spans of a few such hashes are polynomials modulo 2**64
from prefix sums: quick, but long spans of regular order can collide, so they
only ever choose what is looked at. Where equality decides, bytes are compared
or SHA-256 is taken of them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text handled at once; work arrays take some 60 times as much.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n + n // 4, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U), np.cumprod(np.full(most - 1, self.base, U))])
                self.down = np.concatenate([np.ones(1, U), np.cumprod(np.full(most - 1, self.inverse, U))])
        return self.up[:n], self.down[:n]


_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS = [Powers(b) for b in _BASES]
_BYTES = [mix(np.arange(256, dtype=U) * U(0x9E3779B97F4A7C15) + U(17 + k)) for k in range(2)]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for every span."""
    up, down = _POWERS[k].grown(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values * up[:-1])])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Longer words are hashed or compared one by one.
LANES = 8


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of data, as a little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """Hash of data[start:end] for every span; different spans of one length up to eight bytes never share one."""
    eight = octets(data)
    left = ends - starts
    with np.errstate(over="ignore"):
        out = mix((eight[starts] & _MASKS[np.minimum(left, 8)]) ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        out = mix(out + left.astype(U) * U(0xD6E8FEB86659FD93))
    for j in range(1, LANES):
        more = np.flatnonzero(left > 8 * j)
        if not len(more):
            break
        with np.errstate(over="ignore"):
            part = eight[starts[more] + 8 * j] & _MASKS[np.minimum(left[more] - 8 * j, 8)]
            out[more] = mix(out[more] * U(0x9FB21C651E98DF25) + U(j) ^ part)
    long = np.flatnonzero(left > 8 * LANES)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b], k) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span equal those of the span whose number `of` gives."""
    eight = octets(data)
    left = ends - starts
    same = left == left[of]
    for j in range(LANES):
        more = np.flatnonzero(same & (left > 8 * j) & (of != np.arange(len(of))))
        if not len(more):
            break
        mask = _MASKS[np.minimum(left[more] - 8 * j, 8)]
        same[more] = (eight[starts[more] + 8 * j] & mask) == (eight[starts[of[more]] + 8 * j] & mask)
    for i in np.flatnonzero(same & (left > 8 * LANES) & (of != np.arange(len(of)))).tolist():
        same[i] = (data[starts[i] : ends[i]] == data[starts[of[i]] : ends[of[i]]]).all()
    return same


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, nulls empty, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary()) if column.type != pa.null() else pa.array([b""] * len(column), pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for later stages, which need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with at most `most` bytes in the column, or one row."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0)).astype(np.int64)
        at, n = 0, len(lengths)
        ends = np.cumsum(lengths)
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


class Words:
    """Words of some rows: byte starts and ends, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))) if len(data) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1 if len(data) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)  # a word per row from first[i] to first[i + 1]
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, k: int = 0) -> np.ndarray:
        """Hash of each word."""
        return word_hash(self.data, self.starts, self.ends, k)


def packed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by one space: bytes, and each word's start and end there."""
    n = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(n + 1)])[:-1] if len(n) else np.zeros(0, np.int64)
    total = int((n + 1).sum())
    out = np.full(total, 0x20, np.uint8)
    if total:
        keep = np.zeros(len(words.data) + 1, np.int8)
        np.add.at(keep, words.starts, 1)
        np.add.at(keep, words.ends, -1)
        inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        slot = np.ones(total, bool)
        slot[starts + n] = False
        out[slot] = words.data[inside]
    return out, starts, starts + n


def digests(words: Words) -> list[bytes]:
    """SHA-256 of the words of each row, joined by one space."""
    text, starts, ends = packed(words)
    view, first = memoryview(text), words.first.tolist()
    return [hashlib.sha256(view[starts[a] : ends[b - 1]] if b > a else b"").digest() for a, b in zip(first[:-1], first[1:])]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 4096) -> Iterator[pa.Table]:
    """Runs of whole groups of sorted batches."""
    held: list[pa.RecordBatch] = []
    at = None
    for whole in batches:
        for i in range(0, whole.num_rows, most):
            batch = whole.slice(i, most)
            columns = [np.asarray(batch.column(k)) for k in keys]
            end = [c[-1] for c in columns]
            split = int(np.flatnonzero(np.logical_and.reduce([c == e for c, e in zip(columns, end)]))[0])  # where the last group starts
            if split or (held and at != end):
                yield pa.Table.from_batches([*held, batch.slice(0, split)])
                held = []
            held.append(batch.slice(split))
            at = end
    if held:
        yield pa.Table.from_batches(held)
