"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

The writer makes one archive per task, under a name of its own, and tells its
path; only archives that a finished task has told are read, so a task that runs
again leaves no double records. The reader streams an archive frame by frame:
dictionary first, then each record is checked (version line, header lines,
lengths, digests, closing lines) before it comes out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch, ship
from .arrays import slices

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are deduplicated.
LEAST_REVISIT = 100
DICTIONARY_BYTES = 1 << 16
#: Payload bytes of an archive's first records that its dictionary is trained on, and of a whole archive.
SAMPLE_BYTES = 1 << 21
ARCHIVE_BYTES = 1 << 30
_READ = 1 << 20


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or c == "%" else c for c in value)


def _unclean(value: str) -> str:
    out, at = [], 0
    while (found := value.find("%", at)) >= 0:
        out += [value[at:found], chr(int(value[found + 1 : found + 3], 16))]
        at = found + 3
    return "".join([*out, value[at:]])


def encode_record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in headers.items()), b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """One record, checked against its own headers."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise WarcError("a record without a version line or an end of its headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"not a header: {line[:60]!r}")
        if name in headers:
            raise WarcError(f"header {name} comes twice")
        headers[name] = _unclean(value.strip())
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    length = headers["Content-Length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"a block of {len(rest) - 4} bytes, Content-Length {length}")
    payload = rest[:-4]
    if (want := headers.get("WARC-Block-Digest")) and want != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise WarcError("the block's digest differs")
    return Record(headers, payload)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for these records; their own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Writer:
    """Records to one archive; the first are held back to train the dictionary on."""

    def __init__(self, out: BinaryIO):
        self.out, self.held, self.size, self.written = out, [], 0, 0
        self.compressor = None

    def add(self, headers: dict[str, str], payload: bytes) -> None:
        record = encode_record(headers, payload)
        self.written += len(record)
        if self.compressor is None:
            self.held.append(record)
            self.size += len(record)
            if self.size >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.write(self.compressor.compress(record))

    def _start(self) -> None:
        content = train_dictionary([r[: 1 << 17] for r in self.held])
        self.out.write(dictionary_frame(content))
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
        for record in self.held:
            self.out.write(self.compressor.compress(record))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()
        self.out.close()


def _exactly(source: BinaryIO, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise WarcError("the archive ends inside a frame")
    return data


def read_archive(source: BinaryIO) -> Iterator[Record]:
    """The records of an archive; memory holds one record and its frame."""
    magic, size = struct.unpack("<II", _exactly(source, 8))
    if magic != SKIPPABLE:
        raise WarcError("the archive does not begin with a dictionary")
    content = _exactly(source, size)
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    # a dictionary without the format's magic number is raw content, as zstandard takes it
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    pending = b""
    while True:
        pending = pending or source.read(_READ)
        if not pending:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := source.read(_READ)):
                raise WarcError("the archive ends inside a record's frame")
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as error:
                raise WarcError(f"not a frame: {error}") from error
            pending = frame.unused_data
        yield decode_record(b"".join(parts))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of (id, url, html, digest, refers); rows (path, records) of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base)
        made: list[list] = []
        writer = None
        for b in slices(batches, "html"):
            for key, url, page, digest, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers"))):
                if writer is None:
                    made.append([f"{folder}/{uuid.uuid4().hex}.warc.zst", 0])
                    writer = Writer(system.open_output_stream(f"{base}/{made[-1][0].rpartition('/')[2]}"))
                payload = (page or "").encode()
                headers = {
                    "WARC-Type": "response" if refers is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Payload-Digest": f"sha256:{digest}",
                }
                if url is not None:
                    headers["WARC-Target-URI"] = url
                if key is not None:
                    headers["X-Page-ID"] = str(key)
                if refers is None:
                    headers |= {"Content-Type": "text/html", "WARC-Block-Digest": f"sha256:{digest}"}
                else:
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers), "X-Payload-Length": str(len(payload))}
                writer.add(headers, payload if refers is None else b"")
                made[-1][1] += 1
                if writer.written >= ARCHIVE_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return pages.select("id", "url", "html", "digest", "refers").mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives(path, records): page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Fails on an archive that does not keep to the format or has another number of records.
    """

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, want in zip(frame["path"], frame["records"]):
                system, at = _filesystem(path)
                rows, size, seen = [], 0, 0
                with system.open_input_stream(at) as source:
                    for headers, payload in read_archive(source):
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise WarcError(f"{path}: a payload's digest differs")
                        if kind == "revisit" and payload:
                            raise WarcError(f"{path}: a revisit with a payload")
                        length = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), headers.get("WARC-Target-URI"), kind, payload, length, digest, refers and int(refers)))
                        seen += 1
                        size += len(payload)
                        if size > 1 << 23 or len(rows) >= 5000:
                            yield table(rows)
                            rows, size = [], 0
                if seen != want:
                    raise WarcError(f"{path}: {seen} records, {want} were written")
                yield table(rows)

    ship(archives.sparkSession)
    return archives.mapInPandas(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives below folder (the shared one if none is given); rows (path, records).

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the
    smallest page_id is a response and the others revisit it; a row with a null
    page_id is never revisited, and is a response if its payload has no other.
    All rows that have the smallest page_id, repeated ones, are responses. Null
    and empty pages have an empty payload and are responses. Other columns are
    ignored. An empty table writes no archive.
    """
    ship(pages.sparkSession)
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("digest", digest)
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT
    first = rows.filter(long).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null")
    refers = F.when(F.col("id").isNull() | (F.col("id") > F.col("least")), F.col("least"))
    marked = rows.join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left").withColumn("refers", refers)
    return cut(write_archives(marked, folder or scratch(pages.sparkSession, "warc")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives and read them back; see archive() and read_archives()."""
    paths = archive(pages)
    return read_archives(paths.repartition(max(1, min(paths.count(), 10_000))))
