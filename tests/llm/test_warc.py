import hashlib
import io
import struct

import pytest
import zstandard

from spanforge.llm import warc


def archive_bytes(records):
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    writer = warc.Writer(out)
    for h, p in records:
        writer.add(h, p)
    writer.close()
    return out.getvalue()


HEADERS = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "1970-01-01T00:00:00Z"}


def test_one_frame_per_record_and_dictionary(monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 4000)
    records = [(HEADERS | {"WARC-Target-URI": f"http://x/\r\n{i}%"}, b"page %d " % i * 40) for i in range(60)] + [(HEADERS, b""), (HEADERS, bytes(range(256)) * 30000)]
    data = archive_bytes(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size])
    reader, rest, frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), data[8 + size :], 0
    while rest:
        frame = reader.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = frame.unused_data, frames + 1
    assert frames == len(records)
    got = list(warc.read_archive(io.BytesIO(data)))
    assert [r.payload for r in got] == [p for _, p in records]
    assert got[3].headers["WARC-Target-URI"] == "http://x/\r\n3%"
    # a dictionary frame may hold the dictionary itself
    plain = struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + data[8 + size :]
    assert len(list(warc.read_archive(io.BytesIO(plain)))) == len(records)


def test_damaged_archives():
    data = archive_bytes([(HEADERS, b"abc" * 50)] * 3)
    for bad in (data[4:], data[:-3], data[:200], data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    good = warc.encode_record(HEADERS, b"abc")
    assert warc.decode_record(good).payload == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b": 3", b": 4"), good.replace(b": 3", b": x"), good.replace(b"WARC-Date", b"WARC-Type"), good.replace(b"WARC-Type: ", b"WARC-Type "), good.replace(b"WARC-Record-ID", b"Other")):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)


def test_round_trip(spark):
    long, other = "<p>é😀</p>" * 20, "x" * 100
    rows = [(5, "u", long), (3, "v\n", long), (9, None, long), (None, "w", long), (3, "v", long), (7, "", other), (8, "s", "x" * 99), (2, "s", "x" * 99), (1, "n", None), (4, "n", None), (6, "e", ""), (10, "big", "y" * 3_000_000), (None, "only", "z" * 200)]
    rows += [(100 + i, f"http://h/{i}", f"page {i} " * 300) for i in range(300)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, refers int").repartition(3)
    got = warc.round_trip(table).collect()
    want = []
    for d, u, t in rows:
        p = (t or "").encode()
        same = [x for x, _, y in rows if (y or "").encode() == p and x is not None]
        refers = min(same) if len(p) >= 100 and same and (d is None or d > min(same)) else None
        want.append((d, u, "response" if refers is None else "revisit", len(p), hashlib.sha256(p).hexdigest(), refers, p if refers is None else b""))
    assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
