"""Block files read by byte ranges: the same rows wherever ranges end."""

import io
import random

import pytest

from spanforge.sources import blocks, text_formats as t

LINES = ["Marie x B-per", "été O", "lone", "", "  ", "\t", "日本 y z I-loc", "a b\r", "\r", "x" * 50 + " O"]


def text(seed, n):
    rng = random.Random(seed)
    return "\n".join(rng.choice(LINES) for _ in range(n)) + rng.choice(["", "\n", "\n\n"])


def plain(data):
    """(block, pos, token, tag), line by line."""
    out, at, block, pos = [], 0, None, 0
    for raw in data.split(b"\n"):
        line = raw.decode()
        if not line.strip():
            block, pos = None, 0
        else:
            block = at if block is None else block
            cols = line.split()
            if len(cols) > 1:
                out.append((block, pos, cols[0], cols[-1]))
                pos += 1
        at += len(raw) + 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_every_size_of_range(seed):
    data = text(seed, 60).encode()
    for size in (1, 2, 3, 7, 16, 50, 200, len(data) or 1):
        got = []
        for at in range(0, len(data), size):
            got += [r[1:] for r in blocks.rows_of(io.BytesIO(data), at, min(at + size, len(data)), blocks.bio_line)]
        assert got == plain(data), size


def test_chunks_smaller_than_lines(monkeypatch):
    monkeypatch.setattr(blocks, "_CHUNK", 5)
    data = text(3, 80).encode()
    assert [r[1:] for r in blocks.rows_of(io.BytesIO(data), 0, len(data), blocks.bio_line)] == plain(data)


@pytest.mark.parametrize("kind", ["bio", "conllu"])
def test_one_file_in_1_and_in_16_partitions(spark, tmp_path, kind):
    if kind == "bio":
        body, read, lines = text(11, 3000), t.bio_text, t.bio_lines
    else:
        word = lambda i: "\t".join([f"{i % 9}" if i % 7 else "3-4", f"w{i}", *["_"] * 7, f"SpaceAfter=No|Entity=({i}-x" if i % 3 else "_"])
        body, read, lines = "\n".join("" if i % 11 == 0 else "# c" if i % 13 == 0 else word(i) for i in range(3000)), t.conllu, t.conllu_lines
    path = tmp_path / "one.txt"
    path.write_bytes(body.encode())
    size = path.stat().st_size
    whole, split = (read(spark, str(path), b) for b in (size, size // 15))
    source = lambda b: blocks.read(spark, str(path), kind, b).rdd.getNumPartitions()
    assert source(size) == 1 and source(size // 15) == 16
    key = lambda d: sorted(tuple(r)[1:] for r in d.collect())
    assert key(whole) == key(split)
    # as the lines read whole give them
    assert key(split) == key(lines(t.numbered_lines(spark, str(path))))
    first = split.groupBy("sent_id").count().count()
    assert split.agg({"sent_id": "max"}).first()[0] == first - 1


def test_folders_patterns_and_empty_files(spark, tmp_path):
    for name, body in (("a.txt", "x O\n\ny O"), ("b.txt", ""), ("_c.txt", "z O"), ("d.csv", "q B-x")):
        (tmp_path / name).write_text(body)
    got = sorted((r.file.rpartition("/")[2], r.sent_id, r.token) for r in t.bio_text(spark, str(tmp_path), 3).collect())
    assert got == [("a.txt", 0, "x"), ("a.txt", 1, "y"), ("d.csv", 0, "q")]
    assert t.bio_text(spark, str(tmp_path / "*.csv")).count() == 1
    with pytest.raises(FileNotFoundError):
        t.bio_text(spark, str(tmp_path / "none*"))
    with pytest.raises(ValueError):
        blocks.read(spark, str(tmp_path), "bio", 0)


def test_no_window_over_a_file(spark, tmp_path):
    """Places and tags come out of the reader: only counts for each range are shuffled."""
    (tmp_path / "a.txt").write_text(text(1, 500))
    plan = t.bio_text(spark, str(tmp_path), 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and "PythonMapInArrow" not in plan


def scalar_conllu(line):
    """A word line's form and entity, column by column."""
    cols = line.split("\t")
    if line.startswith("#") or len(cols) < 10 or "-" in cols[0] or "." in cols[0]:
        return None
    return cols[1], next((m[7:] for m in cols[9].split("|") if m.startswith("Entity=")), "")


def test_odd_lines(monkeypatch):
    """Lines of tabs alone, broken UTF-8, other white space and both line ends, in chunks of any size."""
    word = lambda i, last: f"{i}\tw{i}" + "\t_" * 7 + f"\t{last}"
    lines = [word(1, "Entity=(a"), word(2, "X|Entity=b|Entity=c"), word(3, "NoEntity=d"), "\t" * 12, word("4-5", "_"), word(5.1, "_"), "# " + word(6, "_"), word(7, "Entity="), "\u2003 \x85", word(8, "\u2003|Entity=é\r"), "\r", "x\ty", word(9, "z") + "\tmore"]
    data = "\n".join(lines * 3).encode().replace(b"w7", b"w\xff\xe2\x82") + b"\n"
    for kind, parse in (("conllu", scalar_conllu), ("bio", lambda x: (x.split()[0], x.split()[-1]) if len(x.split()) > 1 else None)):
        want, at, block, pos, nth = [], 0, None, 0, -1
        for raw in data.split(b"\n"):
            line = raw.decode("utf-8", "replace").removesuffix("\r")
            if not line.strip():
                block, pos = None, 0
            else:
                block = at if block is None else block
                if found := parse(line):
                    nth += pos == 0
                    want.append((nth, block, pos, *found))
                    pos += 1
            at += len(raw) + 1
        for chunk in (1, 7, 64, 1 << 20):
            monkeypatch.setattr(blocks, "_CHUNK", chunk)
            assert list(blocks.rows_of(io.BytesIO(data), 0, len(data), blocks.LINES[kind])) == want
            for size in (1, 13, 200, len(data)):
                got = []
                for start in range(0, len(data), size):
                    for _, block, first, second in blocks.whole_blocks(blocks.numbered_parts(io.BytesIO(data), start, min(start + size, len(data)), blocks.LINES[kind])):
                        got += [(b, i, *w) for b, f, s in zip(block.tolist(), first.to_pylist(), second.to_pylist()) for i, w in enumerate(zip(f, s))]
                assert got == [w[1:] for w in want], (kind, chunk, size)


def test_whole_blocks(spark, tmp_path):
    """A row for each block, as the rows of read give them, from few ranges however small they may be."""
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(text(i, 4000))
    whole = blocks.read_whole(spark, str(tmp_path), "bio", 10)
    assert whole.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 6
    got = {(r.file, r.block): (r.first, r.second) for r in whole.collect()}
    want = {}
    for r in sorted(blocks.read(spark, str(tmp_path), "bio", 1000).collect(), key=lambda r: (r.file, r.block, r.pos)):
        first, second = want.setdefault((r.file, r.block), ([], []))
        first.append(r.first)
        second.append(r.second)
    assert got == want
