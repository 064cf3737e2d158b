"""Files of lines in blocks parted by blank lines, as a Spark data source whose partitions are byte ranges.

A block belongs to the range in which the blank line before it starts (the first
block of a file to the first range), so a range is read from its first whole
blank line up to the first blank line at or past its end, and every block is read
by one task and whole, wherever ranges end. One large file is read by as many
tasks as it has ranges. Lines are parsed as they are read, a chunk at a time by
Arrow: no window and no shuffle are needed for places in a block, and a task holds
a batch of rows, not a range.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "spanforge_blocks"
SCHEMA = "file string, part long, nth long, block long, pos int, first string, second string"
WHOLE = "file string, part long, nth long, block long, first array<string>, second array<string>"
SPLIT_BYTES = 64 << 20
#: Bytes read at a time: no more than a range holds, but for ranges of less than the least.
_CHUNK, _LEAST = 1 << 20, 1 << 14


def _at(columns: pa.ListArray, places: np.ndarray) -> pa.Array:
    """Of the values of all lists those that stand there."""
    return columns.values.take(pa.array(places))


def bio_line(lines: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(which, first, last): the lines of two columns or more, and their first and last column."""
    columns = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines))
    bounds = np.asarray(columns.offsets)
    which = np.flatnonzero(np.diff(bounds) > 1)
    return which, _at(columns, bounds[which]), _at(columns, bounds[which + 1] - 1)


def conllu_line(lines: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(which, form, entity): the word lines of ten columns; comments, ranges (3-4) and empty words (5.1) are none."""
    columns = pc.split_pattern(lines, "\t")
    bounds = np.asarray(columns.offsets)
    which = np.flatnonzero((np.diff(bounds) >= 10) & ~np.asarray(pc.starts_with(lines, "#")))
    number = _at(columns, bounds[which])
    which = which[~np.asarray(pc.or_(pc.match_substring(number, "-"), pc.match_substring(number, ".")))]
    entity = pc.struct_field(pc.extract_regex(_at(columns, bounds[which] + 9), r"(?:^|\|)Entity=(?P<e>[^|]*)"), "e")
    return which, _at(columns, bounds[which] + 1), pc.fill_null(entity, "")


Parse = Callable[[pa.Array], tuple[np.ndarray, pa.Array, pa.Array]]
LINES: dict[str, Parse] = {"bio": bio_line, "conllu": conllu_line}


def lines_from(file, start: int, end: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places, lines) of the whole lines that begin at byte start or later, without their ends: as many as a chunk holds, and on past end."""
    at = max(start - 1, 0)
    file.seek(at)
    skip = int(start > 0)  # the rest of a line that began before, or its end
    chunk, held = b" ", []
    while chunk:
        chunk = file.read(min(_CHUNK, max(end - start, _LEAST)))
        rest = chunk.rfind(b"\n") + 1
        if chunk and not rest:
            held.append(chunk)
            continue
        raw = b"".join([*held, chunk[:rest]])
        held = [chunk[rest:]]
        if not raw:
            continue
        body = raw.removesuffix(b"\n")
        places = at + np.concatenate([[0], np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1])[skip:]
        at += len(raw)
        try:
            text = pa.array([body], pa.large_binary()).cast(pa.large_string())
        except pa.ArrowInvalid:
            text = pa.array([body.decode("utf-8", "replace")], pa.large_string())
        lines = pc.split_pattern(text, "\n").values[skip:].cast(pa.string())
        skip = 0
        if b"\r" in body:
            lines = pc.replace_substring_regex(lines, r"\r\z", "")
        if len(lines):
            yield places, lines


def parts_of(file, start: int, end: int, parse: Parse) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """(block, first, second) of the rows of the range's blocks, some at a time: block is the byte that the block's first line begins at."""
    owned, block, ended = start == 0, -1, False  # block -1: the next line of words begins one
    for at, lines in lines_from(file, start, end):
        blank = np.asarray(pc.equal(pc.utf8_trim_whitespace(lines), ""))
        if not owned:
            if not blank.any():
                if at[-1] >= end:
                    return
                continue
            after = int(blank.argmax())
            if at[after] >= end:
                return
            owned, at, lines, blank = True, at[after:], lines[after:], blank[after:]
        past = blank & (at >= end)
        if past.any():
            stop = int(past.argmax())
            at, lines, blank, ended = at[:stop], lines[:stop], blank[:stop], True
        begins = ~blank & np.concatenate([[block < 0], blank[:-1]])[: len(blank)]
        last = np.maximum.accumulate(np.where(begins, np.arange(len(at)), -1))
        of = np.where(last < 0, block, at[last]) if len(at) else at
        if len(at):
            which, first, second = parse(lines)
            words = ~blank[which]
            yield of[which[words]], first.filter(pa.array(words)), second.filter(pa.array(words))
            block = -1 if blank[-1] else of[-1]
        if ended:
            return


Part = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]


def numbered_parts(file, start: int, end: int, parse: Parse) -> Iterator[Part]:
    """(nth, block, pos, first, second) of parts_of's rows, some at a time: nth counts blocks with a row, pos the rows of a block."""
    nth, before, many = -1, -1, 0
    for block, first, second in parts_of(file, start, end, parse):
        if not len(block):
            continue
        place = np.arange(len(block))
        begins = np.concatenate([[block[0] != before], block[1:] != block[:-1]])
        pos = place - np.maximum.accumulate(np.where(begins, place, -many))
        numbers = nth + np.cumsum(begins)
        yield numbers, block, pos, first, second
        nth, before, many = numbers[-1], block[-1], pos[-1] + 1


def rows_of(file, start: int, end: int, parse: Parse) -> Iterator[tuple[int, int, int, str, str]]:
    """numbered_parts, row by row."""
    for nth, block, pos, first, second in numbered_parts(file, start, end, parse):
        yield from zip(nth.tolist(), block.tolist(), pos.tolist(), first.to_pylist(), second.to_pylist())


def whole_blocks(parts: Iterator[Part]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(nth, block, firsts, seconds) of whole blocks, some at a time: the last block of a part waits for its end."""
    held: list[Part] = []

    def joined() -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        nth, block, pos = (np.concatenate(c) for c in list(zip(*held))[:3])
        begins = np.flatnonzero(pos == 0)
        bounds = pa.array(np.append(begins, len(pos)), pa.int32())
        return nth[begins], block[begins], *(pa.ListArray.from_arrays(bounds, pa.concat_arrays(c)) for c in list(zip(*held))[3:])

    for part in parts:
        begins = np.flatnonzero(part[2] == 0)
        last = begins[-1] if len(begins) else 0
        if len(begins) and (held or last):
            held.append(tuple(c[:last] for c in part))
            yield joined()
            held = []
        held.append(tuple(c[last:] for c in part))
    if held:
        yield joined()


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__(None)
        self.file, self.start, self.end = file, start, end


class BlockReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split: int, kind: str, whole: bool):
        self.files, self.split, self.kind, self.whole = files, split, kind, whole

    def partitions(self) -> list[Range]:
        return [Range(f, at, min(at + self.split, size)) for f, size in self.files for at in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, path = FileSystem.from_uri(partition.file)

        names = ["file", "part", "nth", "block", *([] if self.whole else ["pos"]), "first", "second"]
        with system.open_input_file(path) as file:
            parts = numbered_parts(file, partition.start, partition.end, LINES[self.kind])
            for nth, block, *columns in whole_blocks(parts) if self.whole else parts:
                if not self.whole:
                    columns[0] = columns[0].astype(np.int32)
                same = [pa.array(np.full(len(nth), partition.start)), pa.array(nth), pa.array(block)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(nth), pa.string()), *same, *map(pa.array, columns)], names)


class BlockSource(DataSource):
    """Options: files (JSON list of URI and size), split (bytes of a range), kind (of LINES), whole (true: a row for each block)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return WHOLE if self.options["whole"] == "true" else SCHEMA

    def reader(self, schema) -> BlockReader:
        if self.options["kind"] not in LINES:
            raise ValueError(f"unknown kind of lines {self.options['kind']}")
        return BlockReader([tuple(f) for f in json.loads(self.options["files"])], int(self.options["split"]), self.options["kind"], self.options["whole"] == "true")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URI and size of the files that a path, a folder or a pattern names, in order; hidden ones are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(conf)
    out, found = [], list(system.globStatus(pattern) or [])
    if not found:
        raise FileNotFoundError(path)
    for status in found:
        for s in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if s.isFile() and not s.getPath().getName().startswith(("_", ".")):
                uri = s.getPath().toUri().toString()
                out.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, s.getLen()))
    return sorted(out)


def _read(spark: SparkSession, files: list[tuple[str, int]], kind: str, split_bytes: int, whole: bool) -> DataFrame:
    if split_bytes < 1:
        raise ValueError("a range has a byte at least")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no module of ours
    spark.dataSource.register(BlockSource)
    return spark.read.format(NAME).option("files", json.dumps(files)).option("split", str(split_bytes)).option("kind", kind).option("whole", str(whole).lower()).load()


def read(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SCHEMA rows of the blocks below a path, a folder or a pattern, in any store that Hadoop lists and pyarrow opens.

    The rows are the same whatever the size of a range. Lines end in a line feed,
    or a carriage return and one; a line of white space alone is blank. Empty files
    have no rows.
    """
    return _read(spark, _files(spark, path), kind, split_bytes, False)


def read_whole(spark: SparkSession, path: str, kind: str, least_bytes: int = SPLIT_BYTES) -> DataFrame:
    """WHOLE rows: what read gives, a row for each block with arrays of its columns, so nothing is gathered by a shuffle.

    A task holds a batch of rows or one block. Ranges hold least_bytes or more, as
    large as leaves every core a few of them, up to SPLIT_BYTES: their number does not
    grow with small ones.
    """
    files = _files(spark, path)
    spread = sum(size for _, size in files) // (4 * max(spark.sparkContext.defaultParallelism, 1))
    return _read(spark, files, kind, max(least_bytes, min(spread, SPLIT_BYTES)), True)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with sent_id: the blocks of each file that have a row, from 0.

    A range knows the order of its own blocks; what comes before it is added up
    from a count for each range, so no window holds a file. The files are read
    twice for it; block orders blocks as well, and needs no second reading.
    """
    sizes = rows.filter("pos = 0").groupBy("file", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")
    return rows.join(sizes.select("file", "part", before.alias("before")), ["file", "part"]).withColumn("sent_id", F.col("before") + F.col("nth"))
