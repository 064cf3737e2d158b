"""Results that outlive a run: each key's rows are kept under the digest of what they were made from, and made again only if that changes.

Rows are written to a working folder and come into being under their key by one
rename, so a run that is killed leaves whole results and none in part. Two runs of
one store may meet: the first to rename wins, and both give the same rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame, *parameters: object) -> str:
    """Of the rows as a multiset, their columns and the parameters: one aggregation, in whatever order the rows lie."""
    columns = sorted(rows.columns)
    hashes = [F.xxhash64(F.lit(s), *[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)") for s in (1, 2)]
    found = rows.agg(F.count("*"), *[F.sum(h) for h in hashes]).first()
    kinds = [(f.name, f.dataType.simpleString()) for f in sorted(rows.schema.fields, key=lambda f: f.name)]
    return hashlib.sha256(repr((kinds, tuple(map(str, found)), parameters)).encode()).hexdigest()


@dataclass
class Progress:
    """Keys by what became of them in a run."""

    computed: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    crashed: dict[str, str] = field(default_factory=dict)


class Results:
    """A store of results below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda *parts: hadoop("/".join([self.path, *parts]))
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict[str, str]:
        """The digest that each key's rows are kept under."""
        if not self._files.exists(self._at()):
            return {}
        out = {}
        for key in self._files.listStatus(self._at()):
            if m := re.fullmatch(r"key=([0-9a-f]*)", key.getPath().getName()):
                for made in self._files.listStatus(key.getPath()):
                    out[bytes.fromhex(m[1]).decode()] = made.getPath().getName()
        return out

    def _folder(self, key: str, made: str) -> tuple[str, str]:
        return f"key={key.encode().hex()}", made

    def commit(self, key: str, made: str, rows: DataFrame) -> None:
        """Keep rows as the key's, and forget what an earlier digest made."""
        work = f"_work-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{work}")
            folder = self._folder(key, made)
            self._files.mkdirs(self._at(folder[0]))
            if not self._files.exists(self._at(*folder)):
                self._files.rename(self._at(work), self._at(*folder))
            for other in self._files.listStatus(self._at(folder[0])):
                if other.getPath().getName() != made:
                    self._files.delete(other.getPath(), True)
        finally:
            self._files.delete(self._at(work), True)

    def run(self, inputs: dict[str, DataFrame], compute: Callable[[str, DataFrame], DataFrame], *parameters: object, go_on: bool = False) -> Progress:
        """Make what is absent: compute(key, rows) of each key whose rows or parameters are not those that its result was made from.

        An error ends the run, with all keys before it kept; with go_on it is noted
        and the other keys are made.
        """
        there, progress = self.manifest(), Progress()
        for key, rows in inputs.items():
            made = digest(rows, *parameters)
            if there.get(key) == made:
                progress.reused.append(key)
                continue
            try:
                self.commit(key, made, compute(key, rows))
                progress.computed.append(key)
            except Exception as error:
                if not go_on:
                    raise
                progress.crashed[key] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        return progress

    def read(self, schema: str) -> DataFrame:
        """The kept rows of all keys, with their key; schema is that of the results."""
        paths = [f"{self.path}/" + "/".join(self._folder(k, d)) for k, d in self.manifest().items()]
        if not paths:
            return self.spark.createDataFrame([], f"key string, {schema}")
        rows = self.spark.read.schema(schema).parquet(*paths)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/key=([0-9a-f]*)/", 1)
        return rows.select(F.decode(F.unhex(name), "utf-8").alias("key"), *rows.columns)


def cached(spark: SparkSession, path: str, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], *parameters: object) -> DataFrame:
    """What compute makes of rows, made once for each digest of the rows and parameters: a cache of triplets and the like."""
    store, made = Results(spark, path), digest(rows, *parameters)
    if store.manifest().get("cached") != made:
        store.commit("cached", made, compute(rows))
    return spark.read.parquet(f"{path.rstrip('/')}/" + "/".join(store._folder("cached", made)))
