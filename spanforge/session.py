"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "spanforge.shipped"


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application.

    Arrow batches of Spark's default size hold 10,000 rows; of whole documents
    that is too much for a small executor, so the default, and only that, is
    lowered.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    done = getattr(sc, "_spanforge_shipped", False)
    if done:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="spanforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"spanforge/{p.relative_to(root)}")
    sc.addPyFile(name)
    sc._spanforge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a master on this machine alone gets one of our own, as in
    tests; on a cluster that is an error, as executors cannot share a local folder.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(conf or f"file://{tempfile.mkdtemp(prefix='spanforge-ckpt-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/spanforge-{name}-{uuid.uuid4().hex}"
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


#: Spark's own switch: the shuffles of a query go when it ends.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The rows of df written as Parquet in the shared folder: lineage ends here and survives lost executors.

    Shuffles that only made them go when they are written. Tables of earlier
    cuts given as done, which nothing but df needed, are deleted then.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanforge_cut = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the written tables of cuts that nothing reads any more; other frames are left alone."""
    for t in tables:
        path = getattr(t, "_spanforge_cut", None)
        if path:
            at, files = _file_system(t.sparkSession, path)
            files.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
