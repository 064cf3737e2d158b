"""Reports of any shape: JSON texts flattened to a row for each value, the newest report of a name chosen by when its file changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Levels of nesting that a report may have.
MOST_LEVELS = 64


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, changed, text) of the text files of a path, a folder or a pattern, each whole."""
    meta = F.col("_metadata")
    return spark.read.text(path, wholetext=True).select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("changed"), F.col("value").alias("text"))


def newest(reports: DataFrame, name: str) -> DataFrame:
    """reports(file, changed, text, name) of which each name keeps the one that changed last, of equally new ones the greatest file."""
    best = reports.groupBy(name).agg(F.max_by(F.struct(*reports.columns), F.struct("changed", "file")).alias("r"))
    return best.select("r.*")


def flattened(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, path, kind, value): every value of each report, by its path: .name of an object, [i] of a list.

    kind is the value's type, value its text; an empty object or list has a row of
    its own without a value, as null has. A text that is not JSON has one row of
    kind INVALID. Reports need no common shape: each level is one pass over what
    is still nested, as many as the deepest report has.
    """
    level = reports.select(F.col(key).alias("of"), F.lit("").alias("path"), F.try_parse_json(text).alias("v"), F.col(text).isNotNull().alias("given"))
    out = level.filter("v is null and given").select("of", "path", F.lit("INVALID").alias("kind"), F.lit(None).cast("string").alias("value"))
    level = level.filter("v is not null").select("of", "path", "v")
    for _ in range(MOST_LEVELS):
        level = cut(level.withColumn("shape", F.schema_of_variant("v")))
        nested = F.col("shape").startswith("OBJECT<") | F.col("shape").startswith("ARRAY<")
        # an empty object or list has a row without a place, so what is empty is told without meeting other rows
        opened = level.filter(nested).lateralJoin(reports.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("at", "name", "inner"))
        inside, empty = opened.filter("at is not null"), opened.filter("at is null").select("of", "path", "v", "shape")
        step = F.when(F.col("shape").startswith("OBJECT<"), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("at").cast("string"), F.lit("]")))
        shape = F.when(F.col("shape") == "VOID", "NULL").when(F.col("shape").startswith("OBJECT<"), "OBJECT").when(F.col("shape").startswith("ARRAY<"), "ARRAY").otherwise(F.regexp_replace("shape", r"\(.*", ""))
        leaves = level.filter(~nested).unionByName(empty)
        out = out.unionByName(leaves.select("of", "path", shape.alias("kind"), F.when(nested, None).otherwise(F.try_variant_get("v", "$", "string")).alias("value")))
        level = inside.select("of", F.concat("path", step).alias("path"), F.col("inner").alias("v"))
        if level.isEmpty():
            return out.withColumnRenamed("of", key)
    raise ValueError(f"a report is nested more than {MOST_LEVELS} levels deep")
