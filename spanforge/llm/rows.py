"""A unique, ordered key for each row of a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

KEY = "_row_key"


def keyed(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a unique long key that orders rows as their id does, and the key's name: KEY, or a free name like it.

    The key is the id itself where ids are unique and not null. Otherwise rows
    are sorted by id (nulls first) and text and numbered, and that table is
    written, so that the numbers stay the same when tasks run again.
    """
    key, taken = KEY, {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    ids = docs.select(F.col(id_column).cast("long").alias("i"))
    if ids.groupBy("i").count().filter("count > 1 or i is null").isEmpty():
        return docs.withColumn(key, F.col(id_column).cast("long")), key
    return cut(docs.sort(F.col(id_column).asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn(key, F.monotonically_increasing_id())), key
