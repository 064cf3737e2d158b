"""A bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: tuple[int, int] | int) -> DataFrame:
    """(doc_id, text, y) of at most `most` rows of labels outside the held-out fold (or so many of label 0 and of 1), least hash first.

    Labels that are null or neither 0 nor 1 are left out, as are labels without a document.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    rows = rows.filter("doc_id is not null and y in (0, 1)").filter(~held_out("doc_id", modulus, remainder))
    order = (F.xxhash64("doc_id"), "doc_id", "y")
    if isinstance(most, int):
        rows = rows.orderBy(*order).limit(most)
    else:
        rows = rows.filter("y = 0").orderBy(*order).limit(most[0]).unionByName(rows.filter("y = 1").orderBy(*order).limit(most[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "y")
