"""Connected components over an edge table, by alternating large-star and small-star.

The driver sees two numbers a round; edges stay in DataFrames, cut in the
shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every node of edges (a, b); component is the smallest node reached.

    Empty edges give an empty table; self links and repeated edges change
    nothing; edges with a null end are dropped.
    """
    edges = cut(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = cut(_small_star(_large_star(edges)), edges)
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct())
