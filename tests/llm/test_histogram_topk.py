import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import histogram_topk as h

SCHEMA = "vec_id long, embedding array<double>, row string, score int"


def brute(rows, step, k):
    """rows: (vec_id, vector), every row by itself."""
    good = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if d is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (q, a) in enumerate(good):
        if q % step == 0:
            s = [(-sum(x * y for x, y in zip(a, b)), d) for j, (d, b) in enumerate(good) if j != i and len(a) == len(b)]
            out += [(q, r + 1, d, -p) for r, (p, d) in enumerate(sorted(s)[:k])]
    return sorted(out)


def check(spark, rows, step=5, k=5, parts=4):
    table = spark.createDataFrame([(d, [None if x is None else float(x) for x in v] if v is not None else None, "x", 1) for d, v in rows], SCHEMA).repartition(parts)
    got = h.top_k(table, F.col("vec_id") % step == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, step, k)


def gauss(n, d, seed=0):
    return [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, d)))]


def test_against_brute_force(spark):
    check(spark, gauss(300, 24))


def test_ties_and_repeated_rows(spark):
    rows = gauss(20, 3)
    check(spark, rows + [(100 + i, [0.5, 0.5, 0.5]) for i in range(60)] + [(7, [1.0, 2.0, 0.1]), (10, rows[10][1]), (10, rows[10][1])])


def test_nulls_lengths_and_scores_of_one_value(spark):
    check(spark, [(0, [1.0, None]), (5, None), (10, []), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (25, [1.0, 2.0]), (26, [0.0, 0.0]), (None, [9.0, 9.0]), (30, [1.0, 2.0, 3.0]), (31, [3.0, 2.0, 1.0]), (35, [0.0, 0.0])])
    check(spark, [(i, [0.0] * 4) for i in range(12)])


def test_fewer_rows_than_k_and_empty(spark):
    check(spark, gauss(3, 2))
    check(spark, [(1, [1.0])])
    check(spark, [])


def test_scores_beyond_doubles(spark):
    check(spark, [(i, [1e5 * (i + 1), -3e5 * i, 7.5]) for i in range(11)])
    rows = [(0, [1e13, 0.0]), (1, [1e14, 0.0]), (2, [1.0, 0.0])]
    table = spark.createDataFrame([(d, v, "x", 1) for d, v in rows], SCHEMA)
    got = h.top_k(table, F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, h.MOST), (2, 256 * 256 * 10**13)]


def test_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_ROWS", 16)
    monkeypatch.setattr(h, "TILE", 200)
    check(spark, gauss(90, 6, 3), step=2)


def test_driver_sees_k_bins_of_a_query(spark):
    rows = h.quantised(spark.createDataFrame([(i, v, "x", 1) for i, v in gauss(500, 8)], SCHEMA).repartition(4))
    queries = rows.filter("vec_id < 7").toPandas()
    block = h.Block(queries.row.to_numpy(), queries.vec_id.to_numpy(), [np.array(x) for x in queries.x])
    low = np.full(7, -(1 << 23))
    found = h._histograms(rows, block, low, -low, np.full(7, 14), np.ones(7, bool), 5).toPandas()
    assert found.groupby("q").size().max() <= 5


@pytest.mark.parametrize("size", [3, 700])
def test_kth_score_is_exact(spark, size):
    rows = h.quantised(spark.createDataFrame([(i, v, "x", 1) for i, v in gauss(size, 8)], SCHEMA))
    q = rows.filter("vec_id = 1").toPandas()
    block = h.Block(q.row.to_numpy(), q.vec_id.to_numpy(), [np.array(q.x[0])])
    kth, above = h.kth_scores(rows, block, np.array([1 << 22]), 5)
    x = np.stack(rows.toPandas().sort_values("vec_id").x.map(np.array))
    s = np.sort(np.delete(x @ np.array(q.x[0]), 1))[::-1]
    assert kth[0] == (s[4] if size > 5 else h._NEVER)
    assert above[0] == ((s > s[4]).sum() if size > 5 else 0)
