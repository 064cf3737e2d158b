"""Queries of latency, energy, multi-run aggregation and reshaping, each with its SQL.

Result grids stand on the driver's star tables: a supplier is a dataset, a part
brand a model, a line number a seed.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import spans
from ..session import table

# Grams of CO2 per kWh by country.
GRID = [("FRA", 52.0), ("DEU", 380.0), ("USA", 380.0), ("GBR", 250.0), ("CHN", 530.0), ("WORLD", 475.0)]
COUNTRY = {"FRANCE": "FRA", "GERMANY": "DEU", "UNITED STATES": "USA", "UNITED KINGDOM": "GBR", "CHINA": "CHN"}
DATASETS, SEEDS = 10, 7


def latency_percentiles(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


def energy_tdp(spark, sf_dir):
    code = F.lit("XXX")
    for name, short in COUNTRY.items():
        code = F.when(F.col("n_name") == name, short).otherwise(code)
    runs = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.energy(runs.select("c_custkey", code.alias("country"), (F.col("c_custkey") % 5000).cast("double").alias("seconds")), spark.createDataFrame(GRID, "country string, factor double"), 105.0)


def _grid(spark, sf_dir):
    """(model, dataset, seed, value): mean discount; a model lacks a dataset that it never met."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % DATASETS).cast("int").alias("dataset"), F.col("l_linenumber").alias("seed"), "l_discount", "l_orderkey")
    rows = rows.filter("not (model = 'R' and dataset = 3)")
    return rows.groupBy("model", "dataset", "seed").agg(F.avg("l_discount").alias("value"))


def mean_std_over_seeds(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("model", "dataset").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("*").alias("seeds"))


def complete_only_mean(spark, sf_dir):
    """Mean over datasets of each model and seed, only where all datasets are there."""
    return _grid(spark, sf_dir).groupBy("model", "seed").agg(F.count("dataset").alias("n"), F.round(F.avg("value"), 6).alias("mean")).filter(F.col("n") == DATASETS)


def available_mean(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("model", "seed").agg(F.round(F.avg("value"), 6).alias("mean"))


def common_dataset_mean(spark, sf_dir):
    """Mean per model over the datasets that every model has."""
    cells = _grid(spark, sf_dir).groupBy("model", "dataset").agg(F.avg("value").alias("value"))
    models = cells.agg(F.count_distinct("model").alias("m"))
    common = cells.groupBy("dataset").agg(F.count_distinct("model").alias("k")).crossJoin(F.broadcast(models)).filter("k = m").select("dataset")
    return cells.join(F.broadcast(common), "dataset").groupBy("model").agg(F.round(F.avg("value"), 6).alias("mean"))


def two_level_means(spark, sf_dir):
    """Cells and per-model averages in one pass by grouping sets."""
    _grid(spark, sf_dir).createOrReplaceTempView("_grid_cells")
    return spark.sql("SELECT model, dataset, round(avg(value), 6) AS mean FROM _grid_cells GROUP BY GROUPING SETS ((model, dataset), (model))")


def pivot_models(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("dataset").pivot("model", ["A", "N", "R"]).agg(F.round(F.avg("value"), 6)).toDF("dataset", "m_a", "m_n", "m_r")


def unpivot_models(spark, sf_dir):
    return pivot_models(spark, sf_dir).unpivot("dataset", ["m_a", "m_n", "m_r"], "model", "value").filter("value is not null")


def best_column(spark, sf_dir):
    """The first column of the largest value in each row."""
    values = F.array("m_a", "m_n", "m_r")
    names = F.array(*map(F.lit, ["m_a", "m_n", "m_r"]))
    return pivot_models(spark, sf_dir).select("dataset", F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")).alias("best"), F.array_max(values).alias("value"))


def delta_vs_reference(spark, sf_dir):
    return pivot_models(spark, sf_dir).select("dataset", F.round(F.col("m_n") - F.col("m_a"), 6).alias("delta_n"), F.round(F.col("m_r") - F.col("m_a"), 6).alias("delta_r"))


def gap_analysis(spark, sf_dir):
    """Gap of two models on each half of the datasets."""
    wide = pivot_models(spark, sf_dir).withColumn("half", F.when(F.col("dataset") < 5, "low").otherwise("high"))
    return wide.groupBy("half").agg(F.round(F.avg(F.col("m_a") - F.col("m_n")), 6).alias("gap"))


def latest_per_key(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "event_id", "event_type")


def merge_last_wins(spark, sf_dir):
    """Union of two sources by key; the later source wins."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), F.lit(0).alias("source"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(1).alias("source")).filter("key % 3 = 0")
    return old.unionByName(new).groupBy("key").agg(F.max(F.struct("source", "value")).alias("m")).select("key", "m.source", "m.value")


def resume_todo(spark, sf_dir):
    """What has no finished urgent order yet."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def declared_labels_only(spark, sf_dir):
    """Semi join: documents with a label of quality 1; the others are counted by an anti join."""
    docs, good = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1")
    kept = docs.join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("kept"))
    left = docs.join(good, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("dropped"))
    return kept.join(left, "lang", "full_outer").na.fill(0)


def entity_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def nested_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent_id"), (F.col("l_partkey") % 9).alias("start_off"), (F.col("l_partkey") % 9 + F.col("l_linenumber")).alias("end_off"), F.col("l_returnflag").alias("label"))
    return spans.nest(rows, ["sent_id"]).select("sent_id", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start_off"], s["end_off"], s["label"])), ",").alias("spans"))


def first_n_kept(spark, sf_dir):
    """The first n non-blank documents of each language, in file order, by a windowed cap after the filter."""
    kept = table(spark, sf_dir, "documents").filter("n_chars > 1000")
    order = Window.partitionBy("lang").orderBy("doc_id")
    return kept.withColumn("r", F.row_number().over(order)).filter("r <= 50").select("lang", "doc_id", "r")


def bracket_pairing(spark, sf_dir):
    """As-of pairing: each close takes the latest open of its user before it; of several closes the first."""
    kind = F.when(F.col("event_id") % 3 == 0, "open").otherwise("close")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    opened = F.last(F.when(F.col("kind") == "open", F.col("event_id")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    closes = events.withColumn("open_id", opened).filter("kind = 'close' and open_id is not null")
    return closes.groupBy("user_id", "open_id").agg(F.min("event_id").alias("close_id"))


def bootstrap_ci(spark, sf_dir):
    """Mean, deviation and percentile interval of AMI and macro-F1 over resamples of the typed pairs."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gold"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("pred"))
    return metrics.bootstrap(pairs, 1000, 42)


QUERIES = {f.__name__: f for f in (latency_percentiles, energy_tdp, mean_std_over_seeds, complete_only_mean, available_mean, common_dataset_mean, two_level_means, pivot_models, unpivot_models, best_column, delta_vs_reference, gap_analysis, latest_per_key, merge_last_wins, resume_todo, declared_labels_only, entity_distribution, nested_spans, first_n_kept, bracket_pairing, bootstrap_ci)}
_GRID = f"g AS (SELECT l_returnflag AS model, CAST(l_suppkey % {DATASETS} AS INTEGER) AS dataset, l_linenumber AS seed, avg(l_discount) AS value FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_suppkey % {DATASETS} = 3) GROUP BY ALL)"
_WIDE = _GRID + ", w AS (SELECT dataset, round(avg(CASE WHEN model = 'A' THEN value END), 6) AS m_a, round(avg(CASE WHEN model = 'N' THEN value END), 6) AS m_n, round(avg(CASE WHEN model = 'R' THEN value END), 6) AS m_r FROM g GROUP BY dataset)"
ORACLES = {
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(sum(value) / 1000, 6) AS total_s, round(count(value) * 1000.0 / sum(value), 6) AS per_s FROM events GROUP BY event_type",
    "energy_tdp": "WITH r AS (SELECT c_custkey, CASE n_name " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in COUNTRY.items()) + " ELSE 'XXX' END AS country, CAST(c_custkey % 5000 AS DOUBLE) AS seconds FROM customer JOIN nation ON c_nationkey = n_nationkey), f(country, factor) AS (VALUES " + ", ".join(f"('{c}', {v}::DOUBLE)" for c, v in GRID) + ") SELECT c_custkey, r.country, seconds, round(seconds * 105.0 / 3.6e6, 9) AS kwh, round(seconds * 105.0 / 3.6e6 * coalesce(factor, 475.0), 9) AS grams FROM r LEFT JOIN f ON r.country = f.country",
    "mean_std_over_seeds": f"WITH {_GRID} SELECT model, dataset, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS seeds FROM g GROUP BY model, dataset",
    "complete_only_mean": f"WITH {_GRID} SELECT model, seed, count(dataset) AS n, round(avg(value), 6) AS mean FROM g GROUP BY model, seed HAVING count(dataset) = {DATASETS}",
    "available_mean": f"WITH {_GRID} SELECT model, seed, round(avg(value), 6) AS mean FROM g GROUP BY model, seed",
    "common_dataset_mean": f"WITH {_GRID}, c AS (SELECT model, dataset, avg(value) AS value FROM g GROUP BY ALL), k AS (SELECT dataset FROM c GROUP BY dataset HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM c)) SELECT model, round(avg(value), 6) AS mean FROM c JOIN k USING (dataset) GROUP BY model",
    "two_level_means": f"WITH {_GRID} SELECT model, dataset, round(avg(value), 6) AS mean FROM g GROUP BY model, dataset UNION ALL SELECT model, NULL, round(avg(value), 6) FROM g GROUP BY model",
    "pivot_models": f"WITH {_WIDE} SELECT * FROM w",
    "unpivot_models": f"WITH {_WIDE} SELECT dataset, 'm_a' AS model, m_a AS value FROM w WHERE m_a IS NOT NULL UNION ALL SELECT dataset, 'm_n', m_n FROM w WHERE m_n IS NOT NULL UNION ALL SELECT dataset, 'm_r', m_r FROM w WHERE m_r IS NOT NULL",
    "best_column": f"WITH {_WIDE} SELECT dataset, CASE WHEN m_a >= coalesce(m_n, -1) AND m_a >= coalesce(m_r, -1) THEN 'm_a' WHEN m_n >= coalesce(m_r, -1) THEN 'm_n' ELSE 'm_r' END AS best, greatest(m_a, m_n, m_r) AS value FROM w",
    "delta_vs_reference": f"WITH {_WIDE} SELECT dataset, round(m_n - m_a, 6) AS delta_n, round(m_r - m_a, 6) AS delta_r FROM w",
    "gap_analysis": f"WITH {_WIDE} SELECT CASE WHEN dataset < 5 THEN 'low' ELSE 'high' END AS half, round(avg(m_a - m_n), 6) AS gap FROM w GROUP BY 1",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "merge_last_wins": "WITH u AS (SELECT o_custkey AS key, o_orderstatus AS value, 0 AS source FROM orders UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE c_custkey % 3 = 0) SELECT key, source, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source DESC, value DESC) AS r FROM u) WHERE r = 1",
    "resume_todo": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    "declared_labels_only": "SELECT lang, count(CASE WHEN ok THEN 1 END) AS kept, count(CASE WHEN NOT ok THEN 1 END) AS dropped FROM (SELECT lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS ok FROM documents) GROUP BY lang",
    "entity_distribution": "SELECT p_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY p_type",
    "nested_spans": "WITH r AS (SELECT l_orderkey AS sent_id, l_partkey % 9 AS s, l_partkey % 9 + l_linenumber AS e, l_returnflag AS label FROM lineitem) SELECT sent_id, string_agg(s || ':' || e || ':' || label, ',' ORDER BY s, e, label) AS spans FROM r GROUP BY sent_id",
    "first_n_kept": "SELECT lang, doc_id, CAST(r AS INTEGER) AS r FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars > 1000) WHERE r <= 50",
    "bracket_pairing": "WITH e AS (SELECT user_id, event_id, event_id % 3 = 0 AS opens FROM events), o AS (SELECT *, max(CASE WHEN opens THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_id FROM e) SELECT user_id, open_id, min(event_id) AS close_id FROM o WHERE NOT opens AND open_id IS NOT NULL GROUP BY user_id, open_id",
}
