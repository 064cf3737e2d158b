"""Queries of the benchmark harness: whole reports, variants, sweeps, splits, and comparisons of heads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import gmm, linear, triplets, vectors
from ..session import cut, table
from .scoring import _C, _G, _OPEN, _P, _PRF, _T, _V, BETAS, DECLARED, PARTS, _detected, _ll, _open_world, _pairs, _sims, _test, _train, _typed, _vectors


def open_world_report(spark, sf_dir):
    return metrics.open_report(_open_world(spark, sf_dir), DECLARED)


def open_world_confusion(spark, sf_dir):
    return metrics.open_confusion(_open_world(spark, sf_dir).select("gold", "pred"), DECLARED)


def error_diagnosis(spark, sf_dir):
    return metrics.diagnosis(_pairs(spark, sf_dir)).withColumn("bias", F.when(F.col("bias") == float("inf"), -1.0).otherwise(F.col("bias")))


def ood_thresholds_assigned(spark, sf_dir):
    """Thresholds of the points that each label wins, without their labels."""
    ll = _ll(spark, sf_dir, _train(spark, sf_dir).withColumnRenamed("label", "gold"))
    return gmm.assigned_thresholds(ll, "vec_id").select("label", F.round("threshold", 4).alias("threshold"))


def beta_sweep_transductive(spark, sf_dir):
    """Accuracy at each fusion weight after one refinement of the prototypes by all test vectors."""
    protos = vectors.refine(_test(spark, sf_dir), vectors.centroids(_train(spark, sf_dir)), 1)
    sims = vectors.similarities(_test(spark, sf_dir), protos, ["vec_id", "gold"])
    betas = F.broadcast(spark.createDataFrame([(b,) for b in BETAS], "beta double"))
    fused = vectors.fuse(_detected(spark, sf_dir, sims).crossJoin(betas), F.col("beta"))
    return metrics.accuracy(vectors.best_label(fused, ["beta", "vec_id"]).withColumn("pred", F.col("label")), ["beta"])


def _prototypes(spark, sf_dir) -> dict[str, DataFrame]:
    """Prototypes by mode; parts of a label, dealt by id, stand for its anchors."""
    train = _train(spark, sf_dir)
    part = F.concat_ws("#", "label", F.floor(F.col("vec_id") / 5) % PARTS)
    parts = vectors.centroids(train.select(part.alias("label"), "vec")).withColumn("label", F.substring_index("label", "#", 1))
    raw = table(spark, sf_dir, "embeddings").filter("vec_id % 5 <> 0").select(F.col("label").cast("string").alias("label"), vectors.doubles("embedding").alias("vec"))
    return {"raw": vectors.centroids(raw), "context": vectors.centroids(train), "ensemble": vectors.centroids(parts), "multi": parts}


def zs_variants(spark, sf_dir):
    """(variant, ami, accuracy, macro_f1) of every zero-shot variant."""
    typed = cut(vectors.variants(_test(spark, sf_dir), _prototypes(spark, sf_dir), "vec_id"))
    by = ["variant"]
    table_ = metrics.cells(typed, by)
    return metrics.ami(table_, by).join(metrics.accuracy(table_, by), by).join(metrics.macro_f1(table_, by), by)


def stratified_split(spark, sf_dir):
    """A fifth of each label is held out."""
    return linear.hold_out(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("gold").alias("label")), 0.2, "42").select(F.col("id").alias("vec_id"), "label", "held_out")


def head_comparison(spark, sf_dir):
    """(head, ami, accuracy, macro_f1) of five heads on one split."""
    train, test = cut(_train(spark, sf_dir)), cut(_test(spark, sf_dir))
    ll = gmm.log_likelihood(test, gmm.diagonal(train), ["vec_id", "gold"]).withColumnRenamed("ll", "sim")
    heads = {
        "centroid": _typed(spark, sf_dir),
        "knn": vectors.knn(train, test).join(test.select("vec_id", "gold"), "vec_id"),
        "gmm": vectors.best_label(ll, ["vec_id"]).withColumn("pred", F.col("label")),
        "svc": linear.squared_hinge(train, test, balanced=True),
        "logistic": linear.logistic(train, test, balanced=True),
    }
    every = reduce(DataFrame.unionByName, [rows.select(F.lit(head).alias("head"), "gold", "pred") for head, rows in heads.items()])
    cells, by = metrics.cells(every, ["head"]), ["head"]
    return metrics.ami(cells, by).join(metrics.accuracy(cells, by), by).join(metrics.macro_f1(cells, by), by)


def gmm_full_pca(spark, sf_dir):
    """Full-covariance Gaussians over the 16 leading components."""
    train = _train(spark, sf_dir)
    mean, components, _ = vectors.principal(train, 16)
    params = gmm.full(vectors.project(train, mean, components))
    scored = gmm.full_log_likelihood(vectors.project(_test(spark, sf_dir), mean, components), params, ["vec_id", "gold"])
    return vectors.best_label(scored.withColumnRenamed("ll", "sim"), ["vec_id"]).select("vec_id", "gold", F.col("label").alias("pred"))


def pca_variances(spark, sf_dir):
    """The variance along each of the 50 leading components, and its share of all 50."""
    _, _, variances = vectors.principal(_train(spark, sf_dir), 50)
    total = float(sum(variances))
    return spark.createDataFrame([(i, round(float(v), 6), round(float(v) / total, 6)) for i, v in enumerate(variances)], "component int, variance double, share double")


def _entities(spark, sf_dir):
    """Lines as entities of an order's document, their status as type."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 100 + place).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label"))


def entity_label_triplets(spark, sf_dir):
    return triplets.entity_triplets(_entities(spark, sf_dir), "42")[0]


def entity_entity_triplets(spark, sf_dir):
    return triplets.entity_triplets(_entities(spark, sf_dir), "42")[1]


def hard_easy_mix(spark, sf_dir):
    """A training set of at most 300 triplets, three fifths of them hard; the size is the mix's own."""
    typed = _typed(spark, sf_dir)
    errors = typed.filter("gold <> pred").select(F.col("vec_id").alias("id"), "gold", "pred")
    hard = triplets.hard_negatives(errors, _train(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), seed="42")
    easy = triplets.sample(typed.filter("gold = pred").select(F.col("vec_id").alias("id"), F.col("gold").alias("label")), per_anchor=1, seed="42")
    return triplets.mix(hard, easy, 300, 0.6, "42").groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (open_world_report, open_world_confusion, error_diagnosis, ood_thresholds_assigned, beta_sweep_transductive, zs_variants, stratified_split, head_comparison, gmm_full_pca, pca_variances, entity_label_triplets, entity_entity_triplets, hard_easy_mix)}

_D7 = tuple(DECLARED)
_OW = f"""{_OPEN}, w AS MATERIALIZED (SELECT o.gold, CASE WHEN is_ood THEN 'OOD' ELSE o.label END AS pred, o.label AS best, ll.ll FROM ood o JOIN ll ON ll.vec_id = o.vec_id AND ll.label = o.label),
d(label) AS (VALUES {", ".join(f"('{x}')" for x in DECLARED)}), held AS (SELECT * FROM w WHERE gold IN {_D7})"""
_N = lambda x: f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"
_E5 = "e AS MATERIALIZED (SELECT l_orderkey AS doc, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_returnflag || l_linestatus AS label FROM lineitem), al AS (SELECT list(DISTINCT label ORDER BY label) AS labels FROM e)"
_R1 = "rm AS (SELECT t.pred AS label, v.pos, avg(v.x) AS m FROM typed t JOIN v USING (vec_id) GROUP BY ALL), rn AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM rm GROUP BY label), rc AS (SELECT c.label, c.pos, coalesce(m / n, c.x) AS x FROM c LEFT JOIN rm ON rm.label = c.label AND rm.pos = c.pos LEFT JOIN rn ON rn.label = c.label), s2 AS (SELECT v.vec_id, v.gold, rc.label, sum(v.x * rc.x) AS sim FROM v JOIN rc ON v.pos = rc.pos WHERE v.vec_id % 5 = 0 GROUP BY ALL)"
ORACLES = {
    "open_world_report": f"""WITH {_OW},
        pl AS (SELECT label AS name, (SELECT count(*) FROM held WHERE gold = label) AS s, (SELECT count(*) FROM held WHERE pred = label) AS p, (SELECT count(*) FROM held WHERE gold = label AND pred = label) AS tp FROM d),
        pf AS (SELECT *, round(coalesce(tp / nullif(p, 0)::DOUBLE, 0), 6) AS pr, round(coalesce(tp / nullif(s, 0)::DOUBLE, 0), 6) AS re, round(coalesce(2 * tp / nullif(s + p, 0)::DOUBLE, 0), 6) AS f1 FROM pl),
        tt AS (SELECT sum(tp) AS tp, sum(p) AS p, sum(s) AS s, round(avg(f1), 6) AS macro FROM pf),
        wh AS (SELECT count(*) AS n, count(CASE WHEN gold IN {_D7} THEN 1 END) AS n_in, count(CASE WHEN gold IN {_D7} AND gold = pred THEN 1 END) AS r, count(CASE WHEN gold IN {_D7} AND gold = best THEN 1 END) AS rb, count(CASE WHEN pred = 'OOD' THEN 1 END) AS o FROM w),
        uk AS (SELECT gold, count(*) AS n, count(CASE WHEN pred = 'OOD' THEN 1 END) AS o FROM w WHERE gold NOT IN {_D7} GROUP BY gold),
        cg AS (SELECT g.gold, p.pred, (SELECT count(*) FROM w WHERE w.gold = g.gold AND w.pred = p.pred) AS n FROM (SELECT label AS gold FROM d UNION SELECT gold FROM w) g, (SELECT label AS pred FROM d UNION ALL SELECT 'OOD') p),
        sp AS (SELECT gold, min(ll) AS a, quantile_cont(ll, 0.05) AS b, quantile_cont(ll, 0.5) AS c, quantile_cont(ll, 0.95) AS e, max(ll) AS f FROM w GROUP BY gold)
        SELECT 'label' AS section, name, unnest(['support', 'tp', 'fp', 'fn', 'precision', 'recall', 'f1']) AS metric, unnest([s::DOUBLE, tp, p - tp, s - tp, pr, re, f1]) AS value FROM pf
        UNION ALL SELECT 'total', 'all', unnest(['n_eval_spans', 'n_in_schema_spans', 'accuracy_in_schema', 'accuracy_best_in_schema', 'ood_rate', 'micro_precision', 'micro_recall', 'micro_f1', 'macro_f1']), unnest([n::DOUBLE, n_in, round(r / n_in, 6), round(rb / n_in, 6), round(o / n, 6), round(coalesce(tp / nullif(p, 0)::DOUBLE, 0), 6), round(tp / s::DOUBLE, 6), round(2 * tp / (p + s)::DOUBLE, 6), macro]) FROM wh, tt
        UNION ALL SELECT 'unknown', gold, unnest(['support', 'n_detected_ood', 'recall']), unnest([n::DOUBLE, o, round(o / n, 6)]) FROM uk
        UNION ALL SELECT 'confusion', gold, pred, n::DOUBLE FROM cg
        UNION ALL SELECT 'loglik', gold, unnest(['min', 'p05', 'median', 'p95', 'max']), unnest([round(a, 4), round(b, 4), round(c, 4), round(e, 4), round(f, 4)]) FROM sp""",
    "open_world_confusion": f"WITH {_OW} SELECT g.gold, p.pred, (SELECT count(*) FROM w WHERE w.gold = g.gold AND w.pred = p.pred) AS n FROM (SELECT label AS gold FROM d UNION SELECT gold FROM w) g, (SELECT label AS pred FROM d UNION ALL SELECT 'OOD') p",
    "error_diagnosis": f"WITH {_P}, {_PRF}, k AS (SELECT gold, pred, count(*) AS n FROM pairs WHERE gold <> pred GROUP BY ALL), kr AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY n DESC, pred) AS r FROM k), m AS (SELECT gold AS label, string_agg(pred || ':' || n, ' ' ORDER BY r) AS taken_for FROM kr WHERE r <= 3 GROUP BY gold) SELECT pr.label, support, predicted, tp, fp, fn, precision, recall, f1, coalesce(taken_for, '') AS taken_for, CASE WHEN support = 0 AND predicted > 0 THEN -1.0 ELSE round(coalesce(predicted / nullif(support, 0)::DOUBLE, 0), 6) END AS bias, round(support / (SELECT count(*) FROM pairs)::DOUBLE, 6) AS gold_share, round(predicted / (SELECT count(*) FROM pairs)::DOUBLE, 6) AS pred_share FROM pr LEFT JOIN m ON m.label = pr.label",
    "ood_thresholds_assigned": f"WITH {_G}, rk AS (SELECT label, ll, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll, 4) DESC, label) AS r FROM ll WHERE vec_id % 5 <> 0) SELECT label, round(coalesce(quantile_cont(CASE WHEN r = 1 THEN ll END, 0.05), quantile_cont(ll, 0.05)), 4) AS threshold FROM rk GROUP BY label",
    "beta_sweep_transductive": f"WITH {_T}, {_R1}, bs(beta) AS (VALUES {', '.join(f'({b}::DOUBLE)' for b in BETAS)}), f AS (SELECT *, row_number() OVER (PARTITION BY beta, vec_id ORDER BY round(sim + CASE WHEN label = CAST((vec_id * 7 + 3) % 10 AS VARCHAR) THEN beta * ((vec_id * 13) % 101) / 100.0 ELSE 0 END, 6) DESC, label) AS r FROM s2, bs) SELECT beta, round(avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f WHERE r = 1 GROUP BY beta",
    "stratified_split": "WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings) SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'), vec_id) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS held_out FROM e",
    "entity_label_triplets": f"""WITH {_E5}, ow AS (SELECT doc, list(DISTINCT label ORDER BY label) AS own FROM e GROUP BY doc),
        r AS (SELECT e.id, e.label, k AS rank, list_filter(own, lambda x: x <> e.label) AS near, list_filter(labels, lambda x: x <> e.label) AS far FROM e JOIN ow ON ow.doc = e.doc CROSS JOIN al CROSS JOIN (VALUES (1), (2)) ks(k)),
        o AS (SELECT *, CASE WHEN len(near) > 0 AND {_N("id || '|' || rank || '|d42'")} / 4294967296.0::DOUBLE < 0.5 THEN near ELSE far END AS others FROM r)
        SELECT id AS anchor, rank, label AS positive, others[{_N("id || '|' || rank || '|n42'")} % len(others) + 1] AS negative FROM o""",
    "entity_entity_triplets": "",
    "hard_easy_mix": f"WITH {_T}, er AS (SELECT pred, gold FROM typed WHERE gold <> pred), po AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1), h AS (SELECT coalesce(sum(least(3, a.n, b.n)), 0)::BIGINT AS n FROM er JOIN po a ON a.label = gold JOIN po b ON b.label = pred), g AS (SELECT gold, count(*) AS n FROM typed WHERE gold = pred GROUP BY gold), ea AS (SELECT coalesce(sum(CASE WHEN n > 1 AND (SELECT count(*) FROM g) > 1 THEN n END), 0)::BIGINT AS n FROM g) SELECT kind, n FROM (SELECT 'hard' AS kind, least(h.n, 180) AS n FROM h UNION ALL SELECT 'easy', least(ea.n, 300 - least(h.n, 180)) FROM h, ea) WHERE n > 0",
}
_PLACES = lambda e, seed: f"pl AS MATERIALIZED (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|{seed}'), id) - 1 AS place FROM {e}), sz AS (SELECT label, count(*) AS size FROM {e} GROUP BY label), sl AS (SELECT list(label ORDER BY label) AS labels FROM sz)"


def _sampled(e: str, seed: str, per_anchor: int) -> str:
    """tr(anchor, positive, negative, rank): the seeded places of triplets.sample, by definition."""
    return f"""{_PLACES(e, seed)},
        tr AS MATERIALIZED (SELECT a.id AS anchor, p.id AS positive, n.id AS negative, CAST(a.rank AS INTEGER) AS rank FROM
            (SELECT pl.id, pl.label, size, (place + k) % size AS at, k AS rank, list_filter(labels, lambda x: x <> pl.label)[{_N(f"pl.id || '|' || k || '|l{seed}'")} % (len(labels) - 1) + 1] AS other FROM pl JOIN sz ON sz.label = pl.label CROSS JOIN sl CROSS JOIN (SELECT unnest(range(1, {per_anchor + 1})) AS k) ks WHERE k < size AND len(labels) > 1) a
            JOIN pl p ON p.label = a.label AND p.place = a.at JOIN sz ON sz.label = a.other JOIN pl n ON n.label = a.other AND n.place = {_N(f"a.id || '|' || a.rank || '|n{seed}'")} % sz.size)"""


_EV = "e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label FROM embeddings)"
ORACLES["entity_entity_triplets"] = f"WITH {_E5}, {_sampled('e', '42', 1)} SELECT anchor, positive, negative FROM tr WHERE {_N("anchor || '|e42'")} / 4294967296.0::DOUBLE < 0.3"
ORACLES["triplets_hash_seeded"] = f"WITH {_EV}, {_sampled('e', '42', 2)} SELECT anchor, positive, negative, rank FROM tr"
ORACLES["triplet_loss"] = f"WITH {_V}, {_EV}, {_sampled('e', '1', 1)}, vm AS MATERIALIZED (SELECT vec_id, list(x ORDER BY pos) AS xs FROM v GROUP BY vec_id), ds AS (SELECT list_distance(a.xs, p.xs) AS dp, list_distance(a.xs, n.xs) AS dn FROM tr JOIN vm a ON a.vec_id = anchor JOIN vm p ON p.vec_id = positive JOIN vm n ON n.vec_id = negative) SELECT count(*) AS n, round(avg(greatest(0, dp - dn + 1)), 6) AS mean_loss FROM ds"
ORACLES["label_anchored_triplets"] = f"WITH {_EV}, l AS (SELECT list(DISTINCT label ORDER BY label) AS labels FROM e), o AS (SELECT id, label, list_filter(labels, lambda x: x <> e.label) AS others FROM e, l) SELECT id AS anchor, label AS positive, others[{_N("id || '|n7'")} % len(others) + 1] AS negative FROM o"
ORACLES["hard_negative_pairs"] = f"""WITH {_T}, po AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label FROM embeddings WHERE vec_id % 5 <> 0), {_PLACES('po', '42')},
        er AS (SELECT vec_id AS id, gold, pred, g.size AS gs, p.size AS ps, k FROM typed JOIN sz g ON g.label = gold JOIN sz p ON p.label = pred CROSS JOIN (SELECT unnest(range(1, 4)) AS k) ks WHERE gold <> pred AND k <= g.size AND k <= p.size)
        SELECT er.id AS anchor, a.id AS positive, b.id AS negative, CAST(k AS INTEGER) AS rank FROM er JOIN pl a ON a.label = gold AND a.place = ({_N("er.id || '|p42'")} + k - 1) % gs JOIN pl b ON b.label = pred AND b.place = ({_N("er.id || '|n42'")} + k - 1) % ps"""
