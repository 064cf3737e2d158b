"""Queries of vector functions, typing heads and metrics over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import align, gmm, linear, triplets, vectors
from ..session import table

BETAS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0]
THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.5]
PARTS = 8
LEAST_INCLUDED = 0.45
DECLARED = ["0", "1", "2", "3", "4", "5", "6"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("gold"), vectors.l2_normalize(vectors.doubles("embedding")).alias("vec"))


def _train(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("vec_id % 5 <> 0").withColumnRenamed("gold", "label")


def _test(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("vec_id % 5 = 0")


def _sims(spark, sf_dir):
    return vectors.similarities(_test(spark, sf_dir), vectors.centroids(_train(spark, sf_dir)), ["vec_id", "gold"])


def _typed(spark, sf_dir):
    return vectors.best_label(_sims(spark, sf_dir), ["vec_id", "gold"]).select("vec_id", "gold", F.col("label").alias("pred"))


def _detected(spark, sf_dir, sims=None):
    """A stand-in detector's candidate and score by rule."""
    cand = F.pmod(F.col("vec_id") * 7 + 3, F.lit(10)).cast("string")
    return (_sims(spark, sf_dir) if sims is None else sims).withColumn("cand_label", cand).withColumn("score", F.pmod(F.col("vec_id") * 13, F.lit(101)) / 100.0)


def l2_normalize(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode("vec").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def matryoshka_truncate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.truncate(vectors.doubles("embedding"), 16).alias("vec"))
    return rows.select("vec_id", F.posexplode("vec").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def label_centroids(spark, sf_dir):
    return vectors.centroids(_train(spark, sf_dir)).select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def cosine_matrix(spark, sf_dir):
    return _sims(spark, sf_dir).select("vec_id", "label", F.round("sim", 6).alias("sim"))


def multi_proto_maxsim(spark, sf_dir):
    """Each label has PARTS prototypes, the centroids of its training vectors dealt by id."""
    part = F.concat_ws("#", "label", F.floor(F.col("vec_id") / 5) % PARTS)
    protos = vectors.centroids(_train(spark, sf_dir).select(part.alias("label"), "vec")).withColumn("label", F.substring_index("label", "#", 1))
    return vectors.similarities(_test(spark, sf_dir), protos, ["vec_id"]).select("vec_id", "label", F.round("sim", 6).alias("sim"))


def class_calibration(spark, sf_dir):
    return vectors.calibrate(_sims(spark, sf_dir)).select("vec_id", "label", F.round("sim", 6).alias("sim"))


def nearest_centroid(spark, sf_dir):
    return _typed(spark, sf_dir)


def _refined(spark, sf_dir, rounds):
    protos = vectors.refine(_test(spark, sf_dir), vectors.centroids(_train(spark, sf_dir)), rounds)
    return vectors.best_label(vectors.similarities(_test(spark, sf_dir), protos, ["vec_id"]), ["vec_id"]).select("vec_id", F.col("label").alias("pred"))


def refine_1_iter(spark, sf_dir):
    return _refined(spark, sf_dir, 1)


def refine_3_iter(spark, sf_dir):
    return _refined(spark, sf_dir, 3)


def detector_fusion(spark, sf_dir):
    fused = vectors.best_label(vectors.fuse(_detected(spark, sf_dir), 0.05), ["vec_id"])
    return fused.select("vec_id", F.col("label").alias("pred"), F.round("score", 6).alias("score"))


def beta_sweep(spark, sf_dir):
    """Accuracy at each fusion weight: one pass over the similarities, crossed with the weights."""
    betas = F.broadcast(spark.createDataFrame([(b,) for b in BETAS], "beta double"))
    fused = vectors.fuse(_detected(spark, sf_dir).crossJoin(betas), F.col("beta"))
    best = vectors.best_label(fused, ["beta", "vec_id"]).withColumn("pred", F.col("label"))
    return metrics.accuracy(best, ["beta"])


def runner_ups_top3(spark, sf_dir):
    return vectors.runner_ups(_sims(spark, sf_dir), ["vec_id"]).select("vec_id", "rank", "label", F.round("sim", 6).alias("sim"))


def knn_cosine_15(spark, sf_dir):
    return vectors.knn(_train(spark, sf_dir), _test(spark, sf_dir))


def dim_sweep(spark, sf_dir):
    """Nearest-centroid accuracy by truncated dimension."""
    out = None
    for dim in (8, 16, 32, 64):
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("gold"), vectors.truncate(vectors.doubles("embedding"), dim).alias("vec"))
        protos = vectors.centroids(rows.filter("vec_id % 5 <> 0"), "gold").withColumnRenamed("gold", "label")
        best = vectors.best_label(vectors.similarities(rows.filter("vec_id % 5 = 0"), protos, ["vec_id", "gold"]), ["vec_id"]).withColumn("pred", F.col("label"))
        part = metrics.accuracy(best).select(F.lit(dim).alias("dim"), "accuracy")
        out = part if out is None else out.unionByName(part)
    return out


def balanced_weights(spark, sf_dir):
    return linear.balanced_weights(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"))).select("label", F.round("weight", 6).alias("weight"))


def gmm_k1_diag_params(spark, sf_dir):
    return gmm.diagonal(_train(spark, sf_dir)).select("label", "pos", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def _ll(spark, sf_dir, rows=None):
    return gmm.log_likelihood(_test(spark, sf_dir) if rows is None else rows, gmm.diagonal(_train(spark, sf_dir)), ["vec_id", "gold"])


def gmm_k1_loglik(spark, sf_dir):
    return _ll(spark, sf_dir).select("vec_id", "label", F.round("ll", 4).alias("ll"))


def _limits(spark, sf_dir):
    return gmm.thresholds(_ll(spark, sf_dir, _train(spark, sf_dir).withColumnRenamed("label", "gold")))


def ood_thresholds(spark, sf_dir):
    return _limits(spark, sf_dir).select("label", F.round("threshold", 4).alias("threshold"))


def ood_predict(spark, sf_dir):
    return gmm.classify(_ll(spark, sf_dir), _limits(spark, sf_dir), "vec_id").select("vec_id", "label", "is_ood")


def ood_rate(spark, sf_dir):
    rows = gmm.classify(_ll(spark, sf_dir), _limits(spark, sf_dir), "vec_id")
    return rows.groupBy("gold").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_ood").cast("int")), 6).alias("ood_rate"))


def _open_world(spark, sf_dir):
    """(gold, pred, best, ll): a typer that was shown the declared labels alone; pred is OOD below its label's threshold."""
    train = _train(spark, sf_dir).filter(F.col("label").isin(DECLARED))
    params = gmm.diagonal(train)
    limits = gmm.thresholds(gmm.log_likelihood(train.withColumnRenamed("label", "gold"), params, ["gold"]))
    found = gmm.classify(gmm.log_likelihood(_test(spark, sf_dir), params, ["vec_id", "gold"]), limits, "vec_id")
    return found.select("gold", F.when(F.col("is_ood"), "OOD").otherwise(F.col("label")).alias("pred"), F.col("label").alias("best"), "ll")


def in_schema_accuracy(spark, sf_dir):
    return metrics.in_schema(_open_world(spark, sf_dir), DECLARED)


def unknown_label_recall(spark, sf_dir):
    return metrics.unknown_recall(_open_world(spark, sf_dir), DECLARED)


def gmm_anchored_predict(spark, sf_dir):
    """Mixtures of all training vectors, begun at each label's centroid; nothing else of the labels is used."""
    train = _train(spark, sf_dir)
    mixtures = gmm.fit_anchored(train, vectors.centroids(train), 3)
    scored = gmm.score_mixtures(_test(spark, sf_dir), mixtures, ["vec_id", "gold"]).withColumnRenamed("ll", "sim")
    return vectors.best_label(scored, ["vec_id"]).select("vec_id", "gold", F.col("label").alias("pred"))


def empirical_hierarchy(spark, sf_dir):
    """Line kinds as labels, quantity and discount as two dimensions: bubbles that overlap."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount") * 100.0).alias("vec"))
    params = gmm.diagonal(rows)
    return gmm.inclusion(gmm.log_likelihood(rows.withColumnRenamed("label", "gold"), params, ["gold"]), gmm.sizes(params), LEAST_INCLUDED)


def bubble_size(spark, sf_dir):
    return gmm.sizes(gmm.diagonal(_train(spark, sf_dir))).select("label", F.round("size", 6).alias("size"))


def loglik_summary(spark, sf_dir):
    p = F.percentile("ll", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    rows = _ll(spark, sf_dir).filter("gold = label").groupBy("gold").agg(F.min("ll").alias("lo"), p.alias("p"), F.max("ll").alias("hi"))
    return rows.select("gold", *[F.round(c, 4).alias(n) for c, n in ((F.col("lo"), "ll_min"), (F.col("p")[0], "ll_p05"), (F.col("p")[1], "ll_median"), (F.col("p")[2], "ll_p95"), (F.col("hi"), "ll_max"))])


def gmm_k3_predict(spark, sf_dir):
    mixtures = gmm.fit_mixtures(_train(spark, sf_dir), 3)
    scored = gmm.score_mixtures(_test(spark, sf_dir), mixtures, ["vec_id", "gold"]).withColumnRenamed("ll", "sim")
    return vectors.best_label(scored, ["vec_id"]).select("vec_id", "gold", F.col("label").alias("pred"))


def linear_svc(spark, sf_dir):
    return linear.squared_hinge(_train(spark, sf_dir), _test(spark, sf_dir), balanced=True).select("vec_id", "gold", "pred")


def logreg(spark, sf_dir):
    return linear.logistic(_train(spark, sf_dir), _test(spark, sf_dir), balanced=True).select("vec_id", "gold", "pred")


def threshold_rule(spark, sf_dir):
    """argmax of similarity less a per-class threshold."""
    limit = F.col("label").cast("int") / 100.0
    return vectors.best_label(_sims(spark, sf_dir).withColumn("sim", F.col("sim") - limit), ["vec_id"]).select("vec_id", F.col("label").alias("pred"))


def threshold_tuning(spark, sf_dir):
    probs = linear.logistic_probabilities(_train(spark, sf_dir), _test(spark, sf_dir), balanced=False)
    return linear.tune_thresholds(probs)


def kfold_assign(spark, sf_dir):
    return linear.folds(_vectors(spark, sf_dir).select("vec_id", F.col("gold").alias("label")), 5, "vec_id")


def out_of_fold(spark, sf_dir):
    return linear.out_of_fold(_vectors(spark, sf_dir).withColumnRenamed("gold", "label"), 5)


def triplets_hash_seeded(spark, sf_dir):
    return triplets.sample(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("gold").alias("label")), per_anchor=2, seed="42")


def hard_negative_pairs(spark, sf_dir):
    errors = _typed(spark, sf_dir).filter("gold <> pred")
    pool = _train(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return triplets.hard_negatives(errors.select(F.col("vec_id").alias("id"), "gold", "pred"), pool, seed="42")


def label_anchored_triplets(spark, sf_dir):
    return triplets.label_anchored(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("gold").alias("label")), seed="7")


def triplet_loss(spark, sf_dir):
    made = triplets.sample(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("gold").alias("label")), per_anchor=1, seed="1")
    return triplets.loss(made, _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"))


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gold"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("pred"), "l_linenumber")


def ami(spark, sf_dir):
    return metrics.ami(_pairs(spark, sf_dir))


def ami_by_group(spark, sf_dir):
    return metrics.ami(_pairs(spark, sf_dir), ["l_linenumber"])


def accuracy(spark, sf_dir):
    return metrics.accuracy(_pairs(spark, sf_dir))


def macro_f1(spark, sf_dir):
    return metrics.macro_f1(_pairs(spark, sf_dir))


def per_label_prf(spark, sf_dir):
    return metrics.per_label(_pairs(spark, sf_dir))


def micro_prf(spark, sf_dir):
    return metrics.micro_prf(_pairs(spark, sf_dir), ["A", "N", "R"])


def confusion_pivot(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir), ["A", "F", "N", "O", "R"])


def class_bias(spark, sf_dir):
    return metrics.class_bias(_pairs(spark, sf_dir)).withColumn("bias", F.when(F.col("bias") == float("inf"), -1.0).otherwise(F.col("bias")))


def topk_confusions(spark, sf_dir):
    return metrics.top_confusions(_pairs(spark, sf_dir), 10)


def top3_misdirections(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("gold"), F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])), (F.col("o_custkey") % 4 + 1).cast("int")).alias("pred"))
    return metrics.top_misdirections(rows)


def _gold_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent_id"), (F.col("l_partkey") % 4).alias("s"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("gold"))
    return rows.withColumn("e", F.col("s") + 2)


def _pred_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("sent_id"), (F.col("l_suppkey") % 4).alias("s"), F.col("l_linenumber").alias("ord"), F.col("l_linestatus").alias("pred"), F.col("l_discount").alias("score"))
    return rows.withColumn("e", F.col("s") + 2)


SPAN = ["sent_id", "s", "e"]


def align_full_outer(spark, sf_dir):
    return align.align(_gold_spans(spark, sf_dir), _pred_spans(spark, sf_dir), SPAN)


def aligned_metrics(spark, sf_dir):
    pairs = align.align(_gold_spans(spark, sf_dir), _pred_spans(spark, sf_dir), SPAN)
    return metrics.summary(pairs)


def matched_offsets(spark, sf_dir):
    g, p = (f(spark, sf_dir).select(*SPAN).distinct() for f in (_gold_spans, _pred_spans))
    return g.join(p, SPAN)


def detection_recall_sweep(spark, sf_dir):
    return align.detection_recall(_gold_spans(spark, sf_dir), _pred_spans(spark, sf_dir), SPAN, THRESHOLDS)


def flagship_zero_shot_typing(spark, sf_dir):
    """Centroids, cosine, argmax, then the metrics, in one plan."""
    return metrics.summary(_typed(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_zero_shot_typing, l2_normalize, matryoshka_truncate, label_centroids, cosine_matrix, multi_proto_maxsim, class_calibration, nearest_centroid, refine_1_iter, refine_3_iter, detector_fusion, beta_sweep, runner_ups_top3,
        knn_cosine_15, dim_sweep, balanced_weights, gmm_k1_diag_params, gmm_k1_loglik, ood_thresholds, ood_predict, ood_rate, empirical_hierarchy, in_schema_accuracy, unknown_label_recall, gmm_anchored_predict, bubble_size, loglik_summary, gmm_k3_predict, linear_svc, logreg, threshold_rule, threshold_tuning, kfold_assign, out_of_fold,
        triplets_hash_seeded, hard_negative_pairs, label_anchored_triplets, triplet_loss, ami, ami_by_group, accuracy, macro_f1, per_label_prf, micro_prf, confusion_pivot, class_bias, topk_confusions, top3_misdirections, align_full_outer, aligned_metrics, matched_offsets, detection_recall_sweep,
    )
}

_V = """raw AS (SELECT vec_id, CAST(label AS VARCHAR) AS gold, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
nrm AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM raw GROUP BY vec_id),
v AS (SELECT raw.vec_id, gold, CAST(pos AS INTEGER) AS pos, x / n AS x FROM raw JOIN nrm USING (vec_id))"""
_C = f"""{_V}, cm AS (SELECT gold AS label, pos, avg(x) AS m FROM v WHERE vec_id % 5 <> 0 GROUP BY gold, pos),
cn AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM cm GROUP BY label),
c AS (SELECT cm.label, pos, m / n AS x FROM cm JOIN cn USING (label)),
sims AS (SELECT v.vec_id, v.gold, c.label, sum(v.x * c.x) AS sim FROM v JOIN c ON v.pos = c.pos WHERE v.vec_id % 5 = 0 GROUP BY v.vec_id, v.gold, c.label)"""
_T = f"""{_C}, typed AS (SELECT vec_id, gold, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, label) AS r FROM sims) WHERE r = 1)"""
_D = f"""{_C}, det AS (SELECT *, CAST((vec_id * 7 + 3) % 10 AS VARCHAR) AS cand, ((vec_id * 13) % 101) / 100.0 AS score FROM sims)"""
_G = f"""{_V}, g AS (SELECT gold AS label, pos, avg(x) AS mean, var_pop(x) + 1e-4 AS var FROM v WHERE vec_id % 5 <> 0 GROUP BY gold, pos),
ll AS (SELECT v.vec_id, v.gold, g.label, -0.5 * sum(ln(2 * pi() * g.var) + (v.x - g.mean) * (v.x - g.mean) / g.var) AS ll FROM v JOIN g ON v.pos = g.pos GROUP BY v.vec_id, v.gold, g.label),
lim AS (SELECT label, quantile_cont(ll, 0.05) AS threshold FROM ll WHERE gold = label AND vec_id % 5 <> 0 GROUP BY label),
ood AS (SELECT b.vec_id, b.gold, b.label, round(ll, 4) < round(threshold, 4) AS is_ood FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll, 4) DESC, label) AS r FROM ll WHERE vec_id % 5 = 0) b JOIN lim USING (label) WHERE r = 1)"""


def _ami(pairs: str, by: str = "") -> str:
    """AMI of a relation with gold and pred, by the definition, with lgamma."""
    b = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON true"
    join = lambda x, y: f"{x} JOIN {y} USING ({by})" if by else f"{x} CROSS JOIN {y}"
    return f"""ct AS (SELECT {b}gold, pred, count(*) AS n FROM {pairs} GROUP BY ALL),
ca AS (SELECT {b}gold, sum(n)::BIGINT AS a FROM ct GROUP BY ALL), cb AS (SELECT {b}pred, sum(n)::BIGINT AS b FROM ct GROUP BY ALL), tt AS (SELECT {b}sum(n)::BIGINT AS t FROM ct {'GROUP BY ' + by if by else ''}),
mi AS (SELECT {b}sum(n / t::DOUBLE * ln(n * t::DOUBLE / (a::DOUBLE * b))) AS mi FROM {join(f"ct JOIN ca USING ({b}gold) JOIN cb USING ({b}pred)", "tt")} {'GROUP BY ' + by if by else ''}),
hg AS (SELECT {b}-sum(a / t::DOUBLE * ln(a / t::DOUBLE)) AS hg FROM {join("ca", "tt")} {'GROUP BY ' + by if by else ''}), hp AS (SELECT {b}-sum(b / t::DOUBLE * ln(b / t::DOUBLE)) AS hp FROM {join("cb", "tt")} {'GROUP BY ' + by if by else ''}),
gr AS (SELECT {b}a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS n FROM {join(join("ca", "cb"), "tt")}),
em AS (SELECT {b}sum(n / t::DOUBLE * ln(n * t::DOUBLE / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS emi FROM gr {'GROUP BY ' + by if by else ''}),
am AS (SELECT {b}round((mi - emi) / ((hg + hp) / 2 - emi), 6) AS ami FROM mi JOIN hg {j} JOIN hp {j} JOIN em {j})"""


_PRF = """ls AS (SELECT gold AS label FROM pairs UNION SELECT pred FROM pairs),
pl AS (SELECT label, (SELECT count(*) FROM pairs WHERE gold = label) AS support, (SELECT count(*) FROM pairs WHERE pred = label) AS predicted, (SELECT count(*) FROM pairs WHERE gold = label AND pred = label) AS tp FROM ls),
pr AS (SELECT *, predicted - tp AS fp, support - tp AS fn, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0), 6) AS f1, coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0) AS exact FROM pl)"""
_P = "pairs AS (SELECT l_returnflag AS gold, CASE WHEN l_quantity > 25 THEN l_linestatus ELSE l_returnflag END AS pred, l_linenumber FROM lineitem)"
_GS = "gs AS (SELECT l_orderkey AS sent_id, l_partkey % 4 AS s, l_partkey % 4 + 2 AS e, l_linenumber AS ord, l_returnflag AS gold FROM lineitem), ps AS (SELECT l_orderkey AS sent_id, l_suppkey % 4 AS s, l_suppkey % 4 + 2 AS e, l_linenumber AS ord, l_linestatus AS pred, l_discount AS score FROM lineitem WHERE l_quantity > 10)"
_AL = f"""{_GS}, gd AS (SELECT sent_id, s, e, max_by(gold, ord * 1000 + ascii(gold)) AS gold FROM gs GROUP BY ALL), pd AS (SELECT sent_id, s, e, max_by(pred, ord * 1000 + ascii(pred)) AS pred FROM ps GROUP BY ALL),
al AS (SELECT sent_id, s, e, coalesce(gold, '__predicted_not_gold__') AS gold, coalesce(pred, '__gold_not_predicted__') AS pred FROM gd FULL JOIN pd USING (sent_id, s, e))"""
_METRICS = "(SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) FROM pairs) AS accuracy, (SELECT round(avg(exact), 6) FROM pr) AS macro_f1"
_OPEN = _G.replace("vec_id % 5 <> 0 GROUP BY gold, pos)", f"vec_id % 5 <> 0 AND gold IN {tuple(DECLARED)} GROUP BY gold, pos)") + ", ow AS (SELECT gold, CASE WHEN is_ood THEN 'OOD' ELSE label END AS pred, label AS best FROM ood)"
ORACLES = {
    "flagship_zero_shot_typing": f"WITH {_T}, pairs AS (SELECT gold, pred FROM typed), {_ami('pairs')}, {_PRF} SELECT ami, {_METRICS} FROM am",
    "l2_normalize": f"WITH {_V} SELECT vec_id, pos, round(x, 6) AS x FROM v",
    "matryoshka_truncate": f"WITH {_V}, t AS (SELECT * FROM raw WHERE pos < 16), n16 AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM t GROUP BY vec_id) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM t JOIN n16 USING (vec_id)",
    "label_centroids": f"WITH {_C} SELECT label, pos, round(x, 6) AS x FROM c",
    "cosine_matrix": f"WITH {_C} SELECT vec_id, label, round(sim, 6) AS sim FROM sims",
    "multi_proto_maxsim": f"WITH {_V}, pm AS (SELECT gold AS label, (vec_id // 5) % {PARTS} AS part, pos, avg(x) AS m FROM v WHERE vec_id % 5 <> 0 GROUP BY ALL), pn AS (SELECT label, part, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM pm GROUP BY ALL), s AS (SELECT v.vec_id, pm.label, pm.part, sum(v.x * m / n) AS sim FROM v JOIN pm ON v.pos = pm.pos JOIN pn ON pn.label = pm.label AND pn.part = pm.part WHERE v.vec_id % 5 = 0 GROUP BY ALL) SELECT vec_id, label, round(max(sim), 6) AS sim FROM s GROUP BY vec_id, label",
    "class_calibration": f"WITH {_C} SELECT vec_id, label, round(sim - avg(sim) OVER (PARTITION BY label), 6) AS sim FROM sims",
    "nearest_centroid": f"WITH {_T} SELECT vec_id, gold, pred FROM typed",
    "refine_1_iter": f"WITH {_T}, rm AS (SELECT t.pred AS label, v.pos, avg(v.x) AS m FROM typed t JOIN v USING (vec_id) GROUP BY ALL), rn AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM rm GROUP BY label), rc AS (SELECT c.label, c.pos, coalesce(m / n, c.x) AS x FROM c LEFT JOIN rm ON rm.label = c.label AND rm.pos = c.pos LEFT JOIN rn ON rn.label = c.label), s2 AS (SELECT v.vec_id, rc.label, sum(v.x * rc.x) AS sim FROM v JOIN rc ON v.pos = rc.pos WHERE v.vec_id % 5 = 0 GROUP BY ALL) SELECT vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, label) AS r FROM s2) WHERE r = 1",
    "detector_fusion": f"WITH {_D}, f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim + CASE WHEN label = cand THEN 0.05 * score ELSE 0 END, 6) DESC, label) AS r FROM det) SELECT vec_id, label AS pred, round(score, 6) AS score FROM f WHERE r = 1",
    "beta_sweep": f"WITH {_D}, bs(beta) AS (VALUES {', '.join(f'({b}::DOUBLE)' for b in BETAS)}), f AS (SELECT *, row_number() OVER (PARTITION BY beta, vec_id ORDER BY round(sim + CASE WHEN label = cand THEN beta * score ELSE 0 END, 6) DESC, label) AS r FROM det, bs) SELECT beta, round(avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f WHERE r = 1 GROUP BY beta",
    "runner_ups_top3": f"WITH {_C} SELECT vec_id, r AS rank, label, round(sim, 6) AS sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, label) AS INTEGER) AS r FROM sims) WHERE r <= 3",
    "knn_cosine_15": f"WITH {_V}, s AS (SELECT a.vec_id, b.vec_id AS n_id, b.gold AS label, round(sum(a.x * b.x), 6) AS sim FROM v a JOIN v b ON a.pos = b.pos WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, n_id) AS r FROM s) WHERE r <= 15), t AS (SELECT vec_id, label, count(*) AS votes FROM k GROUP BY ALL) SELECT vec_id, label AS pred, votes FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS r FROM t) WHERE r = 1",
    "dim_sweep": " UNION ALL ".join(f"SELECT {d} AS dim, acc AS accuracy FROM (WITH {_C.replace('FROM embeddings)', f'FROM (SELECT vec_id, label, list_slice(embedding, 1, {d}) AS embedding FROM embeddings))')}, typed AS (SELECT gold, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, label) AS r FROM sims) WHERE r = 1) SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS acc FROM typed)" for d in (8, 16, 32, 64)),
    "balanced_weights": "SELECT o_orderpriority AS label, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)::DOUBLE), 6) AS weight FROM orders GROUP BY o_orderpriority",
    "gmm_k1_diag_params": f"WITH {_G} SELECT label, pos, round(mean, 6) AS mean, round(var, 6) AS var FROM g",
    "gmm_k1_loglik": f"WITH {_G} SELECT vec_id, label, round(ll, 4) AS ll FROM ll WHERE vec_id % 5 = 0",
    "ood_thresholds": f"WITH {_G} SELECT label, round(threshold, 4) AS threshold FROM lim",
    "ood_predict": f"WITH {_G} SELECT vec_id, label, is_ood FROM ood",
    "ood_rate": f"WITH {_G} SELECT gold, count(*) AS n, round(avg(CASE WHEN is_ood THEN 1.0 ELSE 0.0 END), 6) AS ood_rate FROM ood GROUP BY gold",
    "empirical_hierarchy": f"""WITH x AS (SELECT row_number() OVER () AS id, l_returnflag || l_linestatus AS gold, CAST(l_quantity AS DOUBLE) AS q, l_discount * 100.0::DOUBLE AS d FROM lineitem),
        g AS (SELECT gold AS label, avg(q) AS mq, var_pop(q) + 1e-4 AS vq, avg(d) AS md, var_pop(d) + 1e-4 AS vd FROM x GROUP BY gold),
        ll AS MATERIALIZED (SELECT x.gold, g.label, -0.5 * (ln(2 * pi() * vq) + (q - mq) * (q - mq) / vq + ln(2 * pi() * vd) + (d - md) * (d - md) / vd) AS ll FROM x, g),
        m AS (SELECT label, quantile_cont(ll, 0.5) AS m FROM ll WHERE gold = label GROUP BY label),
        f AS (SELECT gold AS child, label AS parent, round(avg(CASE WHEN round(ll, 4) > round(m, 4) THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM ll JOIN m USING (label) WHERE gold <> label GROUP BY gold, label)
        SELECT f.child, f.parent, f.fraction FROM f LEFT JOIN f b ON b.child = f.parent AND b.parent = f.child JOIN g c ON c.label = f.child JOIN g p ON p.label = f.parent
        WHERE f.fraction >= {LEAST_INCLUDED} AND (coalesce(b.fraction, 0) < {LEAST_INCLUDED} OR round(p.vq + p.vd, 6) >= round(c.vq + c.vd, 6))""",
    "in_schema_accuracy": f"WITH {_OPEN} SELECT count(*) AS n_total, count(CASE WHEN gold IN {tuple(DECLARED)} THEN 1 END) AS n_in, count(CASE WHEN pred = 'OOD' THEN 1 END) AS n_ood, round(avg(CASE WHEN gold IN {tuple(DECLARED)} THEN CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END END), 6) AS accuracy_in, round(avg(CASE WHEN gold IN {tuple(DECLARED)} THEN CASE WHEN gold = best THEN 1.0 ELSE 0.0 END END), 6) AS accuracy_in_best FROM ow",
    "unknown_label_recall": f"WITH {_OPEN} SELECT gold, count(*) AS n, count(CASE WHEN pred = 'OOD' THEN 1 END) AS n_ood, round(avg(CASE WHEN pred = 'OOD' THEN 1.0 ELSE 0.0 END), 6) AS recall FROM ow WHERE gold NOT IN {tuple(DECLARED)} GROUP BY gold",
    "bubble_size": f"WITH {_G} SELECT label, round(sum(var), 6) AS size FROM g GROUP BY label",
    "loglik_summary": f"WITH {_G} SELECT gold, round(min(ll), 4) AS ll_min, round(quantile_cont(ll, 0.05), 4) AS ll_p05, round(quantile_cont(ll, 0.5), 4) AS ll_median, round(quantile_cont(ll, 0.95), 4) AS ll_p95, round(max(ll), 4) AS ll_max FROM ll WHERE gold = label AND vec_id % 5 = 0 GROUP BY gold",
    "threshold_rule": f"WITH {_C} SELECT vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim - CAST(label AS INTEGER) / 100.0::DOUBLE, 6) DESC, label) AS r FROM sims) WHERE r = 1",
    "kfold_assign": "SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings",
    "ami": f"WITH {_P}, {_ami('pairs')} SELECT ami FROM am",
    "ami_by_group": f"WITH {_P}, {_ami('pairs', 'l_linenumber')} SELECT l_linenumber, ami FROM am",
    "accuracy": f"WITH {_P} SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs",
    "macro_f1": f"WITH {_P}, {_PRF} SELECT round(avg(exact), 6) AS macro_f1 FROM pr",
    "per_label_prf": f"WITH {_P}, {_PRF} SELECT label, support, predicted, tp, fp, fn, precision, recall, f1 FROM pr",
    "micro_prf": f"WITH {_P}, {_PRF} SELECT round(sum(tp) / sum(predicted)::DOUBLE, 6) AS micro_p, round(sum(tp) / sum(support)::DOUBLE, 6) AS micro_r, round(2 * sum(tp) / (sum(predicted) + sum(support))::DOUBLE, 6) AS micro_f1, round(avg(f1), 6) AS macro_f1 FROM pr WHERE label IN ('A', 'N', 'R')",
    "confusion_pivot": f"WITH {_P}, l(gold) AS (VALUES ('A'), ('F'), ('N'), ('O'), ('R')) SELECT l.gold, " + ", ".join(f"count(CASE WHEN pred = '{x}' THEN 1 END) AS {x}" for x in "AFNOR") + " FROM l LEFT JOIN pairs ON pairs.gold = l.gold GROUP BY l.gold",
    "class_bias": f"WITH {_P}, {_PRF} SELECT label, support AS n_gold, predicted AS n_pred, CASE WHEN support = 0 THEN -1.0 ELSE round(predicted / support::DOUBLE, 6) END AS bias, round(support / (SELECT count(*) FROM pairs)::DOUBLE, 6) AS gold_share FROM pl",
    "topk_confusions": f"WITH {_P} SELECT gold, pred, count(*) AS n FROM pairs WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10",
    "top3_misdirections": "WITH p AS (SELECT o_orderpriority AS gold, list_extract(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'], CAST(o_custkey % 4 + 1 AS INTEGER)) AS pred FROM orders), c AS (SELECT gold, pred, count(*) AS n FROM p WHERE gold <> pred GROUP BY ALL) SELECT * FROM (SELECT gold, pred, n, CAST(row_number() OVER (PARTITION BY gold ORDER BY n DESC, pred) AS INTEGER) AS rank FROM c) WHERE rank <= 3",
    "align_full_outer": f"WITH {_AL} SELECT sent_id, s, e, gold, pred FROM al",
    "aligned_metrics": f"WITH {_AL}, pairs AS (SELECT gold, pred FROM al), {_ami('pairs')}, {_PRF} SELECT ami, {_METRICS} FROM am",
    "matched_offsets": f"WITH {_GS} SELECT sent_id, s, e FROM gs INTERSECT SELECT sent_id, s, e FROM ps",
    "detection_recall_sweep": f"WITH {_GS}, th(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}), k AS (SELECT * FROM ps, th WHERE score >= threshold), m AS (SELECT threshold, count(*) AS n_matched FROM (SELECT DISTINCT threshold, sent_id, s, e FROM k) d JOIN (SELECT DISTINCT sent_id, s, e FROM gs) g USING (sent_id, s, e) GROUP BY threshold) SELECT th.threshold, (SELECT count(*) FROM gs) AS n_gold, (SELECT count(*) FROM k WHERE k.threshold = th.threshold) AS n_pred, coalesce(n_matched, 0) AS n_matched, round(coalesce(n_matched, 0) / (SELECT count(*) FROM gs)::DOUBLE, 6) AS recall FROM th LEFT JOIN m USING (threshold)",
}
