"""Queries of the byte-range sources, generative models, mixtures over all rows, learned projections, stores that resume and isolated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import generation, runs
from ..api import ZeroShotTyper
from ..models import HashedNgrams, WordPatterns
from ..operators import ablation, decode, em, metric_learning, spans, triplets, vectors
from ..session import cut, scratch, table
from ..sources import blocks, reports, resumable, structured, text_formats
from .corpora import _LN, _TU, _conllu_files, _turns
from .scoring import _METRICS, _PRF, _ami
from .text_queries import _SPANS, KEYS, _lines

#: Bytes of a range in the queries at least, so that small files are read by several tasks.
SPLIT = 1 << 18
KINDS = {"CAP": "CAP", "LONG": "LONG"}
#: Characters that the stand-in holds at once; a longer prompt alone is out of memory.
LIMIT = 1 << 10
DRAWS, LEAST_INCLUDED = 400, 0.3


def _written(lines: DataFrame, name: str) -> str:
    """Path of text files of the column value, each value followed by a blank line."""
    path = scratch(lines.sparkSession, name)
    lines.select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
    return path


def _digests(found: DataFrame) -> DataFrame:
    """A row for each block: the name in its first line, how many words follow, and md5 of their columns."""
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    text = lambda c: F.md5(F.array_join(rest(c), "|"))
    return found.select(F.get("first", F.lit(0)).alias("name"), (F.size("first") - 1).alias("n"), text("first").alias("first_md5"), text("second").alias("second_md5"))


def bio_text_splits(spark, sf_dir):
    """Sentences of the documents, written as token/tag files and read back by byte ranges."""
    word = lambda w, t: F.concat_ws(" ", w, F.lit("x"), t)
    made = _lines(spark, sf_dir).select(*KEYS, F.array_join(F.zip_with("words", "tags", word), "\n").alias("v"))
    path = _written(made.select(F.concat(F.lit("id-"), "doc_id", F.lit("-"), "line", F.lit(" O\n"), "v").alias("value")), "bio")
    return _digests(blocks.read_whole(spark, path, "bio", SPLIT))


def conllu_splits(spark, sf_dir):
    """Orders as ten-column files, read back by byte ranges."""
    head = F.concat(F.lit("0\tid-"), "file", F.lit("\t_" * 8 + "\n"))
    path = _written(_conllu_files(spark, sf_dir).select(F.concat(head, "value").alias("value")), "conllu")
    return _digests(blocks.read_whole(spark, path, "conllu", SPLIT))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without brackets, quotes and backslashes, which answers are written with."""
    return _turns(spark, sf_dir).filter(~F.col("text").rlike(r'[()\[\]"\\]')).select(F.concat_ws("-", "conv_id", "turn").alias("sent_id"), "text")


def _generated(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    found, _ = generation.tag(_texts(spark, sf_dir), adapter, generation.RuleModel(1 << 14), KINDS)
    return found.select("sent_id", "start_off", "end_off", "label")


def generated_word_tags(spark, sf_dir):
    return _generated(spark, sf_dir, "word_tags")


def generated_questions(spark, sf_dir):
    return _generated(spark, sf_dir, "questions")


def generated_described_questions(spark, sf_dir):
    return _generated(spark, sf_dir, "described_questions")


def generated_exact_json(spark, sf_dir):
    return _generated(spark, sf_dir, "exact_json")


def generated_any_json(spark, sf_dir):
    return _generated(spark, sf_dir, "any_json")


def generation_failures(spark, sf_dir):
    """What a model of little memory leaves without an answer, however its batches are halved."""
    _, failed = generation.tag(_texts(spark, sf_dir), "any_json", generation.RuleModel(LIMIT), KINDS)
    return failed.select("sent_id", "reason")


def gmm_em_k3(spark, sf_dir):
    """Three components a label, fitted on all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    found = em.fit_all(rows, 3)
    return found.select("label", "component", F.round("weight", 6).alias("weight"), F.round(F.get("mean", F.lit(0)), 6).alias("first_mean"), F.round(F.get("var", F.lit(0)), 6).alias("first_var"))


def _line_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line kinds as labels, odd and even lines as components, over quantity and discount."""
    kind = F.concat("l_returnflag", "l_linestatus").alias("label")
    rows = table(spark, sf_dir, "lineitem").select(kind, (F.col("l_linenumber") % 2).cast("int").alias("component"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount") * 100.0).alias("d"))
    one = rows.groupBy("label", "component").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("q", "d") for name, f in (("m", F.avg), ("v", F.var_pop))])
    total = one.groupBy("label").agg(F.sum("n").alias("total"))
    spread = [F.col(f"v_{c}") + 1e-4 for c in ("q", "d")]
    return one.join(total, "label").select("label", "component", (F.col("n") / F.col("total")).alias("weight"), F.array("m_q", "m_d").alias("mean"), F.array(*spread).alias("var"))


def hierarchy_monte_carlo(spark, sf_dir):
    return em.hierarchy(cut(_line_mixtures(spark, sf_dir)), DRAWS, 42, LEAST_INCLUDED)


def projection_learning(spark, sf_dir):
    """Mean loss on held-out triplets and accuracy by nearest centroid, before and after a projection is learned on the other triplets."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    learn, held = (cut(metric_learning.with_vectors(t.select("anchor", "positive", "negative"), rows)) for t in metric_learning.held_out(triplets.sample(rows.select("id", "label"), 2, "42")))
    size = len(rows.first().vec)
    w = metric_learning.fit(learn, size, held=held)

    def accuracy(v: DataFrame) -> float:
        scored = vectors.best_label(vectors.similarities(v.withColumnRenamed("label", "gold"), vectors.centroids(v), ["id", "gold"]), ["id"])
        return scored.agg(F.avg((F.col("gold") == F.col("label")).cast("int"))).first()[0]

    out = [("mean_loss", metric_learning.mean_loss(held, metric_learning.start(size, size, 42)), metric_learning.mean_loss(held, w)), ("accuracy", accuracy(rows), accuracy(metric_learning.project(rows, w)))]
    return spark.createDataFrame([(m, round(a, 4), round(b, 4)) for m, a, b in out], "measure string, before double, after double")


def closed_set_spans(spark, sf_dir):
    """Words of turns, long ones in two pieces, with scores by md5: the best allowed tags, and the spans that they make."""
    keys = ["conv_id", "turn"]
    rows = _turns(spark, sf_dir).select(*keys, "words", spans.starts("words").alias("starts"))
    score = lambda i, piece: F.array(*[(triplets.number("conv_id", "turn", i, piece, F.lit(t)) % 1000 + F.lit(300 if t == 0 else 0)).cast("double") for t in range(5)])
    pieces = lambda w: F.when(F.char_length(w) > 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    scores = F.transform("words", lambda w, i: F.transform(pieces(w), lambda piece: score(i, piece)))
    ends = F.zip_with("starts", "words", lambda s, w: s + F.char_length(w))
    lines = rows.select(*keys, "starts", ends.alias("ends"), F.transform(scores, decode.mean_scores).alias("scores"))
    found = decode.decode_lines(lines, keys, ["X", "Y"])
    return found.select(*keys, "start_off", "end_off", "label", F.round("score", 6).alias("score"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def resumed_results(spark, sf_dir):
    """Totals of each priority from a store whose first run was killed at the third one; made_again tells what the second run made."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    inputs = {p: orders.filter(F.col("o_orderpriority") == p) for p in PRIORITIES}
    store, killed = resumable.Results(spark, scratch(spark, "results")), []

    def compute(key: str, rows: DataFrame) -> DataFrame:
        if key == PRIORITIES[2] and not killed:
            killed.append(key)
            return rows.select(F.raise_error(F.lit("killed")).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"))
        return rows.agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))

    try:
        store.run(inputs, compute, "totals")
    except Exception as error:
        if "killed" not in str(error):
            raise
    again = store.run(inputs, compute, "totals")
    return store.read("n long, cents long").withColumn("made_again", F.col("key").isin(again.computed))


def flattened_reports(spark, sf_dir):
    """Orders as reports of three shapes, flattened."""
    key, text = F.col("o_orderkey").cast("string"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    shapes = [
        text('{"id": ', key, ', "metrics": {"priority": "', F.col("o_orderpriority"), '", "by.customer": [', F.col("o_custkey").cast("string"), ", 0.5, true]}}"),
        text('{"runs": [{"seed": 1, "status": "', F.col("o_orderstatus"), '"}, {"seed": 2, "status": null}]}'),
        text('[{"empty": []}, "', F.col("o_orderstatus"), '"]'),
    ]
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*shapes), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text"))
    return reports.flattened(made, "o_orderkey").select("o_orderkey", "path", "value")


def isolated_runs(spark, sf_dir):
    """Priorities as datasets: one cannot be read, one is empty, one cannot be fitted, one crashes on a row, one ends well."""
    orders = table(spark, sf_dir, "orders")

    def load(p: str):
        def run() -> DataFrame:
            if p == PRIORITIES[0]:
                return spark.read.parquet(f"{sf_dir}/{p}-is-not-there.parquet")
            return orders.filter(F.col("o_orderpriority") == p).filter(F.lit(p != PRIORITIES[1]))

        return run

    def fit(p: str, rows: DataFrame) -> None:
        if p == PRIORITIES[2]:
            raise ValueError("nothing to fit on")

    def evaluate(p: str, rows: DataFrame) -> DataFrame:
        seen = F.when((F.lit(p) == PRIORITIES[3]) & (F.col("o_orderkey") % 2 == 0), F.raise_error(F.lit("bad row"))).otherwise(F.col("o_custkey"))
        return rows.groupBy(seen.cast("long").alias("customer")).agg(F.count("*").alias("n"))

    status, _ = runs.run_all(spark, {p: load(p) for p in PRIORITIES}, evaluate, "customer long, n long", fit, lambda: orders.limit(1).count())
    return status.select("dataset", "status", "n_rows", "n_out", F.col("error").isNotNull().alias("has_error"))


def zero_shot_two_passes(spark, sf_dir):
    """A detector of few words and a typer that trusts it, against words by another rule."""
    rows = _turns(spark, sf_dir).select((F.col("conv_id") * 10000 + F.col("turn")).alias("sent_id"), "text", "words")
    tokens = spans.word_rows(rows.select("sent_id", "words", spans.starts("words").alias("starts")), ["sent_id"])
    label = F.when(F.col("token").rlike("^[A-Z]"), "CAP").when(F.char_length("token") > 9, "LONG")
    gold = tokens.select("sent_id", "start_off", "end_off", label.alias("label")).filter("label is not null")
    typer = ZeroShotTyper(WordPatterns({"CAP": "[A-Z]", "LONG": ".{12}"}), HashedNgrams(16), beta=100.0)
    return runs.zero_shot(rows.select("sent_id", "text"), gold, typer)


DIMS = (16, 64)


def three_axis_ablation(spark, sf_dir):
    """Two embedders (as they are, and less their mean), two dimensions, two heads."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("gold"), F.col("embedding").cast("array<double>").alias("vec"))
    return ablation.ablate({"plain": rows, "centred": ablation.centred(rows)}, list(DIMS), {"centroid": ablation.centroid_head, "gaussian": ablation.gaussian_head}, "vec_id % 5 = 0")


def tag_id_maps_all(spark, sf_dir):
    """Integer tags by each of the static maps, one tag unknown to each."""
    out = None
    for name, tags in structured.TAG_MAPS.items():
        rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_name")).alias("tokens"), F.array((F.col("p_partkey") % (len(tags) + 1)).cast("int")).alias("tags"))
        part = text_formats.explode_tokens(text_formats.decode_tags(rows, tags), ["p_partkey"]).select(F.lit(name).alias("map"), "p_partkey", "token", "tag")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (bio_text_splits, conllu_splits, generated_word_tags, generated_questions, generated_described_questions, generated_exact_json, generated_any_json, generation_failures, gmm_em_k3, hierarchy_monte_carlo, projection_learning, closed_set_spans, resumed_results, flattened_reports, isolated_runs, zero_shot_two_passes, three_axis_ablation, tag_id_maps_all)
}

_TX = _TU + """, tx AS MATERIALIZED (SELECT conv_id || '-' || turn AS sent_id, text, words FROM t WHERE NOT regexp_matches(text, '[()\\[\\]"\\\\]'))"""
_KIND = "CASE WHEN regexp_matches({0}, '^[A-Z]') THEN 'CAP' WHEN length({0}) >= 12 THEN 'LONG' END"
_FIRST = f"""WITH {_TX}, a AS (SELECT sent_id, text, list_filter(words, lambda w: {_KIND.format("w")} = 'CAP')[1] AS f, list_filter(words, lambda w: {_KIND.format("w")} = 'LONG')[1] AS l FROM tx),
    b AS (SELECT *, instr(text, f) - 1 AS f1 FROM a),
    c AS (SELECT *, list_min(list_filter(range(0, length(text) - length(l) + 1), lambda i: substr(text, i + 1, length(l)) = l AND (f IS NULL OR NOT (i < f1 + length(f) AND f1 < i + length(l))))) AS l1 FROM b)
    SELECT sent_id, CAST(f1 AS INTEGER) AS start_off, CAST(f1 + length(f) AS INTEGER) AS end_off, 'CAP' AS label FROM c WHERE f IS NOT NULL UNION ALL
    SELECT sent_id, CAST(l1 AS INTEGER), CAST(l1 + length(l) AS INTEGER), 'LONG' FROM c WHERE l1 IS NOT NULL"""
_SHARE = "(CAST('0x' || substr({0}, {1}, 8) AS BIGINT) + 0.5) / 4294967296.0"
_NORMAL = f"sqrt(-2.0 * ln({_SHARE.format('{0}', 1)})) * cos(2 * pi() * {_SHARE.format('{0}', 9)})"
_ASKED = "length('List the entities of the text as a JSON array of objects with keys \"text\" (as it stands in the text) and \"type\". Types: CAP, LONG. Without entities give [].' || chr(10) || 'Text: ' || text)"


def _ablation(embedder: str, dim: int, head: str) -> str:
    """SQL of one combination."""
    x = "x - avg(x) OVER (PARTITION BY pos)" if embedder == "centred" else "x"
    sims = "SELECT v.vec_id, v.gold, c.label, round(sum(v.x * c.m / c.n), 6) AS s FROM v JOIN (SELECT label, pos, m, greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS n FROM g) c USING (pos) WHERE v.vec_id % 5 = 0 GROUP BY ALL"
    ll = "SELECT v.vec_id, v.gold, g.label, round(-0.5 * sum(ln(2 * pi() * (g.s + 1e-4)) + (v.x - g.m) * (v.x - g.m) / (g.s + 1e-4)), 4) AS s FROM v JOIN g USING (pos) WHERE v.vec_id % 5 = 0 GROUP BY ALL"
    return f"""SELECT '{embedder}' AS embedder, {dim} AS dim, '{head}' AS head, * FROM (WITH r0 AS (SELECT vec_id, CAST(label AS VARCHAR) AS gold, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        r1 AS (SELECT vec_id, gold, pos, {x} AS x FROM r0), r2 AS (SELECT * FROM r1 WHERE pos < {dim}), nn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM r2 GROUP BY vec_id),
        v AS (SELECT r2.vec_id, gold, pos, x / n AS x FROM r2 JOIN nn USING (vec_id)), g AS (SELECT gold AS label, pos, avg(x) AS m, var_pop(x) AS s FROM v WHERE vec_id % 5 <> 0 GROUP BY ALL),
        sc AS ({sims if head == "centroid" else ll}), pairs AS (SELECT gold, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM sc) WHERE k = 1), {_PRF}
        SELECT (SELECT count(*) FROM pairs) AS n, {_METRICS})"""


ORACLES = {
    "bio_text_splits": f"WITH {_SPANS} SELECT 'id-' || doc_id || '-' || line AS name, CAST(count(*) AS INTEGER) AS n, md5(string_agg(token, '|' ORDER BY pos)) AS first_md5, md5(string_agg(tag, '|' ORDER BY pos)) AS second_md5 FROM tags GROUP BY doc_id, line",
    "conllu_splits": f"""WITH {_LN}, e AS (SELECT l_orderkey, n, form, CASE WHEN n > 1 THEN (n - 1) || ')' ELSE '' END || '(' || n || '-' || label || '-x' AS entity FROM ln)
        SELECT 'id-' || l_orderkey AS name, CAST(count(*) AS INTEGER) AS n, md5(string_agg(form, '|' ORDER BY n)) AS first_md5, md5(string_agg(entity, '|' ORDER BY n)) AS second_md5 FROM e GROUP BY l_orderkey""",
    "generated_word_tags": f"""WITH {_TX}, g AS (SELECT sent_id, words[i + 1] AS w, coalesce(list_sum(list_transform(words[1:i], lambda x: length(x) + 1)), 0) AS s FROM tx, unnest(range(len(words))) r(i))
        SELECT sent_id, CAST(s AS INTEGER) AS start_off, CAST(s + length(w) AS INTEGER) AS end_off, {_KIND.format("w")} AS label FROM g WHERE {_KIND.format("w")} IS NOT NULL""",
    "generated_questions": _FIRST,
    "generated_described_questions": _FIRST,
    "generated_exact_json": _FIRST,
    "generated_any_json": _FIRST,
    "generation_failures": f"WITH {_TX} SELECT sent_id, 'out of memory' AS reason FROM tx WHERE {_ASKED} > {LIMIT}",
    "closed_set_spans": f"""WITH RECURSIVE {_TU}, g AS (SELECT conv_id, turn, i, words[i + 1] AS w, coalesce(list_sum(list_transform(words[1:i], lambda x: length(x) + 1)), 0) AS s FROM t, unnest(range(len(words))) r(i)),
        pc AS (SELECT *, j FROM g, unnest(range(CASE WHEN length(w) > 6 THEN 2 ELSE 1 END)) r(j)),
        sc AS (SELECT conv_id, turn, i, list_transform(range(5), lambda k: CAST('0x' || substr(md5(conv_id || '|' || turn || '|' || i || '|' || j || '|' || k), 1, 8) AS BIGINT) % 1000 + CASE WHEN k = 0 THEN 300 ELSE 0 END) AS x FROM pc),
        wd AS MATERIALIZED (SELECT conv_id, turn, i, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4]), avg(x[5])] AS x FROM sc GROUP BY ALL),
        v AS (SELECT conv_id, turn, 0::BIGINT AS i, [x[1], x[2], -1e18, x[4], -1e18] AS b, ['0', '1', '2', '3', '4'] AS p FROM wd WHERE i = 0 UNION ALL
            SELECT v.conv_id, v.turn, v.i + 1, [m + x[1], m + x[2], greatest(b[2], b[3]) + x[3], m + x[4], greatest(b[4], b[5]) + x[5]],
                [p[k] || '0', p[k] || '1', CASE WHEN b[2] >= b[3] THEN p[2] ELSE p[3] END || '2', p[k] || '3', CASE WHEN b[4] >= b[5] THEN p[4] ELSE p[5] END || '4']
            FROM (SELECT *, list_max(b) AS m, list_position(b, list_max(b)) AS k FROM v) v JOIN wd ON wd.conv_id = v.conv_id AND wd.turn = v.turn AND wd.i = v.i + 1),
        l AS (SELECT conv_id, turn, max_by(p[list_position(b, list_max(b))], i) AS path FROM v GROUP BY ALL),
        tg AS (SELECT g.conv_id, g.turn, g.i, s, s + length(w) AS e, CAST(path[g.i + 1] AS INTEGER) AS k, wd.x[CAST(path[g.i + 1] AS INTEGER) + 1] AS score FROM g JOIN l USING (conv_id, turn) JOIN wd ON wd.conv_id = g.conv_id AND wd.turn = g.turn AND wd.i = g.i),
        o AS (SELECT *, sum(CASE WHEN k IN (1, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM tg)
        SELECT conv_id, turn, CAST(min(s) AS INTEGER) AS start_off, CAST(max(e) AS INTEGER) AS end_off, CASE WHEN min(k) <= 2 THEN 'X' ELSE 'Y' END AS label, round(avg(score), 6) AS score FROM o WHERE k > 0 GROUP BY conv_id, turn, island""",
    "resumed_results": f"SELECT o_orderpriority AS key, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, o_orderpriority >= '{PRIORITIES[2]}' AS made_again FROM orders GROUP BY o_orderpriority",
    "flattened_reports": """SELECT o_orderkey, p.path, p.value FROM orders, LATERAL (SELECT unnest(CASE o_orderkey % 3
        WHEN 0 THEN [{'path': '.id', 'value': CAST(o_orderkey AS VARCHAR)}, {'path': '.metrics.priority', 'value': o_orderpriority}, {'path': '.metrics.by.customer[0]', 'value': CAST(o_custkey AS VARCHAR)}, {'path': '.metrics.by.customer[1]', 'value': '0.5'}, {'path': '.metrics.by.customer[2]', 'value': 'true'}]
        WHEN 1 THEN [{'path': '.runs[0].seed', 'value': '1'}, {'path': '.runs[0].status', 'value': o_orderstatus}, {'path': '.runs[1].seed', 'value': '2'}, {'path': '.runs[1].status', 'value': NULL}]
        ELSE [{'path': '[0].empty', 'value': NULL}, {'path': '[1]', 'value': o_orderstatus}] END) AS p)""",
    "zero_shot_two_passes": f"""WITH {_TU}, w AS (SELECT conv_id, turn, i, words[i + 1] AS w FROM t, unnest(range(len(words))) r(i)),
        al AS (SELECT CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'CAP' WHEN length(w) > 9 THEN 'LONG' ELSE '__predicted_not_gold__' END AS gold, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'CAP' WHEN length(w) >= 12 THEN 'LONG' ELSE '__gold_not_predicted__' END AS pred FROM w),
        pairs AS MATERIALIZED (SELECT * FROM al WHERE gold <> '__predicted_not_gold__' OR pred <> '__gold_not_predicted__'), {_ami('pairs')}, {_PRF},
        n AS (SELECT count(CASE WHEN gold <> '__predicted_not_gold__' THEN 1 END) AS n_gold, count(CASE WHEN pred <> '__gold_not_predicted__' THEN 1 END) AS n_pred, count(CASE WHEN gold <> '__predicted_not_gold__' AND pred <> '__gold_not_predicted__' THEN 1 END) AS n_matched FROM pairs)
        SELECT n_gold, n_pred, n_matched, round(n_matched / n_gold::DOUBLE, 6) AS recall, ami, {_METRICS} FROM n, am""",
    "three_axis_ablation": " UNION ALL ".join(_ablation(e, d, h) for e in ("plain", "centred") for d in DIMS for h in ("centroid", "gaussian")),
    "tag_id_maps_all": " UNION ALL ".join(f"SELECT '{name}' AS map, p_partkey, p_name AS token, list_extract({tags}, CAST(p_partkey % {len(tags) + 1} + 1 AS INTEGER)) AS tag FROM part" for name, tags in structured.TAG_MAPS.items()),
    "isolated_runs": f"""SELECT o_orderpriority AS dataset, CASE o_orderpriority WHEN '{PRIORITIES[0]}' THEN 'failed_load' WHEN '{PRIORITIES[1]}' THEN 'no_rows' WHEN '{PRIORITIES[2]}' THEN 'failed_fit' WHEN '{PRIORITIES[3]}' THEN 'crashed' ELSE 'ok' END AS status,
        CASE o_orderpriority WHEN '{PRIORITIES[1]}' THEN 0 WHEN '{PRIORITIES[4]}' THEN count(*) END AS n_rows, CASE WHEN o_orderpriority = '{PRIORITIES[4]}' THEN count(DISTINCT o_custkey) END AS n_out, o_orderpriority NOT IN ('{PRIORITIES[1]}', '{PRIORITIES[4]}') AS has_error FROM orders GROUP BY o_orderpriority""",
    "hierarchy_monte_carlo": f"""WITH x AS (SELECT l_returnflag || l_linestatus AS label, l_linenumber % 2 AS c, CAST(l_quantity AS DOUBLE) AS q, l_discount * 100.0::DOUBLE AS d FROM lineitem),
        g AS MATERIALIZED (SELECT label, c, count(*) / sum(count(*)) OVER (PARTITION BY label) AS w, avg(q) AS mq, var_pop(q) + 1e-4 AS vq, avg(d) AS md, var_pop(d) + 1e-4 AS vd FROM x GROUP BY label, c),
        h AS (SELECT *, sum(w) OVER (PARTITION BY label ORDER BY c) AS reached, sum(w) OVER (PARTITION BY label) AS total FROM g),
        p AS (SELECT DISTINCT label, i FROM g, range({DRAWS}) r(i)),
        s AS (SELECT label, i, {_SHARE.format("md5('42|' || label || '|' || i)", 1)} AS u FROM p),
        k AS MATERIALIZED (SELECT s.label, i, min(c) AS c FROM s JOIN h ON h.label = s.label AND (reached >= u * total OR reached = total) GROUP BY s.label, i),
        v AS MATERIALIZED (SELECT k.label AS gold, i, mq + sqrt(vq) * {_NORMAL.format("md5('42|' || k.label || '|' || i || '|0')")} AS q, md + sqrt(vd) * {_NORMAL.format("md5('42|' || k.label || '|' || i || '|1')")} AS d FROM k JOIN g ON g.label = k.label AND g.c = k.c),
        l AS (SELECT gold, i, g.label, ln(w) - 0.5 * (ln(2 * pi() * vq) + (q - mq) * (q - mq) / vq + ln(2 * pi() * vd) + (d - md) * (d - md) / vd) AS l FROM v, g),
        ll AS MATERIALIZED (SELECT gold, i, label, max(l) + ln(sum(exp(l - top))) AS ll FROM (SELECT *, max(l) OVER (PARTITION BY gold, i, label) AS top FROM l) GROUP BY gold, i, label),
        m AS (SELECT label, quantile_cont(ll, 0.5) AS m FROM ll WHERE gold = label GROUP BY label),
        z AS (SELECT label, sum(vq + vd) AS size FROM g GROUP BY label),
        f AS (SELECT gold AS child, label AS parent, round(avg(CASE WHEN round(ll, 4) > round(m, 4) THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM ll JOIN m USING (label) WHERE gold <> label GROUP BY gold, label)
        SELECT f.child, f.parent, f.fraction FROM f LEFT JOIN f b ON b.child = f.parent AND b.parent = f.child JOIN z c ON c.label = f.child JOIN z p ON p.label = f.parent
        WHERE f.fraction >= {LEAST_INCLUDED} AND (coalesce(b.fraction, 0) < {LEAST_INCLUDED} OR round(p.size, 6) >= round(c.size, 6))""",
}
