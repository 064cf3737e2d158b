"""Queries of the span algebra, anchors and parsers over the driver's text tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anchors, parsing
from ..operators import spans
from ..session import table

KEYS = ["doc_id", "line"]


def _lines(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """(doc_id, line, words, starts, tags): lines as rows, with other columns of the document that are named, and tags by rule: capitals are CAP (B at even places), long words LONG (always I), other words O, commas a bare tag."""
    tag = lambda w, i: F.when(w.rlike("^[A-Z]"), F.when(i % 2 == 0, "B-CAP").otherwise("I-CAP")).when(F.char_length(w) > 9, "I-LONG").when(w.endswith(","), "COMMA").otherwise("O")
    return spans.line_words(spans.sentences(table(spark, sf_dir, "documents"), *also), [*KEYS, *also], tag)


def _spans(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """_lines with the text and the spans of each.

    Spans are exploded by explode_outer: of explode Spark infers a filter, which it
    would push below the arrays, making them anew for every word.
    """
    return _lines(spark, sf_dir).withColumn("text", F.array_join("words", " ")).withColumn("spans", spans.line_spans("words", "starts", "tags", strict))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.word_rows(_lines(spark, sf_dir), KEYS)


_TOKENS = """
lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
kept AS (SELECT * FROM lines WHERE trim(text) <> ''),
words AS (SELECT doc_id, line, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM kept),
toks AS (SELECT doc_id, line, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM words),
offs AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_off FROM toks),
tok AS MATERIALIZED (SELECT doc_id, line, CAST(pos AS INTEGER) AS pos, token, CAST(start_off AS INTEGER) AS start_off, CAST(start_off + length(token) AS INTEGER) AS end_off FROM offs)
"""
_SPANS = (
    _TOKENS
    + """,
tags AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Z]') THEN CASE WHEN pos % 2 = 0 THEN 'B-CAP' ELSE 'I-CAP' END WHEN length(token) > 9 THEN 'I-LONG' WHEN token LIKE '%,' THEN 'COMMA' ELSE 'O' END AS tag FROM tok),
bl AS (SELECT *, CASE WHEN tag = 'O' THEN NULL WHEN tag LIKE '%-%' THEN split_part(tag, '-', 1) ELSE 'B' END AS bio, CASE WHEN tag = 'O' THEN NULL WHEN tag LIKE '%-%' THEN split_part(tag, '-', 2) ELSE tag END AS label FROM tags),
lg AS (SELECT *, lag(label) OVER (PARTITION BY doc_id, line ORDER BY pos) AS prev FROM bl),
op AS (SELECT *, CASE WHEN label IS NOT NULL AND (bio = 'B' OR label IS DISTINCT FROM prev) THEN 1 ELSE 0 END AS opens FROM lg),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM op),
sp AS (SELECT doc_id, line, island, min(start_off) AS start_off, max(end_off) AS end_off, min(label) AS label, min(pos) AS first_pos, max(pos) AS last_pos, min(CASE WHEN opens = 1 THEN bio END) AS first_bio FROM isl WHERE label IS NOT NULL GROUP BY doc_id, line, island)
"""
)


def token_offsets(spark, sf_dir):
    return _tagged(spark, sf_dir).select(*KEYS, "pos", "token", "start_off", "end_off")


def _span_rows(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return _spans(spark, sf_dir, strict).select(*KEYS, F.explode_outer("spans").alias("s")).filter("s is not null").select(*KEYS, "s.start_off", "s.end_off", "s.label", "s.first_pos", "s.last_pos")


def bio_to_spans_lenient(spark, sf_dir):
    return _span_rows(spark, sf_dir)


def bio_to_spans_strict(spark, sf_dir):
    return _span_rows(spark, sf_dir, strict=True)


def char_span_to_word_idx(spark, sf_dir):
    """Spans moved by one and two characters; each line is searched where it lies."""
    moved = lambda s: F.struct((s["start_off"] + 1).alias("start_off"), (s["end_off"] + 2).alias("end_off"), s["first_pos"].alias("span_id"))
    rows = _spans(spark, sf_dir).select(*KEYS, "starts", F.zip_with("starts", "words", lambda s, w: s + F.char_length(w)).alias("ends"), F.transform("spans", moved).alias("s"))
    found = rows.withColumn("c", spans.covering(F.col("starts"), F.col("ends"), F.col("s.start_off"), F.col("s.end_off")))
    return found.select(*KEYS, F.explode_outer(F.arrays_zip("s", "c")).alias("z")).filter("z is not null").select(*KEYS, "z.s.start_off", "z.s.end_off", "z.s.span_id", F.col("z.c.a").alias("word_start"), F.col("z.c.b").alias("word_end"))


def word_span_to_char(spark, sf_dir):
    """The ends of word spans by the offsets of their first and last word."""
    rows = _spans(spark, sf_dir).select(*KEYS, "words", "starts", F.explode_outer("spans").alias("s")).filter("s is not null").select(*KEYS, "words", "starts", "s.first_pos", "s.last_pos")
    end = F.get("starts", F.col("last_pos")) + F.char_length(F.get("words", F.col("last_pos")))
    return rows.select(*KEYS, "first_pos", "last_pos", F.get("starts", F.col("first_pos")).alias("char_start"), end.alias("char_end"))


def _in_text(spark, sf_dir):
    rows = _spans(spark, sf_dir).select(*KEYS, "text", F.explode_outer("spans").alias("s")).filter("s.label = 'CAP'")
    return rows.select(*KEYS, "text", "s.start_off", "s.end_off")


def span_in_context(spark, sf_dir):
    rows = _in_text(spark, sf_dir)
    return rows.select(*KEYS, "start_off", F.md5(spans.in_context("text", "start_off", "end_off", "classification: ")).alias("context_md5"), spans.in_context("text", "start_off", "end_off", mode="span").alias("span"))


def span_windowed(spark, sf_dir):
    return _in_text(spark, sf_dir).select(*KEYS, "start_off", spans.windowed("text", "start_off", "end_off").alias("windowed"))


def kwic(spark, sf_dir):
    return _in_text(spark, sf_dir).select(*KEYS, "start_off", spans.kwic("text", "start_off", "end_off").alias("snippet"))


_TEXT = (
    _SPANS
    + """,
tx AS (SELECT doc_id, line, string_agg(token, ' ' ORDER BY pos) AS text FROM tok GROUP BY doc_id, line),
cx AS (SELECT sp.doc_id, sp.line, sp.start_off AS s, sp.end_off AS e, tx.text AS text FROM sp JOIN tx ON sp.doc_id = tx.doc_id AND sp.line = tx.line WHERE sp.label = 'CAP')
"""
)
def _part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as labels, in every style that corpora use: joined by marks, in inner capitals, acronyms, glued to a suffix, all capitals."""
    key, name = F.col("p_partkey"), F.col("p_name")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.floor(key / 6) % len(words) + 1).cast("int"))
    styles = [F.replace(name, F.lit(" "), F.lit("_")), F.replace(F.initcap(name), F.lit(" "), F.lit("")), F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("/"), "p_type")]
    styles += [F.upper(pick(anchors.LONG_ACRONYMS)), F.concat(F.substring_index(name, " ", 1), pick(anchors.SUFFIXES)), F.col("p_type")]
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*styles), (key % 6 + 1).cast("int")).alias("label")).distinct()


def anchor_words_research(spark, sf_dir):
    return _part_labels(spark, sf_dir).select("label", F.array_join(anchors.long_anchors(F.col("label")), "|").alias("words"))


def anchor_words_package(spark, sf_dir):
    return _part_labels(spark, sf_dir).select("label", F.array_join(anchors.short_anchors(F.col("label")), "|").alias("words"))


def _type_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("label")).distinct()


def anchor_resolve(spark, sf_dir):
    labels = _type_labels(spark, sf_dir)
    curated = labels.filter(F.pmod(F.char_length("label"), F.lit(2)) == 0).select("block", "label", F.array(F.lit("curated"), F.col("label")).alias("words"))
    return anchors.resolve(labels, curated).select("block", "label", F.array_join(F.when(F.col("is_curated"), F.col("words")).otherwise(F.slice("words", 1, 1)), "|").alias("words"), "is_curated")


def template_expand(spark, sf_dir):
    rows = _type_labels(spark, sf_dir).select("label").distinct().select("label", F.split(F.col("label"), "_").alias("words"))
    return anchors.expand_templates(rows)


def task_prefix(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", anchors.task_prefix(F.concat(F.element_at(F.array(*map(F.lit, ["Nomic-embed", "intfloat/E5-base", "bge"])), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit("-"), F.col("s_name"))).alias("prefix"))


def parse_pairs(spark, sf_dir):
    text = F.concat_ws(", ", *[F.concat(F.col(c), F.lit("("), F.col(t), F.lit(")")) for c, t in (("l_returnflag", "l_linestatus"), ("l_linestatus", "l_returnflag"))])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(parsing.word_tag_pairs(text)).alias("i", "p"))
    return rows.select("l_orderkey", "l_linenumber", "i", F.col("p.word").alias("word"), F.col("p.tag").alias("tag"))


def json_props(spark, sf_dir):
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"))


def pilener_pairs(spark, sf_dir):
    pairs = parsing.question_answers(table(spark, sf_dir, "conversations")).filter("answer is not null")
    question = spans.collapse_space("text")
    return pairs.select("conv_id", "turn", F.md5(question).alias("question_md5"), F.char_length(question).cast("int").alias("question_chars"), (parsing.locate(F.col("answer"), F.element_at(F.split(question, " "), 1))).alias("first_word_at"))


def gazetteer_detect(spark, sf_dir):
    """Benchmark items by their first six words, found in documents by an equi-join on the hash of six words."""
    six = F.slice(F.split("text", r"[ \n]+"), 1, 6)
    names = table(spark, sf_dir, "benchmark").select("item_id", six.alias("w")).filter(F.size("w") == 6).select("item_id", F.array_join("w", " ").alias("name"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"[ \n]+").alias("w")).filter(F.size("w") >= 6)
    grams = words.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))).alias("pos", "name"))
    return grams.join(names, "name").select("doc_id", "item_id", "pos")


def label_set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "part").filter("p_size <= 20").select("p_brand")
    b = table(spark, sf_dir, "part").filter("p_size > 40").select("p_brand")
    tagged = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(kind).alias("op"), "n") for kind, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("union_all", a.union(b)))]
    return tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])


QUERIES = {f.__name__: f for f in (token_offsets, bio_to_spans_lenient, bio_to_spans_strict, char_span_to_word_idx, word_span_to_char, span_in_context, span_windowed, kwic, anchor_words_research, anchor_words_package, anchor_resolve, template_expand, task_prefix, parse_pairs, json_props, pilener_pairs, gazetteer_detect, label_set_ops)}
_ENT = "substr(text, 1, s) || '[ENT] ' || substr(text, s + 1, e - s) || ' [/ENT]' || substr(text, e + 1)"
_TYPES = "types AS (SELECT DISTINCT p_brand AS block, lower(replace(p_type, ' ', '_')) AS label FROM part)"
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"
_STYLES = f"""st AS (SELECT p_partkey % 6 AS k, p_partkey // 6 AS j, p_name, p_type FROM part),
    lb AS (SELECT DISTINCT CASE k WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN {_TITLE} WHEN 2 THEN replace(p_name, ' ', '-') || '/' || p_type
        WHEN 3 THEN upper({list(anchors.LONG_ACRONYMS)}[j % {len(anchors.LONG_ACRONYMS)} + 1]) WHEN 4 THEN split_part(p_name, ' ', 1) || {list(anchors.SUFFIXES)}[j % {len(anchors.SUFFIXES)} + 1] ELSE p_type END AS label FROM st)"""
_ACRONYM = lambda known, word: f"CASE {word} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in known.items())} ELSE [] END"
_ONCE = "list_filter(x, lambda w, i: w <> '' AND list_position(x, w) = i)"
_GLUED = " ".join(f"WHEN suffix(one, '{x}') AND one <> '{x}' THEN [one[:len(one) - {len(x)}] || ' {x}', '{x}', one[:len(one) - {len(x)}]]" for x in anchors.SUFFIXES)
_SHORT = f"""WITH {_STYLES}, j AS (SELECT label, lower(trim(regexp_replace(regexp_replace(trim(label), '[-_\\s/]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'))) AS joined FROM lb),
    w AS (SELECT *, list_filter(string_split(joined, ' '), lambda w: w <> '') AS ws FROM j),
    f AS (SELECT label, [joined] || {_ACRONYM(anchors.SHORT_ACRONYMS, "lower(trim(label))")} || CASE WHEN len(ws) > 1 THEN ws ELSE [] END AS x FROM w)
    SELECT label, array_to_string({_ONCE}, '|') AS words FROM f"""
_LONG = f"""WITH {_STYLES}, j AS (SELECT label, lower(trim(label)) AS low, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(label), '[-_\\s/]+'), lambda p: p <> ''), lambda p: trim(regexp_replace(p, '([A-Z])', ' \\1', 'g'))), ' ') AS v FROM lb),
    w AS (SELECT label, low, list_filter(string_split(lower(v), ' '), lambda w: w <> '') AS ws FROM j),
    g AS (SELECT *, ws[1] AS one, CASE WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END || CASE WHEN len(ws) > 1 THEN ws ELSE [] END AS base FROM w),
    f AS (SELECT label, CASE WHEN list_contains(base, low) THEN base ELSE base || [low] END || flatten(list_transform(ws || [low], lambda a: {_ACRONYM(anchors.LONG_ACRONYMS, "a")})) || CASE WHEN len(ws) = 1 AND length(one) > 8 THEN CASE {_GLUED} ELSE [] END ELSE [] END AS x FROM g)
    SELECT label, array_to_string({_ONCE}[1:{anchors.MOST_ANCHORS}], '|') AS words FROM f"""
ORACLES = {
    "token_offsets": f"WITH {_TOKENS} SELECT doc_id, line, pos, token, start_off, end_off FROM tok",
    "bio_to_spans_lenient": f"WITH {_SPANS} SELECT doc_id, line, start_off, end_off, label, first_pos, last_pos FROM sp",
    "bio_to_spans_strict": f"WITH {_SPANS} SELECT doc_id, line, start_off, end_off, label, first_pos, last_pos FROM sp WHERE first_bio = 'B'",
    "char_span_to_word_idx": f"WITH {_SPANS} SELECT sp.doc_id, sp.line, sp.start_off + 1 AS start_off, sp.end_off + 2 AS end_off, sp.first_pos AS span_id, min(t.pos) AS word_start, max(t.pos) + 1 AS word_end FROM sp LEFT JOIN tok t ON t.doc_id = sp.doc_id AND t.line = sp.line AND t.start_off < sp.end_off + 2 AND sp.start_off + 1 < t.end_off GROUP BY ALL",
    "word_span_to_char": f"WITH {_SPANS}, fs AS MATERIALIZED (SELECT sp.doc_id, sp.line, first_pos, last_pos, t.start_off AS char_start FROM sp JOIN tok t ON t.doc_id = sp.doc_id AND t.line = sp.line AND t.pos = first_pos) SELECT fs.doc_id, fs.line, first_pos, last_pos, char_start, t.end_off AS char_end FROM fs JOIN tok t ON t.doc_id = fs.doc_id AND t.line = fs.line AND t.pos = last_pos",
    "span_in_context": f"WITH {_TEXT} SELECT doc_id, line, s AS start_off, md5('classification: ' || {_ENT}) AS context_md5, substr(text, s + 1, e - s) AS span FROM cx",
    "span_windowed": f"WITH {_TEXT} SELECT doc_id, line, s AS start_off, substr(text, greatest(0, s - 160) + 1, s - greatest(0, s - 160)) || '[ENT] ' || substr(text, s + 1, e - s) || ' [/ENT]' || substr(text, e + 1, 160) AS windowed FROM cx",
    "kwic": f"WITH {_TEXT} SELECT doc_id, line, s AS start_off, substr(text, greatest(0, s - 60) + 1, s - greatest(0, s - 60)) || '[[' || substr(text, s + 1, e - s) || ']]' || substr(text, e + 1, 60) AS snippet FROM cx",
    "anchor_words_research": _LONG,
    "anchor_words_package": _SHORT,
    "anchor_resolve": f"WITH {_TYPES} SELECT block, label, CASE WHEN length(label) % 2 = 0 THEN 'curated|' || label ELSE replace(label, '_', ' ') END AS words, length(label) % 2 = 0 AS is_curated FROM types",
    "template_expand": "WITH l AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS label FROM part), w AS (SELECT label, CAST(unnest(range(len(string_split(label, '_')))) AS INTEGER) AS pos, unnest(string_split(label, '_')) AS word FROM l), t(template, pattern) AS (VALUES (0, '{a}'), (1, 'a {a}'), (2, 'the {a}'), (3, 'an example of {a}')) SELECT label, pos, word, template, replace(pattern, '{a}', word) AS text, CAST(instr(replace(pattern, '{a}', word), word) - 1 AS INTEGER) AS at FROM w, t",
    "task_prefix": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'classification: ' WHEN 1 THEN 'query: ' ELSE '' END AS prefix FROM supplier",
    "parse_pairs": "SELECT l_orderkey, l_linenumber, 0 AS i, l_returnflag AS word, l_linestatus AS tag FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_linestatus, l_returnflag FROM lineitem",
    "json_props": "SELECT event_type, count(*) AS n, sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS total_k FROM events GROUP BY event_type",
    "pilener_pairs": "WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) SELECT conv_id, turn, md5(q) AS question_md5, CAST(length(q) AS INTEGER) AS question_chars, CASE WHEN length(split_part(q, ' ', 1)) > 0 AND instr(lower(answer), lower(split_part(q, ' ', 1))) > 0 THEN CAST(instr(lower(answer), lower(split_part(q, ' ', 1))) - 1 AS INTEGER) END AS first_word_at FROM p WHERE answer IS NOT NULL",
    "gazetteer_detect": "WITH n AS (SELECT item_id, list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 6) AS w FROM benchmark), names AS (SELECT item_id, array_to_string(w, ' ') AS name FROM n WHERE len(w) = 6), d AS (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents), t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS x FROM d), g AS (SELECT doc_id, pos, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o AS name FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT g.doc_id, item_id, CAST(pos AS INTEGER) AS pos FROM g JOIN names USING (name)",
    "label_set_ops": "WITH a AS (SELECT p_brand FROM part WHERE p_size <= 20), b AS (SELECT p_brand FROM part WHERE p_size > 40) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
}
