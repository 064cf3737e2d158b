"""Queries of the sources and parsers: formats are written out from the driver's tables as lines and read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import spans
from ..session import table
from ..sources import structured, text_formats
from .text_queries import _SPANS, _lines, _spans, _tagged

#: Letters that have a capital of one letter on every engine.
_SMALL = "abcdefghijklmnopqrstuvwxyz"
TYPES = ["Person", "creative_work", "GPE"]


def _bio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token/tag files: a file a document, three columns a line, a blank line after each sentence."""
    made = F.concat(F.zip_with("words", "tags", lambda w, t: F.concat_ws(" ", w, F.lit("x"), t)), F.array(F.lit(" ")))
    rows = _lines(spark, sf_dir).select("doc_id", "line", F.posexplode(made).alias("pos", "value"))
    return rows.select(F.col("doc_id").alias("file"), F.struct("line", "pos").alias("line"), "value")


def bio_text_rows(spark, sf_dir):
    return text_formats.bio_lines(_bio_rows(spark, sf_dir)).select(F.col("file").alias("doc_id"), "sent_id", "pos", "token", "tag")


def bio_corpus_first_200(spark, sf_dir):
    """The first 200 sentences with a span, in order; the cap is the loader's own."""
    tagged = _tagged(spark, sf_dir).select((F.col("doc_id") * 100000 + F.col("line")).alias("sent_id"), "pos", "token", "tag")
    out = text_formats.load_corpus(tagged, ["sent_id"], "sent_id", 200)
    return out.select("sent_id", F.md5("text").alias("text_md5"), F.size("spans").alias("n_spans"), F.col("spans")[0]["start_off"].alias("first_start"), F.col("spans")[0]["label"].alias("first_label"))


def tag_id_maps(spark, sf_dir):
    """Integer tags by name, one of them unknown."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 12).cast("int").alias("t")))).alias("x"))
    tagged = rows.select("l_orderkey", F.transform("x", lambda s: F.concat(F.lit("w"), s["l_linenumber"].cast("string"))).alias("tokens"), F.transform("x", lambda s: s["t"]).alias("tags"))
    decoded = text_formats.decode_tags(tagged, structured.TAG_MAPS["bionlp2004"])
    return text_formats.explode_tokens(decoded, ["l_orderkey"]).select("l_orderkey", "pos", "token", "tag")


def split_summary(spark, sf_dir):
    """Sentences and B- tags of each language, read under the split names that are asked for."""
    lines = _lines(spark, sf_dir, "lang")
    files = {"train": "doc_id % 3 = 0", "dev": "doc_id % 3 = 1", "test": "doc_id % 3 = 2"}
    name = F.coalesce(*[F.when(F.expr(files[f]), split) for split, f in text_formats.SPLIT_FILES.items()])
    return text_formats.line_summary(lines.withColumn("split", name), ["lang", "split"])


#: What orders the lines of an order.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _conllu_lines(n: Column, form: Column, status: Column) -> Column:
    """The lines of an order's word n: it opens entity n, which word n + 1 closes; a comment and a range before each word."""
    number = n.cast("string")
    entity = F.concat(F.lit("Entity="), F.when(n > 1, F.concat((n - 1).cast("string"), F.lit(")"))).otherwise(""), F.lit("("), number, F.lit("-"), status, F.lit("-x"))
    line = lambda i, form, last: F.concat_ws("\t", i, form, *[F.lit("_")] * 7, last)
    return F.array(F.concat(F.lit("# "), number), line(F.concat(number, F.lit("-"), number), F.lit("range"), F.lit("_")), line(number, form, F.concat(F.lit("SpaceAfter=No|"), entity)))


def _form() -> Column:
    return F.concat("l_returnflag", F.col("l_partkey").cast("string"))


def _conllu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ten-column files, line by line."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("n"), _form().alias("form"), "l_linestatus")
    made = _conllu_lines(F.col("n"), F.col("form"), F.col("l_linestatus"))
    return rows.select(F.col("l_orderkey").alias("file"), "n", F.posexplode(made).alias("i", "value")).select("file", F.struct("n", "i").alias("line"), "value")


def _conllu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): the lines of _conllu as one text for each file; a file's words are gathered once, and its lines are made of them."""
    words = F.sort_array(F.collect_list(F.struct(*_LINE_ORDER, _form().alias("form"), "l_linestatus")))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(words.alias("words"))
    lines = F.transform("words", lambda w, i: F.array_join(_conllu_lines(i + 1, w["form"], w["l_linestatus"]), "\n"))
    return files.select("file", F.array_join(lines, "\n").alias("value"))


def conllu_words(spark, sf_dir):
    return text_formats.conllu_lines(_conllu(spark, sf_dir)).select(F.col("file").alias("l_orderkey"), "sent_id", "pos", "token", "entity")


def conllu_spans(spark, sf_dir):
    words = text_formats.conllu_lines(_conllu(spark, sf_dir))
    return text_formats.bracket_spans(words, ["file", "sent_id"]).select(F.col("file").alias("l_orderkey"), "start_off", "end_off", "label")


def _split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 10
    value = F.when(kind == 0, F.concat(F.lit("## "), F.element_at(F.array(*map(F.lit, ("dev", "test", "test2"))), (F.floor(F.col("c_custkey") / 10) % 3 + 1).cast("int")))).when(kind == 5, "some text").otherwise(F.concat(F.lit("  * GUM_"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("line"), value.alias("value"))


def split_list_docs(spark, sf_dir):
    return text_formats.split_lines(_split_lists(spark, sf_dir)).select("split", "doc")


def corpus_splits(spark, sf_dir):
    """(corpus, split, docs) of both corpora under all three names."""
    splits = text_formats.split_lines(_split_lists(spark, sf_dir))
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(F.concat(F.when(key % 7 == 0, "GENTLE_").otherwise("GUM_"), key.cast("string")).alias("doc"))
    out = None
    for corpus in ("main", "special"):
        for split in text_formats.SPLIT_FILES:
            part = text_formats.documents_of(docs, splits, corpus, split).agg(F.count("*").alias("docs")).select(F.lit(corpus).alias("corpus"), F.lit(split).alias("split"), "docs")
            out = part if out is None else out.unionByName(part)
    return out


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, text, spans): word spans moved by a character, and one a document that covers no word."""
    none = F.array(F.struct(F.lit(0).alias("start_off"), F.lit(0).alias("end_off"), F.lit("NONE").alias("label")))
    own = F.transform("spans", lambda s: F.struct(s["start_off"].alias("start_off"), s["end_off"].alias("end_off"), s["label"].alias("label")))
    rows = _spans(spark, sf_dir).filter(F.exists("tags", lambda t: t != "O"))
    return rows.select((F.col("doc_id") * 100000 + F.col("line")).alias("sent_id"), "text", F.concat(own, none).alias("spans"))


def doc_json_entities(spark, sf_dir):
    docs = structured.to_doc_json(_corpus(spark, sf_dir))
    rows = docs.select("id", F.explode("entities").alias("e"))
    return rows.select("id", F.col("e.type").alias("type"), F.col("e.start_word_idx").alias("a"), F.col("e.end_word_idx").alias("b"))


def doc_json_round_trip(spark, sf_dir):
    back = structured.doc_json_spans(structured.to_doc_json(_corpus(spark, sf_dir)))
    return back.select("id", F.explode("spans").alias("s")).select("id", "s.start_off", "s.end_off", "s.label")


def doc_json_counts(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    made = structured.doc_json_summary(corpus, structured.to_doc_json(corpus))
    return made.select("n_docs", "n_entities", "n_dropped", F.array_join("entity_types", ",").alias("entity_types"))


def run_store_best(spark, sf_dir):
    """Orders as runs of a customer's dataset: the preferred priority first, then the newest."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("dataset"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("changed"))
    return text_formats.best_runs(rows, "1-URGENT", ["F", "O"])


def queue_runs(spark, sf_dir):
    key = F.col("event_id")
    value = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] u"), F.col("user_id").cast("string"), F.when(key % 4 == 0, " [RESUME]").otherwise(""), F.lit(" : done exit="), (key % 5 - 1).cast("string"), F.lit(" "), (key % 977).cast("string"), F.lit("s"))
    return text_formats.queue_lines(table(spark, sf_dir, "events").select(F.lit("q").alias("file"), key.alias("line"), value.alias("value")))


def split_fallback(spark, sf_dir):
    """Splits and status of each customer as a dataset: orders are sentences, urgent ones have a span."""
    split = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("dataset"), split.alias("split")).agg(F.count("*").alias("n_sentences"), F.count_if(F.col("o_orderpriority") <= "2-HIGH").alias("n_spans"))
    return text_formats.choose_splits(rows)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as sentences: (conv_id, turn, text, words), single-spaced; turns without a word are left out."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", spans.collapse_space("text").alias("text"))
    return rows.withColumn("words", F.filter(F.split("text", " "), lambda w: w != "")).filter(F.size("words") > 0)


def realigned_tags(spark, sf_dir):
    """What a tagger made of each turn, with words left out, added and in another case, on the turn's own words again."""
    tag = lambda i: F.when(i % 3 == 0, "B-X").when(i % 3 == 1, "I-X").otherwise("O")
    pair = lambda w, i: F.concat(F.when(i % 11 == 4, F.translate(w, _SMALL, _SMALL.upper())).otherwise(w), F.lit("("), tag(i), F.lit(")"))
    made = F.transform("words", lambda w, i: F.when(i % 7 == 3, F.lit("")).when(i % 5 == 2, F.concat(F.lit("zzz(B-Y), "), pair(w, i))).otherwise(pair(w, i)))
    rows = _turns(spark, sf_dir).filter(~F.exists("words", lambda w: w.rlike(r"[()]"))).withColumn("output", F.array_join(F.filter(made, lambda x: x != ""), ", "))
    return parsing.realigned(rows, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "token", "tag")


def generated_entities(spark, sf_dir):
    """What an extractor made of each turn: its first word twice, its last word, a type in another writing and one that is unknown."""
    entity = lambda t, y: F.struct(t.alias("text"), F.lit(y).alias("type"))
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    output = F.concat(F.lit("Sure: "), F.to_json(F.array(entity(first, "person"), entity(last, "Creative Work"), entity(first, "gpe "), entity(last, "nonsense"))), F.lit(" done"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(parsing.typed_entities(output, F.col("text"), TYPES)).alias("i", "s"))
    return rows.select("conv_id", "turn", "i", "s.start_off", "s.end_off", "s.label")


def json_string_lists(spark, sf_dir):
    """A list that parses, and one that does not, by turn."""
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    plain = lambda w: F.regexp_replace(w, r'["\\\[\]]', "")
    quoted = lambda w: F.concat(F.lit('"'), plain(w), F.lit('"'))
    output = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("ok ["), quoted(first), F.lit(", 7, "), quoted(last), F.lit('] ["no"]'))).otherwise(F.concat(F.lit("ok ["), quoted(first), F.lit(", oops, "), quoted(last), F.lit("]")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(parsing.first_json_strings(output), "|").alias("strings"))


def instruction_entities(spark, sf_dir):
    """Turns as texts of instruction-style conversations of their own, asked for two types."""
    rows = _turns(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    values = F.array(F.concat(F.lit("Text: "), "text"), F.lit("I've read it."), F.lit("What describes Kind One in the text?"), F.to_json(F.array(first, F.lit("zzqqzz"))), F.lit("What is it?"), F.to_json(F.array(first)), F.lit("What describes two in the text?"), F.to_json(F.array(last)), F.lit("What describes three in the text?"), F.lit("no list"))
    turns = rows.select(F.col("id").alias("conv_id"), F.posexplode(values).alias("turn", "value"))
    return parsing.instruction_spans(turns).select("conv_id", "start_off", "end_off", "label")


def prompts(spark, sf_dir):
    text = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", *[F.md5(p).alias(n) for n, p in (("tagging", parsing.tagging_prompt(text, TYPES)), ("extraction", parsing.extraction_prompt(text, TYPES)), ("question", parsing.question_prompt(text, F.lit("GPE"))))])


QUERIES = {f.__name__: f for f in (bio_text_rows, bio_corpus_first_200, tag_id_maps, split_summary, conllu_words, conllu_spans, split_list_docs, corpus_splits, doc_json_entities, doc_json_round_trip, doc_json_counts, run_store_best, queue_runs, split_fallback, realigned_tags, generated_entities, json_string_lists, instruction_entities, prompts)}

_BIONLP = ["O", "B-DNA", "I-DNA", "B-protein", "I-protein", "B-cell_type", "I-cell_type", "B-cell_line", "I-cell_line", "B-RNA", "I-RNA"]
_TU = """t AS MATERIALIZED (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) WHERE trim(text) <> '')"""
_SL = "l AS (SELECT c_nationkey AS file, c_custkey AS line, CASE WHEN c_custkey % 10 = 0 THEN ['dev', 'test', 'test2'][CAST((c_custkey // 10) % 3 + 1 AS INTEGER)] END AS head, CASE WHEN c_custkey % 10 NOT IN (0, 5) THEN 'GUM_' || c_custkey END AS doc FROM customer), sl AS (SELECT split, doc FROM (SELECT last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS split, doc FROM l) WHERE split IS NOT NULL AND doc IS NOT NULL)"
_CO = "ss AS (SELECT doc_id * 100000 + line AS sent_id, start_off, end_off, label, first_pos, last_pos FROM sp)"
_LN = "ln AS MATERIALIZED (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_returnflag || l_partkey AS form, l_linestatus AS label FROM lineitem)"
_ASK = ["Person", "creative_work", "GPE"]
ORACLES = {
    "bio_text_rows": f"WITH {_SPANS}, s AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sent_id FROM (SELECT DISTINCT doc_id, line FROM tok)) SELECT tags.doc_id, CAST(sent_id AS INTEGER) AS sent_id, pos, token, tag FROM tags JOIN s ON s.doc_id = tags.doc_id AND s.line = tags.line",
    "bio_corpus_first_200": f"WITH {_SPANS}, {_CO}, n AS (SELECT sent_id, count(*) AS n_spans, min_by(label, start_off) AS first_label, min(start_off) AS first_start FROM ss GROUP BY sent_id ORDER BY sent_id LIMIT 200), tx AS (SELECT doc_id * 100000 + line AS sent_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok GROUP BY 1) SELECT sent_id, md5(text) AS text_md5, CAST(n_spans AS INTEGER) AS n_spans, first_start, first_label FROM n JOIN tx USING (sent_id)",
    "tag_id_maps": f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 12) - 1 AS INTEGER) AS pos, 'w' || l_linenumber AS token, list_extract({_BIONLP}, CAST(l_partkey % 12 + 1 AS INTEGER)) AS tag FROM lineitem",
    "split_summary": f"WITH {_SPANS} SELECT lang, CASE tags.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(DISTINCT (tags.doc_id, line)) AS n_sentences, count(CASE WHEN tag LIKE 'B-%' THEN 1 END) AS n_entities FROM tags JOIN documents d ON d.doc_id = tags.doc_id GROUP BY ALL",
    "conllu_words": f"WITH {_LN} SELECT l_orderkey, 0 AS sent_id, CAST(n - 1 AS INTEGER) AS pos, form AS token, CASE WHEN n > 1 THEN (n - 1) || ')' ELSE '' END || '(' || n || '-' || label || '-x' AS entity FROM ln",
    "conllu_spans": f"WITH {_LN}, o AS (SELECT *, length(form) AS w, coalesce(sum(length(form) + 1) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ln) SELECT a.l_orderkey, CAST(a.s AS INTEGER) AS start_off, CAST(b.s + b.w AS INTEGER) AS end_off, a.label FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1",
    "split_list_docs": f"WITH {_SL} SELECT split, doc FROM sl",
    "corpus_splits": f"""WITH {_SL}, d AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'GENTLE_' ELSE 'GUM_' END || c_custkey AS doc FROM customer), m AS (SELECT 'train' AS split, count(*) AS docs FROM d WHERE doc LIKE 'GUM%' AND doc NOT IN (SELECT doc FROM sl) UNION ALL SELECT 'validation', count(*) FROM d WHERE doc IN (SELECT doc FROM sl WHERE split = 'dev') UNION ALL SELECT 'test', count(*) FROM d WHERE doc IN (SELECT doc FROM sl WHERE split = 'test'))
        SELECT 'main' AS corpus, * FROM m UNION ALL SELECT 'special', * FROM m WHERE split <> 'test' UNION ALL SELECT 'special', 'test', count(*) FROM d WHERE doc LIKE 'GENTLE%'""",
    "doc_json_entities": f"WITH {_SPANS}, {_CO} SELECT CAST(sent_id AS VARCHAR) AS id, label AS type, first_pos AS a, last_pos + 1 AS b FROM ss",
    "doc_json_round_trip": f"WITH {_SPANS}, {_CO} SELECT CAST(sent_id AS VARCHAR) AS id, start_off, end_off, label FROM ss",
    "doc_json_counts": f"WITH {_SPANS}, {_CO} SELECT count(DISTINCT sent_id) AS n_docs, count(*) AS n_entities, count(DISTINCT sent_id) AS n_dropped, string_agg(DISTINCT label, ',' ORDER BY label) AS entity_types FROM ss",
    "run_store_best": "SELECT dataset, run, value FROM (SELECT o_custkey AS dataset, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 11 <> 0) WHERE r = 1",
    "queue_runs": "SELECT 'u' || user_id AS name, max_by(event_id % 977, event_id) AS seconds FROM events WHERE event_id % 5 > 0 GROUP BY user_id",
    "split_fallback": "WITH o AS (SELECT o_custkey AS dataset, ['train', 'validation', 'test'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS split, count(*) AS n, count(CASE WHEN o_orderpriority <= '2-HIGH' THEN 1 END) AS s FROM orders GROUP BY ALL), d AS (SELECT DISTINCT dataset FROM o), j AS (SELECT d.dataset, coalesce(a.split, v.split) AS fit_split, coalesce(t.split, v.split) AS eval_split, coalesce(a.s, v.s, 0) AS fs, coalesce(t.s, v.s, 0) AS es FROM d LEFT JOIN o a ON a.dataset = d.dataset AND a.split = 'train' LEFT JOIN o v ON v.dataset = d.dataset AND v.split = 'validation' LEFT JOIN o t ON t.dataset = d.dataset AND t.split = 'test') SELECT dataset, fit_split, eval_split, CASE WHEN fit_split IS NULL THEN 'failed_load_train' WHEN eval_split IS NULL THEN 'failed_load_test' WHEN fs = 0 THEN 'failed_fit' WHEN es = 0 THEN 'no_eval_spans' ELSE 'ok' END AS status FROM j",
    "realigned_tags": f"""WITH RECURSIVE {_TU}, u AS MATERIALIZED (SELECT * FROM t WHERE len(list_filter(words, lambda w: regexp_matches(w, '[()]'))) = 0),
        g AS (SELECT conv_id, turn, i, words[i + 1] AS w, CASE i % 3 WHEN 0 THEN 'B-X' WHEN 1 THEN 'I-X' ELSE 'O' END AS tag FROM u, unnest(range(len(words))) r(i)),
        p AS (SELECT conv_id, turn, i * 2 + 1 AS o, CASE WHEN i % 11 = 4 THEN translate(w, '{_SMALL}', '{_SMALL.upper()}') ELSE w END AS w, tag FROM g WHERE i % 7 <> 3 UNION ALL SELECT conv_id, turn, i * 2, 'zzz', 'B-Y' FROM g WHERE i % 7 <> 3 AND i % 5 = 2),
        q AS MATERIALIZED (SELECT conv_id, turn, list(lower(w) ORDER BY o) AS ws, list(tag ORDER BY o) AS ts FROM p GROUP BY ALL),
        b AS MATERIALIZED (SELECT u.conv_id, u.turn, words, coalesce(ws, []) AS ws, coalesce(ts, []) AS ts FROM u LEFT JOIN q ON q.conv_id = u.conv_id AND q.turn = u.turn),
        f AS (SELECT conv_id, turn, -1::BIGINT AS pos, 0::BIGINT AS nx, NULL::BIGINT AS hit FROM b UNION ALL
              SELECT conv_id, turn, pos, coalesce(hit, nx), hit FROM (SELECT f.conv_id, f.turn, f.pos + 1 AS pos, f.nx, list_min(list_filter(range(f.nx + 1, f.nx + 5), lambda k: b.ws[k] = lower(b.words[f.pos + 2]))) AS hit FROM f JOIN b ON b.conv_id = f.conv_id AND b.turn = f.turn WHERE f.pos + 1 < len(b.words)))
        SELECT f.conv_id, f.turn, CAST(pos AS INTEGER) AS pos, b.words[pos + 1] AS token, coalesce(b.ts[hit], 'O') AS tag FROM f JOIN b ON b.conv_id = f.conv_id AND b.turn = f.turn WHERE pos >= 0""",
    "generated_entities": f"""WITH {_TU}, a AS (SELECT *, words[1] AS f, words[-1] AS l FROM t),
        b AS (SELECT *, instr(text, f) - 1 AS f1 FROM a), c AS (SELECT *, list_min(list_filter(range(0, length(text) - length(l) + 1), lambda i: substr(text, i + 1, length(l)) = l AND NOT (i < f1 + length(f) AND f1 < i + length(l)))) AS l1 FROM b),
        d AS (SELECT *, list_min(list_filter(range(0, length(text) - length(f) + 1), lambda i: substr(text, i + 1, length(f)) = f AND NOT (i < f1 + length(f) AND f1 < i + length(f)) AND (l1 IS NULL OR NOT (i < l1 + length(l) AND l1 < i + length(f))))) AS f2 FROM c),
        r AS (SELECT conv_id, turn, 0 AS o, f1 AS s, length(f) AS n, 'Person' AS label FROM d UNION ALL SELECT conv_id, turn, 1, l1, length(l), 'creative_work' FROM d UNION ALL SELECT conv_id, turn, 2, f2, length(f), 'GPE' FROM d)
        SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS INTEGER) AS i, CAST(s AS INTEGER) AS start_off, CAST(s + n AS INTEGER) AS end_off, label FROM r WHERE s IS NOT NULL""",
    "json_string_lists": f"""WITH {_TU}, q AS (SELECT conv_id, turn, trim(regexp_replace(words[1], '["\\\\\\[\\]]', '', 'g')) AS f, trim(regexp_replace(words[-1], '["\\\\\\[\\]]', '', 'g')) AS l FROM t) SELECT conv_id, turn, array_to_string(list_filter([f, l], lambda x: x <> ''), '|') AS strings FROM q""",
    "instruction_entities": f"""WITH {_TU}, q AS (SELECT conv_id || '-' || turn AS conv_id, text, words[1] AS f, words[-1] AS l FROM t), r AS (SELECT conv_id, text, f AS e, 'kind one' AS label FROM q UNION ALL SELECT conv_id, text, l, 'two' FROM q)
        SELECT conv_id, CAST(instr(lower(text), lower(e)) - 1 AS INTEGER) AS start_off, CAST(instr(lower(text), lower(e)) - 1 + length(e) AS INTEGER) AS end_off, label FROM r WHERE length(e) >= 2 AND instr(lower(text), lower(e)) > 0""",
    "prompts": f"""WITH {_TU} SELECT conv_id, turn, md5('Tag every word of the sentence, as word(tag) and parted by commas. Tags begin with B- at the first word of an entity and I- inside it; other words are O. Entity tags: {", ".join(_ASK)}.' || chr(10) || 'Sentence: ' || text) AS tagging,
        md5('List the entities of the text as a JSON array of objects with keys "text" (as it stands in the text) and "type". Types: {", ".join(x.replace("_", " ") for x in _ASK)}. Without entities give [].' || chr(10) || 'Text: ' || text) AS extraction, md5('Text: ' || text || chr(10) || 'What describes GPE in the text?') AS question FROM t""",
}
