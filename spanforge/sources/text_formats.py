"""Text sources: token/tag lines and bracket-annotated tables, read by byte ranges; split lists and logs, where one file is one row until it is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spans
from ..session import ship
from . import blocks


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def bio_text(spark: SparkSession, path: str, split_bytes: int = blocks.SPLIT_BYTES) -> DataFrame:
    """(file, sent_id, pos, token, tag) of token/tag files: as bio_lines gives them, but read by byte ranges and without a shuffle of the lines."""
    rows = blocks.numbered(blocks.read(spark, path, "bio", split_bytes))
    return rows.select("file", "sent_id", "pos", F.col("first").alias("token"), F.col("second").alias("tag"))


def bio_lines(lines: DataFrame) -> DataFrame:
    """(file, sent_id, pos, token, tag): first and last column of each of lines(file, line, value); blank lines end sentences, one-column lines are skipped."""
    cols = lines.select("file", "line", F.split(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")), " ").alias("c"))
    rows = cols.select("file", "line", (F.col("c") == F.array(F.lit(""))).alias("blank"), F.when(F.size("c") >= 2, F.get("c", F.lit(0))).alias("token"), F.element_at("c", -1).alias("tag"))
    return _numbered(rows.filter("blank or token is not null")).select("file", "sent_id", "pos", "token", "tag")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds sent_id and pos to the word rows of (file, line, blank, token, ...): blocks with a word count from 0 in a file, words in a block.

    All of it is told in one order of a file's lines, so rows are sorted once.
    """
    order = Window.partitionBy("file").orderBy("line")
    words = rows.withColumn("block", F.sum(F.col("blank").cast("int")).over(order)).filter("token is not null")
    first = ~F.col("block").eqNullSafe(F.lag("block").over(order))
    placed = words.withColumn("first", first).withColumn("nth", F.row_number().over(order))
    began = F.max(F.when(F.col("first"), F.col("nth"))).over(order)
    return placed.withColumn("sent_id", (F.sum(F.col("first").cast("int")).over(order) - 1).cast("int")).withColumn("pos", F.col("nth") - began)


def decode_tags(rows: DataFrame, tags: list[str]) -> DataFrame:
    """Replaces integer tags of (tokens, tags) rows by their names; an unknown id is null."""
    names = F.array(*map(F.lit, tags))
    return rows.withColumn("tags", F.transform("tags", lambda t: F.try_element_at(names, t.cast("int") + 1)))


def explode_tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "z")).select(*keys, "pos", F.col("z.tokens").alias("token"), F.col("z.tags").alias("tag"))


def load_corpus(tagged: DataFrame, keys: list[str], order: str, most: int | None = None) -> DataFrame:
    """(keys, text, spans) of sentences with at least one span; the cap counts kept sentences in order.

    With a cap, the sentences to keep are found first, by any tag but O, so the words of others are not moved.
    """
    if most is not None:
        kept = tagged.filter("tag <> 'O'").select(*dict.fromkeys([*keys, order])).distinct().orderBy(order, *keys).limit(most)
        tagged = tagged.join(kept.select(*keys), keys, "left_semi")
    ship(tagged.sparkSession)
    rows = tagged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("w")).select(*keys, F.col("w.token").alias("words"), F.col("w.tag").alias("tags"))
    rows = rows.filter(F.exists("tags", lambda t: t != "O")).withColumn("starts", spans.starts("words"))
    found = F.transform(spans.line_spans("words", "starts", "tags"), lambda s: F.struct(s["start_off"].alias("start_off"), s["end_off"].alias("end_off"), s["label"].alias("label")))
    return rows.select(*keys, F.array_join("words", " ").alias("text"), found.alias("spans"))


#: Splits by the name that is asked for, and the file that holds them.
SPLIT_FILES = {"train": "train", "validation": "dev", "test": "test"}


def tag_summary(tagged: DataFrame, by: list[str], sentence: list[str]) -> DataFrame:
    """(by, n_sentences, n_entities) of tagged tokens: sentences are told apart by their columns, entities are counted by their B- tags."""
    one = tagged.groupBy(*by, *sentence).agg(F.count_if(F.col("tag").startswith("B-")).alias("n"))
    return one.groupBy(*by).agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_entities"))


def line_summary(lines: DataFrame, by: list[str]) -> DataFrame:
    """tag_summary of sentences that are rows with an array of tags: a row a sentence is counted, and none is told apart by key."""
    return lines.select(*by, F.size(F.filter("tags", lambda t: t.startswith("B-"))).alias("n")).groupBy(*by).agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_entities"))


def conllu(spark: SparkSession, path: str, split_bytes: int = blocks.SPLIT_BYTES) -> DataFrame:
    """(file, sent_id, pos, token, entity) of ten-column files: as conllu_lines gives them, but read by byte ranges and without a shuffle of the lines."""
    rows = blocks.numbered(blocks.read(spark, path, "conllu", split_bytes))
    return rows.select("file", "sent_id", "pos", F.col("first").alias("token"), F.col("second").alias("entity"))


def conllu_lines(lines: DataFrame) -> DataFrame:
    """(file, sent_id, pos, token, entity): words of a ten-column table in lines(file, line, value); comments, ranges (3-4) and empty words (5.1) are left out."""
    cols = lines.select("file", "line", "value", F.split("value", "\t").alias("c"))
    word = (F.size("c") >= 10) & ~F.col("value").startswith("#") & ~F.get("c", F.lit(0)).contains("-") & ~F.get("c", F.lit(0)).contains(".") & (F.trim("value") != "")
    entity = F.regexp_extract(F.get("c", F.lit(9)), r"(?:^|\|)Entity=([^|]*)", 1)
    rows = cols.select("file", "line", (F.trim("value") == "").alias("blank"), F.when(word, F.get("c", F.lit(1))).alias("token"), entity.alias("entity"))
    return _numbered(rows.filter("blank or token is not null")).select("file", "sent_id", "pos", "token", "entity")


def bracket_events(words: DataFrame, keys: list[str], *also: str) -> DataFrame:
    """(keys, pos, ev, kind, id, label) in order, with what other columns of the words are named: '(id-TYPE...' opens, 'id)' closes."""
    parts = F.regexp_extract_all("entity", F.lit(r"(\(\d+-[^-()|]+[^()]*|\d+\))"), 1)
    rows = words.select(*keys, "pos", *also, F.posexplode(parts).alias("ev", "e"))
    kind = F.when(F.col("e").startswith("("), "open").otherwise("close")
    return rows.select(*keys, "pos", *also, "ev", kind.alias("kind"), F.regexp_extract("e", r"(\d+)", 1).cast("int").alias("id"), F.regexp_extract("e", r"^\(\d+-([^-()|]+)", 1).alias("label"))


def bracket_spans(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_off, end_off, label): each close takes the latest open of its id before it, once.

    A one-word bracket has no digits before its closing mark and gives no span,
    as in the format's reader that this follows; an id opened again drops the
    earlier opening. So a close is taken where what comes right before it, of its
    id, is an open; offsets go along with the events.
    """
    events = bracket_events(spans.token_offsets(words, keys), keys, "start_off", "end_off")
    before = F.lag(F.struct("kind", "start_off", "label")).over(Window.partitionBy(*keys, "id").orderBy("pos", "ev"))
    closes = events.withColumn("o", before).filter("kind = 'close' and o.kind = 'open'")
    return closes.select(*keys, F.col("o.start_off").alias("start_off"), "end_off", F.col("o.label").alias("label"))


def split_list(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(numbered_lines(spark, path))


def split_lines(lines: DataFrame) -> DataFrame:
    """(split, doc): bullets of lines(file, line, value) under the heading before them."""
    heading = F.regexp_extract("value", r"^##\s*(\S+)", 1)
    under = F.last(F.when(heading != "", heading), True).over(Window.partitionBy("file").orderBy("line"))
    doc = F.regexp_extract("value", r"^\s*\*\s*(\S+)", 1)
    return lines.select(under.alias("split"), doc.alias("doc")).filter("doc <> '' and split is not null")


def split_docs(docs: DataFrame, splits: DataFrame, special: str = "GENTLE_") -> DataFrame:
    """(doc, split): listed documents keep their split, those of the special prefix are its test split, the rest train."""
    joined = docs.join(F.broadcast(splits), "doc", "left")
    return joined.select("doc", F.when(F.col("doc").startswith(special), "special_test").otherwise(F.coalesce("split", F.lit("train"))).alias("split"))


def documents_of(docs: DataFrame, splits: DataFrame, corpus: str, split: str) -> DataFrame:
    """docs(doc) of one split: of the main corpus by the split list, its train split being what no list names.

    The special corpus has a test split alone, all its documents; asked for
    another it gives the main corpus's.
    """
    if corpus not in ("main", "special") or split not in SPLIT_FILES:
        raise ValueError(f"unknown corpus or split {corpus}, {split}")
    if corpus == "special" and split == "test":
        return docs.filter(F.col("doc").startswith("GENTLE_"))
    main = docs.filter(F.col("doc").startswith("GUM_"))
    if split == "train":
        return main.join(splits.filter(F.col("split").isin("dev", "test", "test2")).select("doc"), "doc", "left_anti")
    return main.join(splits.filter(F.col("split") == SPLIT_FILES[split]).select("doc"), "doc", "left_semi")


def queue_log(spark: SparkSession, path: str) -> DataFrame:
    return queue_lines(numbered_lines(spark, path))


def queue_lines(lines: DataFrame) -> DataFrame:
    """(name, seconds) of finished runs in lines(file, line, value); a negative exit code is no match, the last line of a name wins."""
    pattern = r"\]\s*(\S+).*:\s*done\s+exit=\d+\s+(\d+)s"
    rows = lines.select("file", "line", F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("s")).filter("name <> ''")
    return rows.groupBy("name").agg(F.max_by(F.col("s").cast("long"), F.struct("file", "line")).alias("seconds"))


def metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(run, metric, value, step): the last line of each metrics file of a run store, trash left out."""
    lines = numbered_lines(spark, path).filter("value <> '' and file not like '%/.trash/%'")
    run = F.regexp_extract("file", r"([^/]+)/metrics/[^/]+$", 1)
    metric = F.regexp_extract("file", r"/metrics/([^/]+)$", 1)
    last = lines.select(run.alias("run"), metric.alias("metric"), "line", F.split("value", " ").alias("c")).groupBy("run", "metric").agg(F.max_by("c", "line").alias("c"))
    return last.select("run", "metric", F.col("c")[1].cast("double").alias("value"), F.col("c")[2].cast("long").alias("step"))


def parameter_files(spark: SparkSession, path: str) -> DataFrame:
    """(run, name, value): the params files of a run store, trash left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value")).filter("file not like '%/.trash/%'")
    return whole.select(F.regexp_extract("file", r"([^/]+)/params/[^/]+$", 1).alias("run"), F.regexp_extract("file", r"/params/([^/]+)$", 1).alias("name"), "value")


def best_runs(runs: DataFrame, prefer: str | None = None, states: list[str] | None = None) -> DataFrame:
    """(dataset, run, value): of runs(dataset, run, model, state, value, changed) the one of the preferred model, then the newest, of each dataset.

    Runs without a dataset or a value count for nothing, nor do those of other
    states where states are named; of equally new ones the greatest name wins.
    """
    kept = runs.filter("dataset is not null and value is not null")
    kept = kept.filter(F.col("state").isin(states)) if states is not None else kept
    first = F.coalesce(F.col("model") == prefer, F.lit(False)).cast("int") if prefer else F.lit(0)
    best = kept.groupBy("dataset").agg(F.max(F.struct(first.alias("p"), "changed", "run", "value")).alias("b"))
    return best.select("dataset", "b.run", "b.value")


def choose_splits(spans_by_split: DataFrame) -> DataFrame:
    """(dataset, fit_split, eval_split, status) of (dataset, split, n_sentences, n_spans).

    train falls back to validation, and test does. status: failed_load_train,
    failed_load_test, failed_fit (no span to fit on), no_eval_spans or ok.
    """
    cell = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    names = [f"{s}_{c}" for s in ("train", "validation", "test") for c in ("n_sentences", "n_spans")]
    wide = spans_by_split.groupBy("dataset").agg(*[cell(*n.split("_", 1)).alias(n) for n in names])
    pick = lambda s: F.when(F.col(f"{s}_n_sentences").isNotNull(), s).when(F.col("validation_n_sentences").isNotNull(), "validation")
    spans_of = lambda s: F.coalesce(F.when(F.col(f"{s}_n_sentences").isNotNull(), F.col(f"{s}_n_spans")).otherwise(F.col("validation_n_spans")), F.lit(0))
    status = F.when(pick("train").isNull(), "failed_load_train").when(pick("test").isNull(), "failed_load_test").when(spans_of("train") == 0, "failed_fit").when(spans_of("test") == 0, "no_eval_spans").otherwise("ok")
    return wide.select("dataset", pick("train").alias("fit_split"), pick("test").alias("eval_split"), status.alias("status"))
