"""Structured sources and sinks: document JSON, report JSON, YAML, registry, resumable results."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spans
from ..session import cut, ship

DOC_JSON = "documents array<struct<id:string,sentences:array<array<string>>,entities:array<struct<type:string,sentence_idx:int,start_word_idx:int,end_word_idx:int>>>>, metadata struct<entity_types:array<string>>"

# Tag order of the static id maps.
TAG_MAPS = {
    "mit_restaurant": ["O", "B-Rating", "I-Rating", "B-Amenity", "I-Amenity", "B-Location", "I-Location", "B-Restaurant_Name", "I-Restaurant_Name", "B-Price", "I-Price", "B-Hours", "I-Hours", "B-Dish", "I-Dish", "B-Cuisine", "I-Cuisine"],
    "bionlp2004": ["O", "B-DNA", "I-DNA", "B-protein", "I-protein", "B-cell_type", "I-cell_type", "B-cell_line", "I-cell_line", "B-RNA", "I-RNA"],
    "mit_movie_trivia": ["O", "I-ACTOR", "I-YEAR", "I-TITLE", "I-GENRE", "I-DIRECTOR", "I-SONG", "I-PLOT", "I-REVIEW", "I-CHARACTER", "I-RATING", "I-RATINGS_AVERAGE", "I-TRAILER", "B-ACTOR", "B-YEAR", "B-TITLE", "B-GENRE", "B-DIRECTOR", "B-SONG", "B-PLOT", "B-REVIEW", "B-CHARACTER", "B-RATING", "B-RATINGS_AVERAGE", "B-TRAILER"],
}


class Registry:
    """Corpora by name: a kind of source and where it lies."""

    def __init__(self):
        self._known: dict[str, dict] = {}

    def add(self, name: str, kind: str, path: str, tags: str | None = None, columns: tuple[str, str] = ("tokens", "tags"), files: dict[str, str] | None = None, corpus: str | None = None, listed: str | None = None) -> None:
        """A corpus: its kind of source and path, in which {split} stands for the split or for what files names it.

        parquet_tags: columns of tokens and tags; tags names a map of TAG_MAPS, or a text
        file with a tag a line, for tags that are numbers. conllu: corpus is main or
        special, whose documents listed, a split list, deals to the splits.
        """
        if kind not in ("bio_text", "parquet_tags", "conllu", "doc_json"):
            raise ValueError(f"unknown kind of source {kind}")
        self._known[name] = {"kind": kind, "path": path, "tags": tags, "columns": columns, "files": files or {}, "corpus": corpus, "listed": listed}

    def names(self) -> list[str]:
        return sorted(self._known)

    def read(self, spark: SparkSession, name: str, split: str, most: int | None = None) -> DataFrame:
        """(sent_id or file and sent_id, text, spans) of one split; {split} in the path is filled in."""
        from . import text_formats as t

        if name not in self._known:
            raise KeyError(f"unknown corpus {name}; known: {', '.join(self.names())}")
        known = self._known[name]
        kind, path = known["kind"], known["path"].replace("{split}", known["files"].get(split, split))
        if kind == "bio_text":
            return t.load_corpus(t.bio_text(spark, path), ["file", "sent_id"], "sent_id", most)
        if kind == "parquet_tags":
            rows = spark.read.parquet(path).withColumnsRenamed(dict(zip(known["columns"], ("tokens", "tags"))))
            tags = known["tags"]
            names = TAG_MAPS.get(tags) or ([r.value for r in t.numbered_lines(spark, tags).orderBy("line").collect() if r.value] if tags else None)
            rows = t.decode_tags(rows, names) if names else rows
            if "sent_id" not in rows.columns:
                rows = cut(rows).withColumn("sent_id", F.monotonically_increasing_id())
            return t.load_corpus(t.explode_tokens(rows, ["sent_id"]), ["sent_id"], "sent_id", most)
        if kind == "conllu":
            words = t.conllu(spark, path)
            if known["corpus"]:
                named = words.withColumn("doc", F.regexp_extract("file", r"([^/]+)\.conllu$", 1))
                kept = t.documents_of(named.select("doc").distinct(), t.split_list(spark, known["listed"]), known["corpus"], split)
                words = named.join(kept, "doc", "left_semi").drop("doc")
            found = spans.nest(t.bracket_spans(words, ["file", "sent_id"]), ["file", "sent_id"])
            text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ")
            out = words.groupBy("file", "sent_id").agg(text.alias("text")).join(found, ["file", "sent_id"])
            return out if most is None else out.orderBy("file", "sent_id").limit(most)
        return read_doc_json(spark, path)


#: The corpora known by name, of each the kind of its source, its columns and what names its tags.
CORPORA = {
    "crossner": ("parquet_tags", "ner_tags", "labels"),
    "wnut17": ("parquet_tags", "ner_tags", "labels"),
    "mit_restaurant": ("parquet_tags", "tags", "mit_restaurant"),
    "fabner": ("parquet_tags", "ner_tags", "labels"),
    "bionlp2004": ("parquet_tags", "tags", "bionlp2004"),
    "conll2003": ("parquet_tags", "ner_tags", "labels"),
    "crossner_ai": ("bio_text", None, None),
    "crossner_literature": ("bio_text", None, None),
    "crossner_music": ("bio_text", None, None),
    "crossner_politics": ("bio_text", None, None),
    "crossner_science": ("bio_text", None, None),
    "mit_movie": ("parquet_tags", "tags", "mit_movie_trivia"),
    "gum": ("conllu", "main", None),
    "gentle": ("conllu", "special", None),
}


def standard_registry(root: str) -> Registry:
    """A registry of CORPORA below a folder: NAME/SPLIT.parquet with NAME/labels.txt, NAME/SPLIT.txt with dev for validation, or gum/dep/*.conllu with gum/splits.md."""
    from .text_formats import SPLIT_FILES

    out = Registry()
    for name, (kind, column, tags) in CORPORA.items():
        if kind == "parquet_tags":
            out.add(name, kind, f"{root}/{name}/{{split}}.parquet", f"{root}/{name}/labels.txt" if tags == "labels" else tags, ("tokens", column))
        elif kind == "bio_text":
            out.add(name, kind, f"{root}/{name}/{{split}}.txt", files=SPLIT_FILES)
        else:
            out.add(name, kind, f"{root}/gum/dep/*.conllu", corpus=column, listed=f"{root}/gum/splits.md")
    return out


def read_doc_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, sent_id, text, spans): word spans of document JSON as character spans."""
    return doc_json_spans(spark.read.schema(DOC_JSON).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*"))


def doc_json_spans(docs: DataFrame) -> DataFrame:
    """read_doc_json of documents (id, sentences, entities). A document stays a row: its entities, in order of their sentences, are cut by them."""
    ship(docs.sparkSession)
    part = lambda e: F.struct(e["sentence_idx"].alias("at"), e["type"].alias("label"), e["start_word_idx"].alias("a"), e["end_word_idx"].alias("b"))
    rows = docs.select("id", "sentences", F.sort_array(F.transform(F.filter(F.coalesce("entities", F.array().cast(ENTITIES)), lambda e: e["sentence_idx"].isNotNull()), part)).alias("e"))
    nth = F.transform("sentences", lambda w, i: i)
    rows = rows.withColumn("r", spans.covering(F.col("e.at"), F.col("e.at"), F.transform(nth, lambda i: i - 1), F.transform(nth, lambda i: i + 1)))
    rows = rows.select("id", F.posexplode(F.arrays_zip("sentences", F.transform("r", lambda r: F.slice("e", r["a"] + 1, r["b"] - r["a"])).alias("e"))).alias("sent_id", "z"))
    rows = rows.select("id", "sent_id", F.col("z.sentences").alias("words"), F.col("z.e").alias("e")).withColumn("starts", spans.starts("words"))
    rows = rows.withColumn("text", F.array_join("words", " ")).withColumn("size", F.char_length("text"))
    end = lambda i: F.when(i == 0, 0).otherwise(F.coalesce(F.get("starts", i - 1) + F.char_length(F.get("words", i - 1)), F.when(i.isNotNull(), F.col("size"))))
    span = lambda e: F.struct(F.when(e["a"] == 0, 0).otherwise(end(e["a"]) + 1).alias("start_off"), end(e["b"]).alias("end_off"), e["label"].alias("label"))
    return rows.select("id", "sent_id", "text", F.sort_array(F.transform("e", span)).alias("spans"))


ENTITIES = "array<struct<type:string,sentence_idx:int,start_word_idx:int,end_word_idx:int>>"


def to_doc_json(corpus: DataFrame) -> DataFrame:
    """(id, sentences, entities): word spans of (sent_id, text, spans), a row a sentence; spans that cover no word are dropped."""
    rows = spans.line_words(corpus.select("sent_id", "text", F.col("spans").alias("s")), ["sent_id", "text", "s"]).withColumn("s", F.coalesce("s", F.array().cast("array<struct<start_off:int,end_off:int,label:string>>")))
    ends = F.zip_with("starts", "words", lambda s, w: s + F.char_length(w))
    rows = rows.withColumn("c", spans.covering(F.col("starts"), ends, F.col("s.start_off"), F.col("s.end_off")))
    entity = lambda s, c: F.struct(s["label"].alias("type"), F.lit(0).alias("sentence_idx"), c["a"].alias("start_word_idx"), c["b"].alias("end_word_idx"))
    found = F.filter(F.zip_with("s", "c", entity), lambda e: e["start_word_idx"].isNotNull())
    return rows.select(F.col("sent_id").cast("string").alias("id"), F.array("words").alias("sentences"), found.alias("entities"))


def doc_json_summary(corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of an export: n_docs, n_entities, n_dropped (spans that cover no word) and entity_types in order."""
    asked = corpus.agg(F.sum(F.size("spans")).cast("long").alias("asked"))
    kept = docs.agg(F.count("*").alias("n_docs"), F.sum(F.size("entities")).cast("long").alias("n_entities"))
    # told apart before they meet, so what meets is a row for each type
    types = docs.select(F.explode("entities.type").alias("type")).distinct().agg(F.sort_array(F.collect_list("type")).alias("entity_types"))
    return kept.crossJoin(types).crossJoin(asked).select("n_docs", "n_entities", (F.col("asked") - F.col("n_entities")).alias("n_dropped"), "entity_types")


def dev_sample(docs: DataFrame, n: int = 200) -> DataFrame:
    """The first n documents of a training export, by id as a number: its dev split."""
    return docs.orderBy(F.col("id").try_cast("long").asc_nulls_last(), "id").limit(n)


def read_yaml(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of a list of mappings in a small configuration file."""
    with open(path, encoding="utf-8") as file:
        return spark.createDataFrame(yaml.safe_load(file)[key])


def report_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, metric, value) of report JSON files {results: {dataset: {metric: number}}}; the last file of a dataset wins."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "results map<string,map<string,double>>").alias("r"))
    cells = rows.select("file", F.explode("r.results").alias("dataset", "m"))
    latest = cells.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("file")))).filter("k = 1")
    return latest.select("dataset", F.explode("m").alias("metric", "value")).filter("value is not null")


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


#: Characters that a LaTeX table cell has to escape, and how.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of a LaTeX table, special characters escaped; null is empty."""

    def cell(c: str):
        known = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
        letters = F.filter(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ""), lambda x: x != "")
        return F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")

    return rows.select(F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(r" \\")).alias("line"))


def write_table(lines: DataFrame, columns: list[str], path: str, kind: str = "markdown") -> None:
    """Lines of markdown() or latex() with the head and end of a table, as one text file below path; tables are small."""
    if kind == "markdown":
        head, end = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)], []
    elif kind == "latex":
        named = ["".join(LATEX.get(x, x) for x in c) for c in columns]
        head, end = [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(named) + r" \\", r"\midrule"], [r"\bottomrule", r"\end{tabular}"]
    else:
        raise ValueError(f"unknown kind of table {kind}")
    spark = lines.sparkSession
    placed = lines.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("i"), "line")
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(end)], "part int, i long, line string")
    frame.unionByName(placed).coalesce(1).sortWithinPartitions("part", "i").select("line").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, parameters: dict | None = None) -> None:
    """rows(dataset, metric, value) as one report JSON {params, results: {dataset: {metric: value}}}, which report_metrics reads; a null value is left out."""
    import json

    one = rows.filter("value is not null").groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("m"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("dataset", "m"))), lambda e: F.struct(e["dataset"].alias("key"), F.map_from_entries(e["m"]).alias("value")))
    every = one.agg(F.map_from_entries(entries).alias("results"))
    text = F.concat(F.lit(f'{{"params": {json.dumps(parameters or {}, ensure_ascii=False, sort_keys=True)}, '), F.substring(F.to_json(F.struct("results")), F.lit(2), F.lit(2**31 - 1)))
    every.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def mean_std_cells(rows: DataFrame) -> DataFrame:
    """(model, dataset, cell): mean and deviation of value over seeds, for a table."""
    stats = rows.groupBy("model", "dataset").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))
    return stats.select("model", "dataset", F.format_string("%.1f±%.1f", F.col("m"), F.col("s")).alias("cell"))
