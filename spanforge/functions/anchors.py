"""Anchor words of label names, templates and prompt text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the two anchor styles: templates, acronyms and the suffixes of glued names.
TEMPLATES = ("{a}", "a {a}", "the {a}", "an example of {a}")
SHORT_ACRONYMS = {
    "per": ["person", "individual", "human"],
    "org": ["organization", "organisation", "company"],
    "loc": ["location", "place"],
    "gpe": ["country", "city", "place"],
    "misc": ["miscellaneous"],
}
LONG_ACRONYMS = {
    "per": ["person", "individual", "name", "human"],
    "org": ["organization", "company", "institution", "team"],
    "loc": ["location", "place", "city", "country"],
    "misc": ["miscellaneous", "other", "event", "work"],
    "gpe": ["country", "state", "city", "location"],
    "dna": ["dna", "gene", "nucleic acid"],
    "rna": ["rna", "ribonucleic acid"],
}
SUFFIXES = ("journal", "compound", "element", "artist", "genre", "instrument", "object", "party", "lang", "name", "work", "group", "song", "book")
MOST_ANCHORS = 5


def _words(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    out = _words()
    for name, words in table.items():
        out = F.when(key == name, _words(*words)).otherwise(out)
    return out


def _solid(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda w: w != ""))


def short_anchors(label: Column) -> Column:
    """The joined name, the acronym's words, and the single words where there are several.

    Names break at separators and between a small and a capital letter; order is kept.
    """
    raw = F.trim(label)
    spaced = F.regexp_replace(F.regexp_replace(raw, r"[-_\s/]+", " "), "(?<=[a-z])(?=[A-Z])", " ")
    joined = F.lower(F.trim(spaced))
    words = F.filter(F.split(joined, r"\s+"), lambda w: w != "")
    found = _solid(F.concat(F.array(joined), _lookup(SHORT_ACRONYMS, F.lower(raw)), F.when(F.size(words) > 1, words).otherwise(_words())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lower(raw)))


def long_anchors(label: Column) -> Column:
    """At most MOST_ANCHORS: the name broken at separators and before every inner capital, its words, acronyms, glued suffixes."""
    raw = F.trim(label)
    parts = F.filter(F.split(raw, r"[-_\s/]+"), lambda w: w != "")
    words = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "(?<!^)(?=[A-Z])", " ")))
    words = F.filter(F.split(F.lower(F.array_join(words, " ")), " "), lambda w: w != "")
    name, low = F.array_join(words, " "), F.lower(raw)
    base = F.concat(F.when(F.size(words) > 0, F.array(name)).otherwise(_words()), F.when(F.size(words) > 1, words).otherwise(_words()))
    base = F.when(F.array_contains(base, low), base).otherwise(F.concat(base, F.array(low)))
    more = F.flatten(F.transform(F.concat(words, F.array(low)), lambda w: _lookup(LONG_ACRONYMS, w)))
    one, glued = F.element_at(words, 1), _words()
    for suffix in reversed(SUFFIXES):
        stem = F.substring(one, F.lit(1), F.char_length(one) - len(suffix))
        glued = F.when(one.endswith(suffix) & (one != suffix), F.array(F.concat(stem, F.lit(f" {suffix}")), F.lit(suffix), stem)).otherwise(glued)
    glued = F.when((F.size(words) == 1) & (F.char_length(one) > 8), glued).otherwise(_words())
    return F.slice(_solid(F.concat(base, more, glued)), 1, MOST_ANCHORS)


def resolve(labels: DataFrame, curated: DataFrame) -> DataFrame:
    """(block, label, words, is_curated): the curated words of a block's label, else the long anchors."""
    joined = labels.join(F.broadcast(curated.withColumnRenamed("words", "own")), ["block", "label"], "left")
    return joined.select("block", "label", F.coalesce("own", long_anchors(F.col("label"))).alias("words"), F.col("own").isNotNull().alias("is_curated"))


def expand_templates(anchors: DataFrame) -> DataFrame:
    """(label, pos, word, template, text, at): every anchor in every template, and where its text first occurs there."""
    spark = anchors.sparkSession
    templates = F.broadcast(spark.createDataFrame(list(enumerate(TEMPLATES)), "template int, pattern string"))
    rows = anchors.select("label", F.posexplode("words").alias("pos", "word")).crossJoin(templates)
    rows = rows.withColumn("text", F.replace("pattern", F.lit("{a}"), F.col("word")))
    return rows.select("label", "pos", "word", "template", "text", (F.expr("instr(text, word)") - 1).alias("at"))


def task_prefix(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("nomic"), "classification: ").when(m.contains("e5"), "query: ").otherwise("")
