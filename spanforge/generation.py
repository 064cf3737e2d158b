"""Generative models: batches of like length, answers or reasons for every row, and adapters from texts to spans.

No weights come with the library: RuleModel answers by rule, and runs out of
memory above a size as a model does. Any object with its method takes its place;
it is pickled to the executors and loads what it needs there, once a worker.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import parsing
from .operators import spans
from .session import ship

#: A batch holds at most so many prompts, and so many characters when all are padded to the longest.
MOST_ROWS, MOST_PADDED = 64, 1 << 17
NEW_TOKENS = 640
#: Reasons that a row has no answer.
NO_PROMPT, NO_MEMORY, NOTHING_READ = "no prompt", "out of memory", "nothing to read"


class Generator(Protocol):
    def generate(self, prompts: list[str], new_tokens: int) -> list[str]: ...


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).lower()


def attempt(model: Generator, prompts: list[str], new_tokens: int) -> list[str | None]:
    """An answer for each prompt; a batch that memory does not hold is halved, down to a prompt alone, which then has none."""
    try:
        out = model.generate(prompts, new_tokens)
    except (MemoryError, RuntimeError) as error:
        if not out_of_memory(error):
            raise
        if len(prompts) == 1:
            return [None]
        half = len(prompts) // 2
        return attempt(model, prompts[:half], new_tokens) + attempt(model, prompts[half:], new_tokens)
    if len(out) != len(prompts):
        raise ValueError(f"{len(prompts)} prompts gave {len(out)} answers")
    return list(out)


def batches_of(sizes: np.ndarray, most_rows: int, most_padded: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of ascending sizes; each run, padded to its longest, stays within the bound, or is one row."""
    at = 0
    while at < len(sizes):
        ahead = sizes[at : at + most_rows]
        fits = np.flatnonzero(ahead * np.arange(1, len(ahead) + 1) <= most_padded)
        to = at + max(1, int(fits[-1]) + 1 if len(fits) else 1)
        yield at, to
        at = to


def answers(rows: DataFrame, prompt: str, model: Generator, new_tokens: int = NEW_TOKENS, most_rows: int = MOST_ROWS, most_padded: int = MOST_PADDED) -> DataFrame:
    """rows with answer and reason: what the model makes of the prompt, or why there is none.

    Rows are dealt by ranges of the prompt's length (a hash parts equal ones) and
    sorted by it, so prompts of a batch need little padding and long ones fill no
    batch of short ones. All columns come back with their row, so nothing has to be
    put in order again; columns named answer or reason are replaced. A null prompt
    has no answer, nor has one that alone is too large for memory. Other errors of
    the model end the job.
    """
    ship(rows.sparkSession)
    columns = [c for c in rows.columns if c not in ("answer", "reason")]
    boxed = rows.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in columns]).alias("rest"), F.col(prompt).cast("string").alias("prompt"))
    kind = boxed.schema["rest"].dataType.simpleString()
    size = F.coalesce(F.char_length("prompt"), F.lit(0))
    dealt = boxed.withColumn("size", size).repartitionByRange("size", F.xxhash64("prompt")).sortWithinPartitions("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            out: list[str | None] = []
            for a, b in batches_of(np.asarray(batch.column("size")), most_rows, most_padded):
                asked = [p for p in prompts[a:b] if p is not None]
                got = iter(attempt(model, asked, new_tokens) if asked else [])
                out += [None if p is None else next(got) for p in prompts[a:b]]
            reasons = [NO_PROMPT if p is None else NO_MEMORY if o is None else None for p, o in zip(prompts, out)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string()), pa.array(reasons, pa.string())], ["rest", "answer", "reason"])

    made = dealt.mapInArrow(run, f"rest {kind}, answer string, reason string")
    return made.select(*[F.col("rest").getField(c).alias(c) for c in columns], "answer", "reason")


class RuleModel:
    """A stand-in that reads the prompts of this library and finds names by rule: CAP begins with a capital of ASCII, LONG has 12 letters or more.

    Word tags cover every word; lists name the first word of each kind. A batch
    that is larger than limit characters, padded, is out of memory.
    """

    def __init__(self, limit: int | None = None):
        self.limit = limit

    @staticmethod
    def kind(word: str) -> str | None:
        return "CAP" if "A" <= word[:1] <= "Z" else "LONG" if len(word) >= 12 else None

    def _answer(self, prompt: str) -> str:
        if "\nSentence: " in prompt:
            words = prompt.split("\nSentence: ", 1)[1].split(" ")
            return ", ".join(f"{w}({'B-' + k if (k := self.kind(w)) else 'O'})" for w in words)
        question = prompt.startswith("Text: ")
        text = prompt.removeprefix("Text: ").rpartition("\nWhat describes ")[0] if question else prompt.split("\nText: ", 1)[1]
        first: dict[str, str] = {}
        for w in text.split(" "):
            if k := self.kind(w):
                first.setdefault(k, w)
        if question:
            asked = prompt.rpartition("\nWhat describes ")[2].removesuffix(" in the text?")
            return json.dumps([first[asked]] if asked in first else [], ensure_ascii=False)
        return json.dumps([{"text": first[k], "type": k} for k in ("CAP", "LONG") if k in first], ensure_ascii=False)

    def generate(self, prompts: list[str], new_tokens: int) -> list[str]:
        if self.limit is not None and len(prompts) * max(map(len, prompts)) > self.limit:
            raise RuntimeError("device out of memory")
        return [self._answer(p) for p in prompts]


class Adapter(NamedTuple):
    """How a model is asked, and how its answers become spans.

    ask: rows(sent_id, text) and labels to rows(sent_id, text, ask, asked, prompt).
    read: answered rows and labels to (sent_id, start_off, end_off, label).
    readable: whether an answer is of the form asked for.
    """

    ask: Callable[[DataFrame, dict[str, str]], DataFrame]
    read: Callable[[DataFrame, dict[str, str]], DataFrame]
    readable: Callable[[Column], Column]


def _ask_once(prompt: Callable[[Column, list[str]], Column]) -> Callable[[DataFrame, dict[str, str]], DataFrame]:
    return lambda rows, labels: rows.select("sent_id", "text", F.lit(0).alias("ask"), F.lit(None).cast("string").alias("asked"), prompt(F.col("text"), list(labels)).alias("prompt"))


def _ask_each(name: Callable[[str, str], str]) -> Callable[[DataFrame, dict[str, str]], DataFrame]:
    """A question for each label, by what name makes of the label and its description."""

    def ask(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(name(k, d)).alias("name")) for k, d in labels.items()])
        each = rows.select("sent_id", "text", F.posexplode(kinds).alias("ask", "k"))
        return each.select("sent_id", "text", "ask", F.col("k.label").alias("asked"), parsing.question_prompt(F.col("text"), F.col("k.name")).alias("prompt"))

    return ask


def _read_tags(answered: DataFrame, labels: dict[str, str]) -> DataFrame:
    rows = answered.select("sent_id", F.filter(F.split("text", " "), lambda w: w != "").alias("words"), F.col("answer").alias("output"))
    tagged = parsing.realigned(rows, ["sent_id"])
    return spans.bio_spans(spans.token_offsets(tagged, ["sent_id"]), ["sent_id"]).select("sent_id", "start_off", "end_off", "label")


def _placed(found: DataFrame, entities: Column) -> DataFrame:
    return found.select("sent_id", F.explode(entities).alias("s")).select("sent_id", "s.start_off", "s.end_off", "s.label")


def _read_questions(answered: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The mentions of all questions of a sentence, placed in the order of the labels; a place is taken once."""
    mentions = F.transform(parsing.first_json_strings(F.col("answer")), lambda m: F.struct(m.alias("text"), F.col("asked").alias("label")))
    each = answered.select("sent_id", "text", F.struct("ask", mentions.alias("m")).alias("a"))
    one = each.groupBy("sent_id").agg(F.any_value("text").alias("text"), F.flatten(F.transform(F.sort_array(F.collect_list("a")), lambda a: a["m"])).alias("entities"))
    return _placed(one, parsing.placed_spans(F.col("text"), F.col("entities")))


def _read_exact(answered: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Entities whose type is a label as it stands."""
    known = F.filter(parsing.json_entities(F.col("answer")), lambda e: e["type"].isin(list(labels)) & (e["text"] != ""))
    return _placed(answered, parsing.placed_spans(F.col("text"), F.transform(known, lambda e: F.struct(e["text"].alias("text"), e["type"].alias("label")))))


def _read_any(answered: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Entities whose type is a label in any writing."""
    return _placed(answered, parsing.typed_entities(F.col("answer"), F.col("text"), list(labels)))


_LISTED = lambda a: F.coalesce(a.rlike(r"(?s)\[.*\]"), F.lit(False))
#: Ways of answering by name: word tags, a question for each label or its description, and JSON with exact types or with any writing of them.
ADAPTERS: dict[str, Adapter] = {
    "word_tags": Adapter(_ask_once(parsing.tagging_prompt), _read_tags, lambda a: a.rlike(parsing.PAIR)),
    "questions": Adapter(_ask_each(lambda label, _: label.replace("_", " ")), _read_questions, _LISTED),
    "described_questions": Adapter(_ask_each(lambda _, description: description), _read_questions, _LISTED),
    "exact_json": Adapter(_ask_once(parsing.extraction_prompt), _read_exact, _LISTED),
    "any_json": Adapter(_ask_once(parsing.extraction_prompt), _read_any, _LISTED),
}


def tag(texts: DataFrame, adapter: str, model: Generator, labels: dict[str, str], **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Spans (sent_id, start_off, end_off, label) and failures (sent_id, ask, reason) of texts(sent_id, text) by one of ADAPTERS.

    labels: descriptions by label, in the order asked. Offsets count in the text
    single-spaced. Texts without a word are not asked. A failure is a question
    without an answer, or with one that is not of the form asked for; the spans are
    those of the other answers.
    """
    if adapter not in ADAPTERS:
        raise KeyError(f"unknown adapter {adapter}; known: {', '.join(ADAPTERS)}")
    way = ADAPTERS[adapter]
    rows = texts.select("sent_id", spans.collapse_space("text").alias("text")).filter("text <> ''")
    answered = answers(way.ask(rows, labels), "prompt", model, **sizes)
    readable = F.col("answer").isNotNull() & way.readable(F.col("answer"))
    failed = answered.filter(~readable).select("sent_id", "ask", F.coalesce("reason", F.lit(NOTHING_READ)).alias("reason"))
    return way.read(answered.filter(readable), labels), failed
