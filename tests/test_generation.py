"""Batches by length, answers for every row, and adapters against one text at a time."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge import generation as g

LABELS = {"CAP": "a word with a capital", "LONG": "a long word"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.integers(1, 9), st.integers(1, 900))
def test_batches_cover_rows_within_bounds(sizes, rows, padded):
    sizes = np.sort(np.array(sizes, np.int64))
    at = 0
    for a, b in g.batches_of(sizes, rows, padded):
        assert a == at < b and b - a <= rows and (b - a == 1 or (b - a) * sizes[b - 1] <= padded)
        at = b
    assert at == len(sizes)


class Counting:
    def __init__(self, limit):
        self.limit, self.calls = limit, []

    def generate(self, prompts, new_tokens):
        self.calls.append(len(prompts))
        if len(prompts) > self.limit:
            raise RuntimeError("CUDA Out Of Memory, sorry")
        return [p.upper() for p in prompts]


def test_batches_are_halved():
    model = Counting(3)
    assert g.attempt(model, list("abcdefgh"), 1) == list("ABCDEFGH")
    assert model.calls == [8, 4, 2, 2, 4, 2, 2]
    assert g.attempt(Counting(0), ["a", "b"], 1) == [None, None]


def test_other_errors_stay_errors():
    class Broken:
        def generate(self, prompts, new_tokens):
            raise RuntimeError("no such device")

    class Short:
        def generate(self, prompts, new_tokens):
            return prompts[1:]

    with pytest.raises(RuntimeError, match="device"):
        g.attempt(Broken(), ["a"], 1)
    with pytest.raises(ValueError):
        g.attempt(Short(), ["a", "b"], 1)


class Upper:
    def generate(self, prompts, new_tokens):
        if len(prompts) * max(map(len, prompts)) > 400:
            raise MemoryError
        return [p.upper() for p in prompts]


def test_answers_equal_those_one_by_one(spark):
    rows = [(i, "x" * (i * 37 % 450) if i % 10 else None, "same") for i in range(300)] + [(7, "yy", "same")] * 3
    table = spark.createDataFrame(rows, "id long, p string, answer string").repartition(4)
    got = sorted(map(tuple, g.answers(table, "p", Upper(), most_padded=10_000).collect()), key=str)
    want = [(i, p, p.upper() if p is not None and len(p) <= 400 else None, g.NO_PROMPT if p is None else g.NO_MEMORY if len(p) > 400 else None) for i, p, _ in rows]
    assert got == sorted(want, key=str)
    assert g.answers(table.limit(0), "p", Upper()).count() == 0
    plan = g.answers(table, "p", Upper())._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(size" in plan


TEXTS = ["The  cat sat in Rome near Rome", "extraordinary things of Extraordinary people", "no name", "", None, "Rome (old) [x] extraordinarily", '"Quoted" A', "Zürich und internationale Straßenbahnen", "Abc Abcdefghijklmn"]


def one_by_one(text):
    """Spans of every word of a kind, and of the first of each kind in its first free place."""
    words = re.sub(r"\s+", " ", text or "").strip().split(" ")
    every, at = [], 0
    for w in words:
        if k := g.RuleModel.kind(w):
            every.append((at, at + len(w), k))
        at += len(w) + 1
    line, first = " ".join(words), []
    for kind in LABELS:
        w = next((w for w in words if g.RuleModel.kind(w) == kind), None)
        spots = [i for i in range(len(line)) if w and line.startswith(w, i) and not any(i < e and s < i + len(w) for s, e, _ in first)]
        if spots:
            first.append((spots[0], spots[0] + len(w), kind))
    return every, first


@pytest.mark.parametrize("adapter", list(g.ADAPTERS))
def test_adapters(spark, adapter):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "sent_id long, text string")
    found, failed = g.tag(table, adapter, g.RuleModel(), {**LABELS} if adapter != "described_questions" else {"CAP": "CAP", "LONG": "LONG"}, most_rows=3)
    got = {i: [] for i in range(len(TEXTS))}
    for r in found.collect():
        got[r.sent_id].append((r.start_off, r.end_off, r.label))
    for i, text in enumerate(TEXTS):
        if adapter == "word_tags" and text and "(" in text:
            continue
        assert sorted(got[i]) == sorted(one_by_one(text)[adapter != "word_tags"]), (adapter, text)
    assert failed.count() == 0


def test_failures_are_rows(spark):
    class Odd:
        def generate(self, prompts, new_tokens):
            if len(prompts) > 1 or "huge" in prompts[0]:
                raise MemoryError
            return ["I would rather not."]

    table = spark.createDataFrame([(1, "huge text"), (2, "small text"), (3, " ")], "sent_id long, text string")
    found, failed = g.tag(table, "any_json", Odd(), LABELS)
    assert found.count() == 0
    assert sorted(map(tuple, failed.collect())) == [(1, 0, g.NO_MEMORY), (2, 0, g.NOTHING_READ)]
    with pytest.raises(KeyError):
        g.tag(table, "none", Odd(), LABELS)
