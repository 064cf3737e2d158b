import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanforge.llm import quality_cnn

from .test_decontamination import brute as contaminated
from .test_near_text import brute as one_of_each
from .test_near_text import edited
from .test_substring_dedup import brute as without_repeats


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(2000)]
    passage, item = [[rng.choice(vocab) for _ in range(n)] for n in (40, 25)]
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        bad = i % 5 == 0
        if i % 7 == 1:
            words[30:30] = passage
        if i % 11 == 2:
            words += item
        if i % 13 == 3 and docs:
            words = edited(rng, docs[-1][1].split(), vocab, 1)
            bad = docs[-1][1].count("$$$") > 10
        docs.append((i, " ".join(w + "$$$" if bad and not w.endswith("$$$") else w for w in words)))
        labels.append((i, int(not bad), 0))
    docs.append((900, None))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), [(1, " ".join(item))]


def test_run_equals_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(quality_cnn, "LEAST_STEPS", 150)
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    accepted = corpus_pipeline.quality(spark, docs, path)
    assert accepted.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in accepted.collect()), key=lambda r: r[0])
    assert 220 < len(rows) < 260 and not any("$$$" in (t or "") for _, t in rows)
    rows = one_of_each(rows)
    rows = [(d, t) for d, _, _, t in without_repeats(rows, 20)]
    dirty = {r[0] for r in contaminated(rows, items)}
    assert dirty
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t in rows:
        if d not in dirty:
            ids = library.encode(t, add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, path).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString(), name


STAGES = dict(corpus_pipeline.STAGES)
#: Names that operators give to columns of their own.
CLASHING = "score n_words n_removed _row_key k component rest doc _text _rest similarity item_id n h fp ids n_tokens marks".split()


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, folder, name):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), path).count() == 0


def test_clashing_names_keep_their_values(spark, folder, monkeypatch):
    monkeypatch.setattr(quality_cnn, "LEAST_STEPS", 20)
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    own = {c: 77.0 + i for i, c in enumerate(CLASHING)}
    docs = docs.selectExpr("*", *(f"double({v}) as {c}" for c, v in own.items()))
    for name in list(STAGES)[:-1]:
        out = STAGES[name](spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert len(rows) > 100 and all(r[c] == v for r in rows for c, v in own.items()), name


def test_nulls_repeats_and_long_texts(spark, folder):
    path, items = folder
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(None, "abc " * 30), (None, None), (1, None), (1, ""), (1, "same words " * 3), (1, "same words " * 3), (2, long), (3, long + " end"), (4, items[0][1])]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in STAGES["near_dedup"](spark, docs, path).collect()), key=str)
    assert kept == sorted([(None, None), (None, "abc " * 30), (1, "same words " * 3), (2, long), (4, items[0][1])], key=str)
    cleared = STAGES["substring_dedup"](spark, docs, path).collect()
    assert sorted(len(r.text) for r in cleared if r.doc_id in (2, 3)) == [3, len(long)]
    assert len(cleared) == len(odd) and all(r.n_chars == len(r.text) for r in cleared)
    clean = STAGES["decontamination"](spark, docs, path).collect()
    assert sorted((r.doc_id or -1 for r in clean)) == [-1, -1, 1, 1, 1, 1, 2, 3]
    coded = STAGES["bpe"](spark, docs, path).collect()
    assert len(coded) == len(odd) and sorted(r.n_tokens for r in coded)[:3] == [0, 0, 0]
    assert STAGES["quality"](spark, docs, path).columns == docs.columns
