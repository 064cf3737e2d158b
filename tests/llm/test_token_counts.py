import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanforge.llm import token_counts as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "aabcdstrevml'''  \t\n  \x85\x1céßñ漢字१Ⅷ.,!?-_0123456789😀́"


def texts():
    rng = random.Random(5)
    fixed = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|> b", "  <|endoftext|>  x", "<|endoftext|", "it's we're 'rest !'s ''s  's I'll'd", "a" * 3000, " " * 700, "=-" * 900, "x" * 300_000]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 80))) for _ in range(1500)]


def test_equals_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts())]
    got = t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = [(d, len((text or "").encode()), n := len(library.encode(text or "", add_special_tokens=False).ids), n > 512) for d, text, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chunks_compose_as_one_scan():
    go, starts = t.splitter()
    kinds = np.random.default_rng(2).integers(0, 16, 5000).astype(np.uint8)
    state, want = t.FRESH, []
    for k in kinds:
        want.append(starts[k, state])
        state = go[k, state]
    assert t.pretoken_starts(kinds).tolist() == want


def test_graph_is_rebuilt_when_full(monkeypatch):
    monkeypatch.setattr(t, "MOST_STATES", 50)
    text = open(PATH, encoding="utf-8").read()
    counter = t.Counter(t.Merges(text))
    library = Tokenizer.from_file(PATH)
    for word in ["tokenization", "abc" * 40, "überraschung", "zzzzzzzz"]:
        assert counter.count(word.encode()) == len(library.encode(word).ids)


def test_bad_merge_list():
    with pytest.raises(ValueError):
        t.Merges('{"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2, "aab": 3, "aa": 4}, "merges": [["a", "ab"], ["a", "b"], ["a", "a"]]}}')


def test_no_rows(spark):
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    sizes, tokens = t.count_rows(pa.array([], pa.string()), open(PATH, encoding="utf-8").read())
    assert len(sizes) == len(tokens) == 0


def test_words_of_equal_polynomials():
    one, other = ("".join(x[bin(i).count("1") % 2] for i in range(1024)) for x in ("ab", "ba"))
    library = Tokenizer.from_file(PATH)
    _, got = t.count_rows(pa.array([one, other, f"{one} {other}"]), open(PATH, encoding="utf-8").read())
    assert got.tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in (one, other, f"{one} {other}")]


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(t, "word_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    library = Tokenizer.from_file(PATH)
    texts = ["some words of the same length are told apart by their bytes", "xyzq abcd then qzxv"]
    _, got = t.count_rows(pa.array(texts), open(PATH, encoding="utf-8").read())
    assert got.tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
