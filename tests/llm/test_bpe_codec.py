import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanforge.llm import bpe_codec

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbBcdstrevml'''  \t\n  \x85éßñÉΣςİ漢字१Ⅷ.,!?-_0123456789😀́"


def texts():
    rng = random.Random(6)
    fixed = [None, "", " ", "\n", "<|endoftext|>", "A<|startoftext|>b <|endoftext|>", "<|endoftext|", "It's WE'RE", "ΑΣ ΑΣΑ", "a" * 3000, "!" * 700, "ab" * 50_000]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 80))) for _ in range(1500)]


def test_equals_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts())]
    coded = bpe_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH)
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_codec.digests(coded).collect()), key=str) == sorted(want, key=str)


def codec():
    return bpe_codec._codec(open(PATH, encoding="utf-8").read())


def test_stream_is_bounded_and_early():
    encoder = codec().encoder
    for word in ["abracadabra" * 200, "aaaaaaaaaaaaab" * 100, "ingtheringand" * 150, "!?!?!?..." * 150]:
        read, out = 0, 0

        def tape():
            nonlocal read
            for symbol in encoder.merges.word(word.encode()):
                read += 1
                yield symbol

        for some in encoder.stream(tape()):
            out += sum(len(encoder.merges.text[t]) for t in some)
            assert read - out <= encoder.stretch
        assert out == read


def test_lookahead_suffices(monkeypatch):
    encoder, rng = codec().encoder, random.Random(3)
    common = [t for t in encoder.merges.ids if 1 < len(t) < 9 and t.isascii() and t.isalpha()]
    words = ["".join(rng.choices(common, k=150)) for _ in range(60)] + ["".join(rng.choices(s, k=900)) for s in ("ab", "aehinorst", "!?.-", "lmnosxy") for _ in range(15)]
    for word in words:
        symbols = encoder.merges.word(word.encode())
        monkeypatch.setattr(encoder, "stretch", 10**9)
        (whole,) = encoder.stream(symbols)
        monkeypatch.setattr(encoder, "stretch", encoder.lookahead + 1)
        parts = list(encoder.stream(symbols))
        assert len(parts) > 10 and sum(parts, []) == whole


def test_query_uses_the_bound_and_the_machine(monkeypatch):
    c = bpe_codec.Codec(open(PATH, encoding="utf-8").read())
    assert c.encoder.lookahead == c.merges.lookahead > 0
    fed = []
    monkeypatch.setattr(c.machine, "feed", lambda tokens, feed=c.machine.feed: (fed.append(len(tokens)), feed(tokens))[1])
    monkeypatch.setattr(bpe_codec, "PIECE", 7)
    ids = c.encode("one two three " * 20)
    library = Tokenizer.from_file(PATH)
    assert c.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert sum(fed) == len(ids) // 4 and max(fed) == 7


def test_text_machine():
    c = codec()
    machine = bpe_codec.TextMachine(c.merges, plain=False)
    ids = np.frombuffer(c.encode("Naïve 漢字 😀, ok<|endoftext|>"), "<u4").tolist()
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "naïve 漢字 😀, ok <|endoftext|>"
    assert machine.feed([ids[0]]) == machine.feed([ids[0]])


def test_no_rows(spark):
    assert bpe_codec.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
