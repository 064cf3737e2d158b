"""What a query must not do at size: plans and rows that do not depend on how much there is."""

import io
import math
import zlib
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from spanforge.api import ZeroShotTyper
from spanforge.models import HashedNgrams, WordPatterns
from spanforge.operators import decode, spans, triplets, vectors
from spanforge.plans import catalog
from spanforge.sources import reports


def plan(df):
    """The plan as Spark would begin it."""
    said = io.StringIO()
    with redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_flattened_reports_meet_nothing(spark):
    rows = [(1, '{"a": {}, "b": [[], null, {"c": []}]}'), (2, "[]"), (3, "{}"), (4, '{"d": null}'), (5, "null"), (6, None), (7, "{")]
    out = reports.flattened(spark.createDataFrame(rows, "id long, text string"), "id")
    got = sorted((r.id, r.path, r.kind, r.value) for r in out.collect())
    assert got == [(1, ".a", "OBJECT", None), (1, ".b[0]", "ARRAY", None), (1, ".b[1]", "NULL", None), (1, ".b[2].c", "ARRAY", None), (2, "", "ARRAY", None), (3, "", "OBJECT", None), (4, ".d", "NULL", None), (5, "", "NULL", None), (7, "", "INVALID", None)]
    assert "Join" not in plan(out) and "Exchange" not in plan(out)


def test_lines_are_not_shuffled(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("token_offsets", "bio_to_spans_lenient", "char_span_to_word_idx", "word_span_to_char", "span_in_context", "span_windowed", "kwic", "doc_json_entities", "doc_json_round_trip"):
        said = plan(catalog.QUERIES[name](spark, sf))
        assert "Exchange" not in said and "Join" not in said and "Window" not in said, name
    assert "Join" not in plan(catalog.QUERIES["split_summary"](spark, sf))


def test_lines_of_files_are_sorted_once(spark):
    sf = "/root/testdata/sf0.001"
    assert plan(catalog.QUERIES["bio_text_rows"](spark, sf)).count(" Sort ") == 1
    assert plan(catalog.QUERIES["conllu_words"](spark, sf)).count(" Sort ") == 2
    assert "Join" not in plan(catalog.QUERIES["conllu_spans"](spark, sf))


def test_blocks_are_read_whole(spark):
    for name in ("bio_text_splits", "conllu_splits"):
        said = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Exchange" not in said and "Aggregate" not in said, name


def test_hashed_trigrams_are_what_crc32_says():
    texts = ["", "a", "é", "日本 x", "İstanbul", "\U0001f600", "A\x00b", *("Abc é 日本Z9 \u2003x" * k for k in range(40))]
    want = np.zeros((len(texts), 16))
    for row, text in zip(want, texts):
        padded = f"  {text.lower()} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            row[h % 16] += 1 if h >> 16 & 1 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert (HashedNgrams(16).encode(texts) == want).all() and HashedNgrams(16).encode([]).shape == (0, 16)


def test_mentions_are_typed_where_they_lie(spark):
    texts = spark.createDataFrame([(i, f"Ann met B{i} and understandably") for i in range(9)], "sent_id long, text string")
    found = ZeroShotTyper(WordPatterns({"CAP": "[A-Z]", "LONG": ".{12}"}), HashedNgrams(16), beta=100.0).predict(texts, ["CAP", "LONG"])
    said = plan(found)
    assert "Window" not in said and "hashpartitioning(sent_id" not in said and "hashpartitioning(vec_id" not in said
    assert sorted((r.sent_id, r.start_off, r.span, r.label) for r in found.collect() if r.sent_id == 3) == [(3, 0, "Ann", "CAP"), (3, 8, "B3", "CAP"), (3, 15, "understandably", "LONG")]


def test_nearest_equals_best_label(spark):
    nan = float("nan")
    rows = [(i, [math.sin(i), math.cos(i)], "abc"[i % 3], i / 20) for i in range(20)] + [(20, [nan, 1.0], "b", 1.0), (21, None, None, 1.0), (22, [0.0, 0.0], "c", 0.0)]
    mentions = spark.createDataFrame(rows, "vec_id long, vec array<double>, cand_label string, score double")
    protos = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("c", [-1.0, 0.0])], "label string, vec array<double>")
    for beta in (None, 0.5):
        sims = vectors.similarities(mentions, protos, ["vec_id", "cand_label", "score"])
        want = vectors.best_label(sims if beta is None else vectors.fuse(sims, beta), ["vec_id"])
        assert sorted((r.vec_id, r.label) for r in vectors.nearest(mentions, protos, ["vec_id"], beta).collect()) == sorted((r.vec_id, r.label) for r in want.collect())
    assert vectors.nearest(mentions, protos.limit(0), ["vec_id"]).count() == 0


def test_closed_sets_are_decoded_where_they_lie(spark):
    said = plan(catalog.QUERIES["closed_set_spans"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in said and "Join" not in said and "Window" not in said


def test_sentences_are_decoded_together():
    rng = np.random.default_rng(7)
    start, step = decode.allowed(decode.bio_tags(["X", "Y"]))
    for sizes in ([], [0], [0, 1, 0, 5, 3, 3, 17, 1, 0], [40]):
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        scores = rng.integers(0, 4, (bounds[-1], 5)).astype(float)
        want = [decode.best_sequence(scores[a:b], start, step) for a, b in zip(bounds, bounds[1:])]
        assert decode.best_sequences(scores, bounds, start, step).tolist() == [t for w in want for t in w]


def test_only_drawn_entities_are_looked_for(spark):
    """Items are numbered once, and what is not an anchor is not joined to be dropped after."""
    said = plan(catalog.QUERIES["entity_entity_triplets"](spark, "/root/testdata/sf0.001"))
    assert "LeftSemi" not in said and "Window [row_number" not in said and "lineitem" not in said
    items = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "id long, label string")
    every, some = triplets.sample(items, 2, "s"), triplets.sample(items, 2, "s", anchors=F.col("id") % 7 == 2)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in every.collect() if r.anchor % 7 == 2)


def test_line_spans_equal_bio_spans(spark):
    tags = ["O", "B-X", "I-X", "I-Y", "COMMA", "COMMA", "O", "I-X", "B-X", None, "I-X-Z", "B-"]
    rows = [(k, p, "w" * (1 + (p * k) % 5), tags[(p * k + p) % len(tags)]) for k in range(1, 9) for p in range(k * 3)]
    frame = spark.createDataFrame(rows, "k int, pos int, token string, tag string")
    for strict in (False, True):
        want = sorted(map(tuple, spans.bio_spans(spans.token_offsets(frame, ["k"]), ["k"], strict).collect()))
        one = frame.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("w")).select("k", F.col("w.token").alias("words"), F.col("w.tag").alias("tags")).withColumn("starts", spans.starts("words"))
        got = one.select("k", F.explode_outer(spans.line_spans("words", "starts", "tags", strict)).alias("s")).filter("s is not null").select("k", "s.*")
        assert sorted(map(tuple, got.collect())) == want
