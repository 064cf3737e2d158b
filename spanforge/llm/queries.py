"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_gru import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_golay import fingerprint_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .histogram_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_max import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pivot_index": op3_pivot_index,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_decontamination": op9_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_block_max_search": op12_block_max_search,
    "op13_importance_resampling": op13_importance_resampling,
}

#: What half a byte adds to a CRC-32, by the polynomial of the reflected form.
_NIBBLES = [reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), i) for i in range(16)]
#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
    """,
    "op2_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS MATERIALIZED (SELECT doc_id, i, ws[i] AS w, CASE WHEN i + 19 <= len(ws) THEN sha256(array_to_string(ws[i:i + 19], ' ')) END AS s FROM d, unnest(range(1, len(ws) + 1)) r(i)),
        m AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM g),
        c AS (SELECT *, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
        k AS (SELECT doc_id, count(*) AS n, count(CASE WHEN gone THEN 1 END) AS r, string_agg(CASE WHEN NOT gone THEN w END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op13_importance_resampling": rf"""
        WITH t AS (SELECT doc_id AS id, false AS target, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
        d AS MATERIALIZED (SELECT id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
        g AS MATERIALIZED (SELECT id, target, array_to_string(ws[i:i + k - 1], ' ') AS f FROM d, unnest(range(1, len(ws) + 1)) r(i), (VALUES (1), (2), (3)) n(k) WHERE i + k - 1 <= len(ws)),
        x AS (SELECT f, lower(hex(encode(f))) AS h FROM (SELECT DISTINCT f FROM g)),
        b AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h)), lambda j: instr('0123456789abcdef', h[j + 2 - 2 * (j % 2)]) - 1), lambda c, v: xor(c >> 4, {_NIBBLES}[(xor(c, v) & 15) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM x),
        c AS (SELECT bucket, count(CASE WHEN NOT target THEN 1 END) AS s, count(CASE WHEN target THEN 1 END) AS t FROM g JOIN b USING (f) GROUP BY bucket),
        n AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM c),
        q AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM c, n),
        w AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM g JOIN b USING (f) JOIN q USING (bucket) WHERE NOT target GROUP BY id),
        a AS (SELECT d.id AS doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w ON w.id = d.id WHERE NOT target),
        e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM a WHERE words >= 20)
        SELECT a.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * many // 100 THEN rank END AS rank FROM a LEFT JOIN e USING (doc_id)
    """,
    "op11_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op12_block_max_search": r"""
        WITH t AS MATERIALIZED (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), q AS (SELECT item_id, term, count(*) AS n FROM i GROUP BY ALL),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
        s AS (
            SELECT item_id, p.doc_id, sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * d.n * docs) // total)))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.doc_id = p.doc_id, c GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20
    """,
}
