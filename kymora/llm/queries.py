"""The corpus queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm.common import fold_of
from kymora.session import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.knn import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), bits=4)


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.sketches import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.quality import quality_scores

    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.hmm import language_scores

    scored = language_scores(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.records import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.toxicity import toxicity_scores

    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2, threshold=0.3)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kymora.llm.bpe import bpe_round_trip

    got = bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    decimals = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return got.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimals.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn": op1_knn,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_sketches": op4_sketches,
    "op5_quality": op5_quality,
    "op6_hmm": op6_hmm,
    "op7_sharding": op7_sharding,
    "op8_records": op8_records,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    # Brute force: every query with every candidate, in blocks of DuckDB's own.
    "op1_knn": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    # The checksum byte by byte over its table of 256 remainders; the jumps in 128-bit arithmetic.
    "op7_sharding": """
        WITH RECURSIVE t AS (
            SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)
        ), d AS (
            SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
        ), c AS (
            SELECT n, doc_id, size,
                xor(4294967295, list_reduce(list_transform(bytes, lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS text_crc32
            FROM d, t
        ), j(doc_id, shards, key, cur, nxt) AS (
            SELECT DISTINCT doc_id, s, (CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616 ELSE 0 END + coalesce(doc_id, 0))::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (8), (9)) v(s)
            UNION ALL
            SELECT doc_id, shards, k, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
            FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM j WHERE nxt < shards)
        ), s AS (
            SELECT doc_id, shards, max(cur) AS shard FROM j GROUP BY 1, 2
        )
        SELECT c.doc_id, c.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
            row_number() OVER (PARTITION BY a.shard ORDER BY c.doc_id NULLS FIRST, c.text_crc32, c.size) - 1 AS slot, b.shard::INTEGER AS grown_shard
        FROM c JOIN s a ON c.doc_id IS NOT DISTINCT FROM a.doc_id AND a.shards = 8 JOIN s b ON c.doc_id IS NOT DISTINCT FROM b.doc_id AND b.shards = 9
    """,
}
