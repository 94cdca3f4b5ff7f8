"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import byte_cnn, chat, decontaminate, filter_audit, licenses, media, merkle, near_dedup, packing, pieces, pii, quality_rules, warc
from lodestream.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.profile(_table(spark, sf_dir, "documents"), rate=4000)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.Measure(width=3, percent=85))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(materialize(chat.format_conversations(turns.unionByName(planted)), "chat-formatted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_license_scans, op3_pii, op4_media_columns, op5_sentencepiece, op6_warc, op7_quality_rules, op8_minhash_near_dedup, op9_chat_formatting, op10_quality_classifier,
        op11_filter_audit, op12_merkle_manifest, op13_decontamination,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op2_license_scans": licenses.oracle_sql(),
    "op7_quality_rules": quality_rules.oracle_sql(),
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
    "op13_decontamination": decontaminate.oracle_sql(),
    "op8_minhash_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN words ELSE list_slice(words, i::INT, i::INT + 2) END AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON reach.other = ends.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
        v AS (SELECT page_id, n, hex, min(page_id) OVER (PARTITION BY hex) AS least,
                     list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(hex, i::INT, 1)) - 1) AS digits FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     ((((CASE WHEN 5 * k // 4 + 1 < 40 THEN digits[(5 * k // 4 + 1)::INT] * 16 + digits[(5 * k // 4 + 2)::INT]
                              ELSE digits[40] * 16 END) // CAST(power(2, 3 - (5 * k) % 4) AS BIGINT)) % 32) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > least THEN least END AS refers_to
        FROM v""",
    "op9_chat_formatting": r"""
        WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
        e AS (SELECT *, length(replace(replace(replace(replace(replace(text, chr(92), '__'), '<s>', '<_s>'), '</s>', '<_/s>'), '[INST]', '[_INST]'), '[/INST]', '[_/INST]')) AS text_chars,
                     length(replace(replace(replace(replace(replace(replace(role, chr(92), '__'), '<s>', '<_s>'), '</s>', '<_/s>'), '[INST]', '[_INST]'), '[/INST]', '[_/INST]'), chr(10), '__')) AS role_chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(text_chars + role_chars + 9) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
