"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import chat, cotraining, exact_dedup, licenses, packing, pii, probminhash, records, sp_bpe, spotsigs
from tarn.llm.tokens import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.token_records(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op4_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


_ALL = (
    op1_token_records,
    op2_nnls_packing,
    op3_probminhash,
    op4_perspective_chat,
    op5_license_dice,
    op6_content_sort_dedup,
    op7_pii_boosting,
    op8_sentencepiece_bpe,
    op9_cotraining,
    op10_spotsigs,
)
QUERIES = {f.__name__: f for f in _ALL}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_perspective_chat": chat.ORACLE_SQL,
    "op5_license_dice": licenses.oracle_sql(),
    "op6_content_sort_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm)""",
}
