"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontamination, fill_in_middle, licenses, mixing, near_dedup, quality, substring_dedup, suffix_dedup, vector_codes
from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.language_id import identify
from tidewell.llm.packing import pack_documents
from tidewell.llm.secrets import find_secrets

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir), shingle=2, percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir)).drop("distance")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), span=400)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), TOKENIZER, 1024, 2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), span=13).drop("n_spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10).drop("items")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256).drop("label")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.with_restored_digest(fill_in_middle.fill_in_middle(documents(spark, sf_dir), seed=42, rate=50, spm_rate=80))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_rules, op3_secret_scan, op4_exact_dedup, op5_license_scan, op6_suffix_array_dedup, op7_source_mixing,
        op8_best_fit_packing, op9_substring_dedup, op10_language_id, op11_benchmark_decontamination, op12_vector_codes, op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_suffix_array_dedup": suffix_dedup.oracle_sql(),
    "op9_substring_dedup": substring_dedup.oracle_sql(),
    "op1_minhash_near_dedup": near_dedup.oracle_sql(),
    "op7_source_mixing": mixing.oracle_sql(),
    "op2_quality_rules": quality.oracle_sql(),
    "op5_license_scan": licenses.oracle_sql(),
    "op11_benchmark_decontamination": decontamination.oracle_sql(),
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_fill_in_middle": fill_in_middle.oracle_sql(),
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
}
