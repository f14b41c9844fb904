"""The corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.exact_dedup import drop_exact_copies
from tidewell.llm.mixing import with_slots
from tidewell.llm.near_dedup import drop_near_copies
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality import keep_good
from tidewell.sources.shared import delete, new_path, scratch, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or lie outside their group's bulk go."""
    return keep_good(docs).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_exact_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more on five-word shingles the smallest doc_id stays."""
    return drop_near_copies(docs, shingle=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Every document, with the slot of its source's scheduled block, for the packing."""
    return with_slots(docs, "slot", weights=weights).select(*COLUMNS, "slot")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024, both in the order of the documents' slots."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2, "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Tokenisation has no SQL; tests/llm/test_packing.py holds the kept documents against brute force and the packing to the schedule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """The stages in turn. A stage's own tables go once its result is written, and that goes once the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.col(c) for c in COLUMNS]), None
    for name, stage in STAGES[:-1]:
        how = {"weights": weights} if stage is mix_sources else {}
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark, name):
            docs = stored(stage(spark, docs, sf_dir, **how), name, path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
