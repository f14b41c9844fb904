"""What a run leaves behind: tables written once, manifests, lineage, a ledger. All are DataFrames on shared storage."""

from __future__ import annotations

import dataclasses
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import lineage, validate
from tidewell.policy import digest

ENTRY = "job string, state string, detail string"
STAGE = "stage string, artifact string, sha256 string, size long"


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write a table that must not exist yet, and read it back; a failed job leaves no table (Spark's commit protocol)."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_projection(spark: SparkSession, path: str, columns: list[str], text: list[str] = ()) -> DataFrame:
    """The wanted columns of CSV tables by their header; those in text stay text, nulls in them are empty."""
    header = spark.read.csv(path, header=True, inferSchema=False).columns
    if gone := [c for c in columns if c not in header]:
        raise ValueError(f"missing columns: {gone}")
    out = spark.read.csv(path, header=True, inferSchema=False).select(*columns)
    kinds = {c: "string" if c in text else "double" for c in columns}
    enforce = [c for c in columns if kinds[c] == "double"]
    if enforce:
        validate.enforce(validate.not_numeric(out, enforce), "cells that are no numbers")
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) if c in text else F.col(c).cast("double").alias(c) for c in columns])


def runtime_manifest(spark: SparkSession, run: str, *policies) -> DataFrame:
    """(run, name, value): policies, their digest, versions and the session's settings."""
    said = {f"policy.{type(p).__name__}": json.dumps(dataclasses.asdict(p), sort_keys=True, separators=(",", ":")) for p in policies}
    said |= {"policy.digest": digest(*policies), "spark.version": spark.version}
    said |= {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    return spark.createDataFrame([(run, k, v) for k, v in sorted(said.items())], "run string, name string, value string")


def stage_manifest(hashes: DataFrame, stage: str, root: str) -> DataFrame:
    """(stage, artifact, sha256, size) of file_hashes' rows below root, by path relative to it; others are an error."""
    relative = F.regexp_replace("artifact", "^[a-z0-9]+:/*(?=/)", "")
    root = root.rstrip("/") + "/"
    validate.enforce(hashes.filter(~F.startswith(relative, F.lit(root)) | relative.rlike(r"(^|/)\.\.(/|$)")).select("artifact"), "artifacts outside the run")
    return hashes.select(F.lit(stage).alias("stage"), F.substr(relative, F.lit(len(root) + 1)).alias("artifact"), "sha256", "size")


def stage_violations(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(artifact, what): what is missing, unexpected or changed since the manifest was written."""
    return lineage.artifact_differences(manifest, now)


def lineage_of(stages: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from stage manifests and uses (stage, input): every artifact of a stage depends on the artifacts of its inputs.

    nodes: artifact, stage, sha256. edges: node, input, sha256 of the input as it was.
    """
    nodes = stages.select("artifact", "stage", "sha256")
    before = stages.select(F.col("stage").alias("input_stage"), F.col("artifact").alias("input"), "sha256")
    edges = nodes.select(F.col("artifact").alias("node"), "stage").join(uses, "stage").join(before, F.col("input_stage") == F.col("uses")).select("node", "input", "sha256")
    return nodes, edges


def promote(stages: DataFrame, now: DataFrame, uses: DataFrame, path: str) -> DataFrame:
    """Write the run's final manifest, once, if every artifact is as its stage left it, no stage depends on itself and no product is behind a change."""
    validate.enforce(stage_violations(stages, now), "artifacts differ from their manifests")
    nodes, edges = lineage_of(stages, uses)
    validate.enforce(lineage.cyclic(uses.select(F.col("stage").alias("node"), F.col("uses").alias("input"))), "stages that use each other")
    validate.enforce(lineage.stale(nodes, edges, now), "artifacts behind a change")
    return write_once(nodes, path)


def recomputed(written: dict[str, DataFrame], again: dict[str, tuple[DataFrame, list[str]]], rtol: float = 0.0) -> DataFrame:
    """(artifact, rows, differences) of tables held against the same tables made again: again has the frame and its keys by name."""
    if odd := set(written) ^ set(again):
        raise validate.Violation(f"artifacts on one side only: {sorted(odd)}")
    parts = []
    for name, (frame, keys) in sorted(again.items()):
        was = written[name]
        if sorted(was.dtypes) != sorted(frame.dtypes):
            raise validate.Violation(f"{name}: columns differ")
        differs = validate.frame_differences(was, frame, keys, rtol).agg(F.count("*").alias("differences"))
        parts.append(was.agg(F.count("*").alias("rows")).join(differs).select(F.lit(name).alias("artifact"), "rows", "differences"))  # a row each
    return reduce(DataFrame.unionByName, parts)


def gate(written: dict[str, DataFrame], again: dict[str, tuple[DataFrame, list[str]]], stages: DataFrame, now: DataFrame, uses: DataFrame, path: str, rtol: float = 0.0) -> DataFrame:
    """The whole run's gate: every artifact made again is equal, then the manifest is promoted."""
    validate.enforce(recomputed(written, again, rtol).filter("differences > 0"), "artifacts that are not what they are made of")
    return promote(stages, now, uses, path)


def append_ledger(spark: SparkSession, path: str, rows: list[tuple[str, str, str]]) -> None:
    spark.createDataFrame(rows, ENTRY).write.mode("append").parquet(path)


def open_jobs(ledger: DataFrame) -> DataFrame:
    """Jobs that were submitted and have no final entry."""
    done = ledger.filter(F.col("state") != "submitted").select("job").distinct()
    return ledger.filter("state = 'submitted'").select("job").distinct().join(done, "job", "left_anti")
