"""Hashes of files of any length, JSON manifests and CSV tables that read back as they were."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewell.operators import validate
from tidewell.sources.archives import PIECE, opened

PARTITION_BYTES = 256 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


class HashReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path.rstrip("/"), partition_bytes

    def partitions(self) -> list[Files]:
        store, at = opened(self.path)
        found = sorted((x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File), key=lambda x: x.path)
        out, held, size = [], [], 0
        for x in found:
            held.append(f"{self.path}/{x.path.removeprefix(at.rstrip('/')).lstrip('/')}")
            size += x.size
            if size >= self.partition_bytes:
                out, held, size = [*out, Files(held)], [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            store, at = opened(path)
            said, size = hashlib.sha256(), 0
            with store.open_input_stream(at) as f:
                while data := f.read(PIECE):
                    said.update(data)
                    size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([said.hexdigest()]), pa.array([size], pa.int64())], ["artifact", "sha256", "size"])


class HashSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "artifact string, sha256 string, size long"

    def reader(self, schema: StructType) -> HashReader:
        return HashReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def links_below(path: str) -> list[str]:
    """Symbolic links among the files and folders below path, where its file system has any: those mounted as local ones."""
    store, at = opened(path)
    if not isinstance(store, fs.LocalFileSystem):
        return []
    return sorted(p for top, folders, names in os.walk(at) for n in (*folders, *names) if os.path.islink(p := os.path.join(top, n)))


def file_hashes(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """artifact (path), sha256 and size of every file below path, read in pieces. Links are refused: they would let a hash name what lies elsewhere."""
    if links := links_below(path):
        raise validate.Violation(f"links among the artifacts: {links[:3]}")
    spark.dataSource.register(HashSource)
    return spark.read.format("file_hashes").option("partition_bytes", partition_bytes).load(path)


def json_manifests(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """One row for each JSON file below path. Malformed files, values of other types and missing or null required fields are errors."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    found = found.withColumn("artifact", F.col("_metadata.file_path"))
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    validate.enforce(found.select("artifact", lacking.alias("missing")).filter(F.size("missing") > 0), "manifests without required fields")
    return found


def write_csv_once(df: DataFrame, path: str) -> DataFrame:
    """Write CSV with a header that must not exist yet, and read it back with df's own types; fails unless every cell reads back as it was.

    Doubles are written in the digits that give the same number again; empty text is told from null by quotes.
    """
    df.write.mode("errorifexists").csv(path, header=True, emptyValue='""', nullValue="", escape='"', quoteAll=False)
    again = df.sparkSession.read.schema(df.schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", escape='"', emptyValue="", nullValue=None, multiLine=True)
    validate.enforce(df.exceptAll(again).union(again.exceptAll(df)), "cells that CSV changes")
    return again


def binary_column(df: DataFrame, column: str) -> DataFrame:
    """df with the column as int: whole 0 or 1 in every row, and a row at least; checked before anything is cast."""
    value = F.col(column).cast("double")
    rules = {f"{column} other than 0 and 1": ~F.coalesce(value.isin(0.0, 1.0), F.lit(False))}
    found = df.agg(F.count("*").alias("rows"), *validate.checks(rules, [column])).first().asDict()
    if not found["rows"]:
        raise validate.Violation(f"{column}: no rows")
    validate.report(found, rules)
    return df.withColumn(column, value.cast("int"))
