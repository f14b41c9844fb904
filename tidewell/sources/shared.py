"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TASKS = 4  # for each core

_own_dirs: dict[str, str] = {}
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset on one machine (tests), a new one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidewell-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "tidewell", *_scopes, f"{name}-{uuid.uuid4().hex}"])


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder (a new path in it) and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame) -> DataFrame:
    """df, a stored table that is read many times, by a few tasks for each core: the driver keeps notes of every task of its last thousand stages."""
    return df.coalesce(max(16, TASKS * df.sparkSession.sparkContext.defaultParallelism))


class Bucketed:
    """A table in the shared folder whose rows stand in buckets of a column; joins on that column shuffle the other side alone.

    Rows are added piece by piece. Buckets are known by the table's name: forget() drops the name and leaves the files.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.key, self.buckets, self.path = spark, key, buckets, new_path(spark, name)
        self.name = "tidewell_" + self.path.rsplit("-", 1)[1]

    def add(self, df: DataFrame) -> DataFrame:
        """The whole table, with df's rows in it; df should be partitioned by the key, in as many parts, so that a bucket is one file."""
        df.write.mode("append").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name, format="parquet")
        return self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is stored inside goes when the block ends; its results must have been written elsewhere by then."""
    scope = f"{name}-{uuid.uuid4().hex}"
    path = "/".join([shared_dir(spark), "tidewell", *_scopes, scope])
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.pop()
        delete(spark, path)
