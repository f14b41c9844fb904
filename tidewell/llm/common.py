"""What the corpus operators share: shared storage, row identity, even ranking and checked small joins.

Every operator reads its input through :func:`ids_and_text`, which keeps the id and text
columns alone, so further columns of any name cannot clash with an operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.shared import shared_dir, stored

__all__ = ["SPACE", "FEW_ROWS", "FEW_IDS", "ids_and_text", "join_small", "md5_long", "packed", "parts_for", "ranks_of_hash", "running", "shared_dir", "stored", "with_ids"]

#: ASCII white space; what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"
FEW_ROWS = 100_000  # rows of parameters, some hundred bytes each, that may be broadcast
FEW_IDS = 2_000_000  # ids that may be broadcast: 16 MB, some 60 MB in an executor
SALTS = 32


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def md5_long(*cols: Column) -> Column:
    """A non-negative 60-bit hash that other SQL engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined to small (stored) on key. Up to FEW_ROWS rows of small are broadcast; more are joined on key and salt.

    With salts each row of small goes to SALTS tasks, so no task gets all rows of a hot key.
    """
    if small.count() <= FEW_ROWS:
        return big.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(each, [key, "_salt"], how).drop("_salt")


def ranks_of_hash(h: Column, parts: int) -> Column:
    """Which of `parts` equal ranges of 0 .. 2**60 - 1 a hash falls in; order by it is part of the order by h."""
    return F.floor(h / F.lit(float(1 << 60)) * F.lit(parts)).cast("int")


def parts_for(spark: SparkSession, least: int = 64) -> int:
    """How many ranges a hot key's rows are dealt to: they grow with the session's shuffle partitions."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def running(df: DataFrame, group: list[str], part: str, order: list[Column], out: str, measure: str | None = None, narrow: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group from 0 (or sum `measure` over the rows before), a group spread over parts.

    part: a column that grows with the order, so that results do not depend on how many parts
    there are. Rows are ranked inside (group, part) and shifted by the totals of the parts
    before; no task holds a whole group, and rows move once, with all their columns. The totals
    are read from narrow (by default df), which should be stored or cheap.
    """
    one = F.col(measure) if measure else F.lit(1).cast("long")
    totals = (narrow or df).groupBy(*group, part).agg(F.sum(one).alias("_sum"))
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shift = stored(totals.select(*[F.col(c).alias(f"_{c}") for c in [*group, part]], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift")), "shifts")
    inner = W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("_inner", F.coalesce(F.sum(one).over(inner), F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, part]])
    if shift.count() <= FEW_ROWS:
        shift = F.broadcast(shift)
    return ranked.join(shift, on, "left").select(*df.columns, (F.col("_inner") + F.col("_shift")).alias(out))


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as one struct), doc_id and text: no name of docs can clash with another."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs, all columns, whose doc_id is in ids (stored; null matches null), or is not for left_anti.

    Up to FEW_IDS ids are broadcast, so texts stay where they are; more ids are joined by a shuffle.
    """
    ids = ids.select(F.col("doc_id").alias("named_id"))
    few = ids.count() <= FEW_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(F.col("named_id")), how)
