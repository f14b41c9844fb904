"""Exact dedup with counting quotient filters.

A text's 64-bit fingerprint splits into a quotient (high bits: the filter's slot, which also
deals filters out to tasks) and a remainder. Each partition builds a counting quotient filter:
per slot, its sorted remainders with counts. Filters of the same slots merge without loss, as
sorted runs whose equal remainders add their counts; a key of any frequency is one entry per
partition. Fingerprints counted more than once go on to byte verification.

Defined results: a null text counts as empty; an empty table gives no rows; among equal texts
the largest doc_id stays (nulls last), and of rows that repeat that doc_id one row stays;
other columns are not read. Whole texts are compared, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text, packed, stored, with_ids

ROWS = "doc_id long, fp long, text_sha256 string"
BATCH = 1 << 20


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # bytes.lower() changes A-Z alone; UTF-8 of other letters has no such bytes
        texts = [(t or "").encode().lower() for t in b.column("text").to_pylist()]
        fp = pa.array(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64))
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, sha], ["doc_id", "fp", "text_sha256"])


def row_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64-bit fingerprint) and text_sha256 of every row's normalised text."""
    return ids_and_text(docs, id_col, text_col).mapInArrow(_row_digests, ROWS)


def quotient_filters(fps: DataFrame, quotient_bits: int) -> DataFrame:
    """One row for each slot of each partition's counting quotient filter.

    slot; remainders and counts as packed little-endian 64-bit runs, sorted by remainder.
    """
    shift = np.uint64(64 - quotient_bits)

    def emit(part: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(part), return_counts=True)  # sorted: quotient, then remainder
        slots = (keys >> shift).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        rest = keys & np.uint64((1 << int(shift)) - 1)
        counts = counts.astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(slots[starts]), pa.array([rest[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            ["slot", "remainders", "counts"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= BATCH:  # a filter of bounded size; more filters of one partition merge like any others
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return fps.select("fp").mapInArrow(build, "slot long, remainders binary, counts binary")


def repeated_fingerprints(filters: DataFrame, quotient_bits: int) -> DataFrame:
    """Merge the filters of each slot; fp and count of the fingerprints counted above one."""
    shift = np.uint64(64 - quotient_bits)

    def merge(t: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("remainders").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])
        order = np.argsort(rest, kind="stable")  # runs are sorted already: a merge
        rest, counts = rest[order], counts[order]
        starts = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        total = np.add.reduceat(counts, starts)
        slot = np.uint64(t.column("slot")[0].as_py())
        fp = (slot << shift) | rest[starts]
        many = total > 1
        return pa.table({"fp": fp[many].view(np.int64), "n": total[many]})

    return filters.groupBy("slot").applyInArrow(merge, "fp long, n long")


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t or "").encode().lower() for t in b.column("text").to_pylist()]
        fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        sha = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(sha, pa.string()), pa.array(texts, pa.binary())], ["fp", "text_sha256", "body"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", quotient_bits: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    quotient_bits: 2**quotient_bits slots, by default 16 for each shuffle partition, so that a
    slot's merged run stays small at the size the session is set up for.
    """
    return _verdicts(docs, id_col, text_col, quotient_bits).drop("row_id")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, quotient_bits: int | None) -> DataFrame:
    spark = docs.sparkSession
    if quotient_bits is None:
        quotient_bits = min(24, max(4, (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    src = ids_and_text(docs, id_col, text_col)
    rows = stored(row_digests(src).withColumn("row_id", F.monotonically_increasing_id()), "exact-rows")
    many = stored(repeated_fingerprints(quotient_filters(rows, quotient_bits), quotient_bits), "exact-counts")
    # Byte verification. Rows of repeated fingerprints only; equal bytes fold before the shuffle.
    some = stored(rows.join(many.select("fp"), "fp", "left_semi"), "exact-some")
    same = (
        with_ids(src, stored(some.select("doc_id").distinct(), "exact-ids")).mapInArrow(_normalised, "fp long, text_sha256 string, body binary")
        .groupBy("fp", "text_sha256").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
        .filter("lo = hi").select("fp", "text_sha256")
    )
    best = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_id")
    groups = some.groupBy("fp", "text_sha256").agg(F.max(best).alias("best"), F.count("*").alias("size")).filter("size > 1")
    groups = stored(groups.join(same, ["fp", "text_sha256"], "left_semi"), "exact-groups")
    # groups is read from files, so where one text's rows make a hot key AQE may split their side of the join
    joined = rows.join(groups, ["fp", "text_sha256"], "left")
    alone = F.col("best").isNull()
    return joined.select(
        "row_id", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("best.row_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops.

    Rows go by the ids of the dropped ones, which are fewer than those that stay. A doc_id that is on several rows
    does not name a row: its rows are told apart by their texts.
    """
    found = stored(_verdicts(docs, "doc_id", "text", None), "exact-verdicts")
    gone = stored(found.filter("NOT kept").select("doc_id").distinct(), "exact-dropped")
    repeats = stored(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "exact-repeats")
    rows = packed(docs)
    if repeats.isEmpty():
        return with_ids(rows, gone, "left_anti").select("row.*")
    once = with_ids(with_ids(rows, repeats, "left_anti"), gone, "left_anti")
    body = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    many = with_ids(rows, repeats).withColumn("text_sha256", F.sha2(body, 256)).dropDuplicates(["doc_id", "text_sha256"])
    wanted = found.filter("kept").select(F.col("doc_id").alias("want_id"), F.col("text_sha256").alias("want_sha"))
    many = many.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_sha256") == F.col("want_sha")), "left_semi")
    return once.select("row.*").union(many.select("row.*"))
