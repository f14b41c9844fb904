"""Vector code compression by integer codebooks.

A vector is cut into equal parts, and each part is coded by the nearest entry of its position's
codebook. Components are whole numbers (floor(scale * x)), so distances, sums and means are exact
and do not depend on how rows are dealt to tasks.

Codebooks have a size bounded by parameters (entries x length of a vector) and are broadcast. Arrow
batches compute all distances as |x|^2 - 2 x.c + |c|^2 by int64 matrix products and take the first
least one. A task adds up what its parts hold for each entry and sends one row an entry; a grouped
shuffle merges these rows, with partial sums, in each round. Vectors themselves never move.

Defined results: rows whose vector is null, or holds null, NaN or infinite components, are dropped;
a null vec_id stands after all others, and equal vec_ids in the order of their vectors; fewer rows
than entries make smaller codebooks; an empty table gives no rows; other columns are not read.
Vectors of different lengths, of a length that the parts don't divide, or so large that a squared
distance might pass 63 bits raise a ValueError in the driver, before any code is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FEW_ROWS, stored

CHUNK = 2048  # vectors whose distances to all entries are held at once


def whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """The vectors of a list column as whole numbers, one row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(-1, dim)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, the first of equals, for each part position and vector.

    vectors: (n, dim); books: (parts, entries, dim / parts); both int64.
    """
    parts, _, width = books.shape
    x = vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2)
    own = (x * x).sum(axis=2)
    far = own[:, :, None] - 2 * np.matmul(x, books.transpose(0, 2, 1)) + (books * books).sum(axis=2)[:, None, :]
    code = far.argmin(axis=2)
    return code, np.take_along_axis(far, code[:, :, None], axis=2)[:, :, 0]


def sums_of(vectors: np.ndarray, code: np.ndarray, books: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add the parts of each entry to total (parts, entries, width) and their numbers to count (parts, entries)."""
    parts, entries, width = books.shape
    entry = code + np.arange(parts)[:, None] * entries
    np.add.at(count.reshape(-1), entry.ravel(), 1)
    place = (entry[:, :, None] * width + np.arange(width)).ravel()
    np.add.at(total.reshape(-1), place, vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2).ravel())


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and vec of the rows whose vectors are whole and finite."""
    src = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return src.filter(F.col("vec").isNotNull() & F.forall("vec", finite))


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The parts of the `entries` smallest vec_ids as codebooks (parts, entries, width); None without rows. Checks what the arithmetic needs."""
    size = F.size("vec")
    most = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    found = kept.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(most).alias("peak")).first()
    if found["least"] is None:
        return None
    dim, peak = found["least"], int((found["peak"] or 0) * scale) + 1
    if dim != found["most"] or dim % parts:
        raise ValueError(f"vectors have {found['least']} to {found['most']} components; all must have as many, a multiple of {parts}")
    if dim * (2 * peak) ** 2 >= 1 << 63:
        raise ValueError(f"components reach {found['peak']:g}: exact distances need more than 63 bits")
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()  # `entries` rows at most
    values = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), dim)
    return np.floor(values * scale).astype(np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy()


def moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
        for b in batches:
            x = whole(b.column("vec"), parts * width, scale)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                sums_of(part, nearest(part, now)[0], now, total, count)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    partial = kept.select("vec").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)]
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # parts x entries rows at most
    out = books.copy()
    for r in merged:
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    sent.unpersist()
    return out


def fit_codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray | None:
    books = first_books(kept, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = moved(kept, books, scale)
    return books


def code_schema(kept: DataFrame) -> str:
    return f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"


def encode(kept: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distances summed over the parts)."""
    parts, _, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column("vec"), parts * width, scale)
            codes, errors = [], []
            for at in range(0, len(x), CHUNK):
                code, far = nearest(x[at : at + CHUNK], sent.value)
                said = code.T.astype(np.uint8).tobytes().hex()
                codes += [said[k : k + 2 * parts] for k in range(0, len(said), 2 * parts)]
                errors.append(far.sum(axis=0))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, code_schema(kept))


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error of each kept row; the codebooks (parts, entries, width), None without rows)."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = fit_codebooks(kept, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], code_schema(kept)), None
    return encode(kept, books, scale), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes (stored) with label_error: the errors of equal labels summed, nulls together.

    Sums are folded before they move. Few labels are broadcast; of more, each row goes to its
    label's sum with a salt, so no task gets all rows of a frequent label.
    """
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "code-sums").withColumnRenamed("label", "of")
    if sums.count() <= FEW_ROWS:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salts = 32
    each = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return dealt.join(each, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to"))).drop("of", "to", "salt")


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, **columns: str) -> DataFrame:
    """Per kept row: vec_id, label, code, error, label_error and codebooks_sha256."""
    codes, books = compress(vectors, parts, entries, rounds, scale, **columns)
    said = books_digest(books) if books is not None else None
    return with_label_errors(stored(codes, "codes")).withColumn("codebooks_sha256", F.lit(said).cast("string"))


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """codes with vec: the entries that the code names, divided by scale."""
    parts = books.shape[0]
    sent = codes.sparkSession.sparkContext.broadcast(books.transpose(0, 1, 2) / scale)

    @F.pandas_udf("array<double>")
    def look_up(code):
        import pandas as pd

        at = np.frombuffer(bytes.fromhex("".join(code)), np.uint8).reshape(len(code), parts)
        return pd.Series(list(sent.value[np.arange(parts), at].reshape(len(code), -1)))

    return codes.withColumn("vec", look_up("code"))


def oracle_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The query's rows by comparing every part with every entry."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT r, k, w[k * len(w) // {parts} + 1:(k + 1) * len(w) // {parts}] AS x FROM v, range(0, {parts}) t(k))""",
        f"c0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= {entries})",
    ]
    assign = "a{0} AS MATERIALIZED (SELECT r, k, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p.k, e, list_sum(list_transform(list_zip(x, c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS d FROM p JOIN c{0} c ON p.k = c.k) GROUP BY r, k)"
    for i in range(rounds):
        steps += [
            assign.format(i),
            f"""m{i} AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT a.k, a.e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
                FROM a{i} a JOIN p ON a.r = p.r AND a.k = p.k, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY a.k, a.e, i) GROUP BY k, e)""",
            f"c{i + 1} AS MATERIALIZED (SELECT o.k, o.e, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} n ON o.k = n.k AND o.e = n.e)",
        ]
    return f"""
        WITH {", ".join(steps)}, {assign.format(rounds)},
        s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{rounds}),
        z AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN v ON z.r = v.r, s"""
