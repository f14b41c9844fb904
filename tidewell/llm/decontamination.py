"""Benchmark decontamination by suffix arrays of the training texts.

Test items become word sequences; every place in them is a test suffix. Training documents are read
in shards of bounded size, inside a task and without a shuffle. A shard writes its documents as
word numbers of the items' vocabulary; words that no item has end a match, so only runs of known
words go into the shard's suffix array, which prefix doubling builds to the depth of the longest
item. All test suffixes are then searched at once: each narrows its range of the array word by
word, by binary search, until nothing is left. The depth reached is its longest verbatim match, the
range there its locations, and the range at a window's depth marks the document words to be hit.
Equal windows of the items are searched once, so a shard's locations grow with its words.

Items are sent to all executors in passes of at most PASS_BYTES of text; more items make more
passes over the documents, whose results meet by row.

Defined results: null has no words; an item without words hits nothing; rows that repeat an
item_id are one item with the windows of all of them, and an item without id hits words but is not
listed; a null doc_id stays null; rows that repeat a doc_id are judged each on its own; an
empty documents table gives no rows, an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidewell.llm.common import ids_and_text, packed, stored

SHARD_BYTES = 8 << 20  # of texts whose suffixes are sorted together
PASS_BYTES = 16 << 20  # of items that are broadcast at once; some ten times that in a worker
#: A-Z to a-z, and every other ASCII character but letters and digits to a blank; bytes above are parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Tests:
    """Items as one sequence of word numbers from 1, each followed by a 0."""

    number: dict[bytes, int]
    symbols: np.ndarray  # int64
    suffix: np.ndarray  # where each place of each item is in symbols
    item: np.ndarray  # which row of ids each suffix is of
    room: np.ndarray  # words from each suffix to its item's end
    need: np.ndarray  # words of the window that starts at each suffix, 0 if none does
    window: np.ndarray  # which distinct window that is, or -1
    first: np.ndarray  # one suffix of each distinct window
    ids: list[str | None]

    @property
    def least(self) -> int:
        """Words of the shortest window."""
        return int(self.need[self.first].min()) if len(self.first) else 0


def tests_of(rows: list[tuple[str | None, str | None]], width: int) -> Tests:
    """The tests of (item_id, text) rows."""
    number: dict[bytes, int] = {}
    symbols, suffix, item, room, need = [], [], [], [], []
    for i, (_, text) in enumerate(rows):
        words = words_of(text)
        n, at = len(words), len(symbols)
        symbols += [number.setdefault(w, len(number) + 1) for w in words]
        symbols.append(0)
        suffix += range(at, at + n)
        item += repeat(i, n)
        room += range(n, 0, -1)
        w = min(n, width)
        need += [w if k + w <= n else 0 for k in range(n)]
    seen: dict[tuple[int, ...], int] = {}
    window = [seen.setdefault(tuple(symbols[s : s + w]), len(seen)) if w else -1 for s, w in zip(suffix, need)]
    window_of = np.array(window, np.int64)
    _, first = np.unique(window_of, return_index=True)
    first = first[window_of[first] >= 0]
    return Tests(number, *(np.array(x, np.int64) for x in (symbols, suffix, item, room, need)), window_of, first, [i for i, _ in rows])


def suffix_array(text: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """Starts of all suffixes of text (numbers below letters), in the order of their first `depth` symbols at least; the end stands before all.

    Prefix doubling: the first ranks are of as many symbols as 62 bits hold, each further sort is of pairs of ranks.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(letters).bit_length())
    span = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        key[: max(0, n - k)] |= text[k:] + 1
    while True:
        order = np.argsort(key)
        new = np.r_[True, key[order[1:]] != key[order[:-1]]]
        if span >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[: max(0, n - span)] += rank[span:]
        span *= 2


def search(order: np.ndarray, text: np.ndarray, tests: Tests, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of some test suffixes: longest match, the range of order with it, and the range at its window's depth.

    Every step looks for one more word in all ranges that are not empty, by two binary searches.
    """

    def bound(low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first place of each range whose symbol at this depth is not below word."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            place = order[mid] + depth
            symbol = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], -1)
            less = symbol < word[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]

    n = len(some)
    longest, at_low, at_high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    win_low, win_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, depth = np.arange(n) if len(order) else np.zeros(0, np.int64), 0
    while len(live):
        live = live[tests.room[some[live]] > depth]
        word = tests.symbols[tests.suffix[some[live]] + depth]
        low = bound(at_low[live], at_high[live], depth, word)
        high = bound(low, at_high[live], depth, word + 1)
        good = low < high
        live, low, high, depth = live[good], low[good], high[good], depth + 1
        longest[live], at_low[live], at_high[live] = depth, low, high
        whole = tests.need[some[live]] == depth
        win_low[live[whole]], win_high[live[whole]] = low[whole], high[whole]
    return longest, at_low, at_high, win_low, win_high


@dataclass
class Shard:
    """A shard's documents: lengths in words, and their runs of known words as one text with 0 after each run."""

    lengths: list[int]
    text: np.ndarray
    doc: np.ndarray  # of each place in text
    word: np.ndarray  # its place in the document
    order: np.ndarray


def shard_of(texts: list[str | None], tests: Tests) -> Shard:
    lengths, parts, docs, places = [], [], [], []
    least = tests.least
    for d, t in enumerate(texts):
        words = words_of(t)
        lengths.append(len(words))
        if not least or len(words) < least:
            continue
        known = np.fromiter(map(tests.number.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[False, known > 0, False]))
        start, end = edge[::2], edge[1::2]
        good = end - start >= least
        for a, b in zip(start[good], end[good]):
            parts += [known[a:b], [0]]
            docs.append(np.full(b - a + 1, d))
            places.append(np.arange(a, b + 1))
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    text = join(parts)
    depth = int(tests.room.max()) if len(tests.room) else 1
    return Shard(lengths, text, join(docs), join(places), suffix_array(text, len(tests.number) + 2, depth))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in the ranges."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def hits(shard: Shard, tests: Tests) -> tuple[list[list[dict]], list[list[str]]]:
    """For each document: runs of hit words (start, end) and ids of the items with occurring windows."""
    runs: list[list[dict]] = [[] for _ in shard.lengths]
    items: list[list[str]] = [[] for _ in shard.lengths]
    *_, low, high = search(shard.order, shard.text, tests, tests.first)
    which, place = spread(low, high)
    if not len(which):
        return runs, items
    at = shard.order[place]
    need = tests.need[tests.first][which]
    # coverage of the shard's text; a window never leaves its run
    step = np.zeros(len(shard.text) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + need, -1)
    edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(step) > 0, False]))
    for a, b in zip(edge[::2], edge[1::2]):
        runs[shard.doc[a]].append({"start": int(shard.word[a]), "end": int(shard.word[b - 1]) + 1})
    pair = np.unique(shard.doc[at] * len(tests.first) + which)  # (document, distinct window)
    doc, window = pair // len(tests.first), pair % len(tests.first)
    has = np.flatnonzero(tests.window >= 0)
    has = has[np.argsort(tests.window[has], kind="stable")]  # suffixes by distinct window
    start = np.searchsorted(tests.window[has], np.arange(len(tests.first) + 1))
    for d in np.unique(doc):
        mine = window[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
        _, k = spread(start[mine], start[mine + 1])
        items[d] = sorted({x for x in map(tests.ids.__getitem__, np.unique(tests.item[has[k]])) if x is not None})
    return runs, items


def shards(batches: Iterator[pa.RecordBatch], tests: Tests) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Slices of the batches with their shards: SHARD_BYTES of text each, or one longer text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SHARD_BYTES, side="right")))
            part = b.slice(at, end - at)
            yield part, shard_of(part.column("text").to_pylist(), tests)
            at = end


def passes(benchmark: DataFrame, width: int, pass_bytes: int) -> list[Broadcast]:
    """The items in broadcasts of pass_bytes of text each, as counted."""
    spark = benchmark.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes)
    if n > 1:  # rows of an item may go to several passes: its windows are each row's own
        benchmark = stored(benchmark.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n))), "tests")
    out = []
    for k in range(2 * n if n > 1 else n):
        rows = benchmark.filter(F.col("pass") == k) if n > 1 else benchmark
        tests = tests_of([(r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()], width)  # some pass_bytes at most
        if len(tests.first):
            out.append(spark.sparkContext.broadcast(tests))
    return out


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[text_col].cast("string").alias("text")).distinct()


RUNS = "array<struct<start:int,end:int>>"
FOUND = [
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("items", ArrayType(StringType())),
]
RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scanned(rows: DataFrame, sent: Broadcast | None, text: bool = False) -> DataFrame:
    """rows (doc_id and text among its columns) with n_words, runs and items, and without text unless it is asked for."""
    kept = [f for f in rows.schema.fields if text or f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value if sent else tests_of([], 1)
        for b, shard in shards(batches, tests):
            runs, items = hits(shard, tests)
            found = [pa.array(shard.lengths, pa.int64()), pa.array(runs, RUN_TYPE), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *found], [*names, "n_words", "runs", "items"])

    return rows.mapInArrow(run, StructType([*kept, *FOUND]))


def merged_runs(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row: doc_id, n_words, runs (start and end of each run of hit words) and items (sorted ids of items with occurring windows)."""
    src = ids_and_text(docs, id_col, text_col)
    sent = passes(items_of(benchmark, item_col, text_col), width, pass_bytes)
    if len(sent) <= 1:
        return scanned(src, sent[0] if sent else None)
    rows = stored(src.withColumn("row_id", F.monotonically_increasing_id()), "decontamination-rows")
    each = [scanned(rows, x).filter(F.size("items") + F.size("runs") > 0) for x in sent]
    some = reduce(DataFrame.union, each).groupBy("row_id").agg(F.flatten(F.collect_list("runs")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[{"start": a, "end": e} for a, e in merged_runs(x)] for x in b.column("all").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(runs, RUN_TYPE), b.column("items")], ["row_id", "runs", "items"])

    found = stored(some.mapInArrow(merge, f"row_id long, runs {RUNS}, items array<string>"), "decontamination-hits")
    lengths = scanned(rows, None).select("row_id", "doc_id", "n_words")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return lengths.join(found, "row_id", "left").select("doc_id", "n_words", none("runs", RUNS), none("items", "array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **how) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items."""
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return benchmark_hits(docs, benchmark, width, **how).select(
        "doc_id", "n_words", size.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"), "items"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, **how) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of an item. Texts stay where they are."""
    sent = passes(items_of(benchmark, how.pop("item_col", "item_id"), how.get("text_col", "text")), width, how.pop("pass_bytes", PASS_BYTES))
    rows = packed(docs)
    for x in sent:  # a pass drops rows; the next one sees what is left
        rows = scanned(rows, x, text=True).filter(F.size("runs") == 0).select("row", "doc_id", "text")
    return rows.select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per test suffix with a match of a window's length or more: item_id, start (word), length (words) of its longest verbatim match and one location (doc_id, word).

    Each shard gives the longest match of each suffix and its first location; the shards' answers are
    folded by suffix, the longest first, then the least doc_id and word.
    """
    src = ids_and_text(docs, id_col, text_col)

    def found(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            some = np.flatnonzero(tests.need > 0)
            begin = np.r_[0, np.flatnonzero(np.diff(tests.item)) + 1]
            own = np.arange(len(tests.item)) - begin[np.searchsorted(begin, np.arange(len(tests.item)), side="right") - 1]
            for b, shard in shards(batches, tests):
                ids = b.column("doc_id").to_pylist()
                longest, low, high, *_ = search(shard.order, shard.text, tests, some)
                good = np.flatnonzero(longest >= tests.need[some])
                rank = np.empty(len(ids), np.int64)  # of documents, for the first location
                rank[sorted(range(len(ids)), key=lambda d: (ids[d] is None, ids[d]))] = np.arange(len(ids))
                standing = rank[shard.doc] * (len(shard.text) + 1) + np.arange(len(shard.text))
                ranges = [shard.order[low[k] : high[k]] for k in good]
                at = [int(r[standing[r].argmin()]) for r in ranges]
                s = some[good]
                cols = [pa.array([tests.ids[i] for i in tests.item[s]], pa.string()), pa.array(own[s], pa.int64()), pa.array(longest[good], pa.int64()), pa.array([ids[shard.doc[x]] for x in at], pa.int64()), pa.array(shard.word[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "start", "length", "doc_id", "word"])

        return src.mapInArrow(run, "item_id string, start long, length long, doc_id long, word long")

    each = [found(x) for x in passes(items_of(benchmark, item_col, text_col), width, pass_bytes)]
    if not each:
        return docs.sparkSession.createDataFrame([], "item_id string, start long, length long, doc_id long, word long")
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("none"), "doc_id", "word"))
    return reduce(DataFrame.union, each).groupBy("item_id", "start").agg(best.alias("m")).select("item_id", "start", (-F.col("m.l")).alias("length"), "m.doc_id", "m.word")


def oracle_sql(width: int = 10) -> str:
    """The query's rows by joining all windows of the documents with those of the items."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {words} FROM documents),
        b AS (SELECT item_id, w, least(len(w), {width}) AS n FROM (SELECT item_id, {words} FROM benchmark) WHERE len(w) > 0),
        t AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
        m AS MATERIALIZED (SELECT doc_id, i, g.n, item_id FROM g JOIN t ON g.n = t.n AND g.s = t.s),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.doc_id IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)"""
