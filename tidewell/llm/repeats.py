"""Finding what may repeat, for both substring operators.

A text is a sequence of symbols (bytes, or word hashes). Of every window of `span` symbols the
k-gram with the least hash is its anchor; equal windows have equal anchors at equal places, so
an anchor found once rules out all windows it stands for. The steps, all keyed and spread:

1. classes: equal texts fold into one class; only one row of each class goes on.
2. anchors: each partition sends its anchors' hashes, sorted and packed by bucket; a bucket
   merges the runs and returns those that stand in two classes (or, if asked, twice in one). Anchors
   that a sample of rows finds in very many texts repeat for sure and skip the merge, spread out.
3. stretches: texts with such anchors give, for each, the stretch of windows it stands for.
   Equal stretches fold into one row (count, least doc_id) before they meet others, so a passage
   of any frequency is one row for each partition.
4. groups: distinct stretches go to groups by a prefix, the anchor. Prefixes whose stretches hold
   more than GROUP_BYTES are lengthened by symbols before or after, half of what the window still
   has each time, and their stretches, still whole runs of windows, are cut in two; so on until
   every prefix fits. The number of groups follows the counted bytes.
5. Verdicts come back by stretch, then by text, and texts with repeats are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FEW_ROWS, stored

LAST_ID = (1 << 63) - 1  # where a null doc_id stands in order
MULT = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = 8 << 20  # of one prefix's distinct stretches
FLUSH = 1 << 20
SAMPLE, HOT_SAMPLE = 128, 500  # an anchor of some 64,000 texts and more
CLASS = "doc_id long, place long, digest binary, n long, sha256 string"
STRETCH = "sid binary, key long, at int, windows int, body binary"


@dataclass(frozen=True)
class Kind:
    """What symbols are and how windows are anchored; body gives the canonical bytes of a text."""

    span: int
    k: int
    within: bool  # a repeat inside one text counts too
    body: Callable[[str | None], bytes]
    symbols: Callable[[bytes], np.ndarray]  # uint64 values that stand for the symbols
    stretch: Callable[[bytes, np.ndarray, int, int], bytes]  # what a context of symbols [a, b) carries
    unit: int  # bytes of a symbol in it
    size: Callable[[bytes], int]

    @property
    def width(self) -> int:
        return self.span - self.k + 1


def powers(n: int) -> np.ndarray:
    out = np.full(n, MULT, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k symbols in a row: a polynomial from running sums."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = powers(len(symbols))
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power, out=total[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    return finished((total[k:] - total[:-k]) * np.multiply.accumulate(back))


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` values in a row, the leftmost of equals: block-wise running minima.

    Values count by their upper half, whatever n is: equal windows of a short and a long text have one place.
    """
    n = len(h)
    low = np.uint64((1 << 32) - 1)  # a place; no text has more
    v = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = v
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def anchors(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes with the last bit clear, anchor place of each window)."""
    h = gram_hashes(symbols, kind.k) & ~np.uint64(1)
    if len(h) < kind.width:
        return h, np.zeros(0, np.int64)
    return h, window_argmin(h, kind.width)


def digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def classes(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, place, digest, size and sha256 of every row's canonical body."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [kind.body(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([digest(x) for x in bodies], pa.binary()), pa.array([kind.size(x) for x in bodies], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), *cols], ["doc_id", "place", "digest", "n", "sha256"])

    return docs.mapInArrow(run, CLASS)


def hot_anchors(docs: DataFrame, kind: Kind) -> np.ndarray:
    """Sorted fps that HOT_SAMPLE rows of one in SAMPLE hold, in two classes at least. They only balance the work: no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in b.column("text").to_pylist():
                body = kind.body(t)
                h, place = anchors(kind.symbols(body), kind)
                fps.append(np.unique(h[place]).view(np.int64))
                ids.append(np.full(len(fps[-1]), np.frombuffer(digest(body)[:8], np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(ids))], ["fp", "c64"])

    some = docs.filter(F.pmod(F.xxhash64("place"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "fp long, c64 long")
    found = some.groupBy("fp").agg(F.count("*").alias("n"), F.min("c64").alias("a"), F.max("c64").alias("b")).filter((F.col("n") >= HOT_SAMPLE) & (F.col("a") < F.col("b")))
    rows = found.orderBy(F.desc("n"), "fp").limit(FEW_ROWS).select("fp").toArrow()  # the hottest, in a list of bounded size
    return np.sort(rows.column("fp").to_numpy().view(np.uint64))


def repeated_anchors(docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """c64 (first half of the class digest) and fp of every anchor that repeats."""
    hot = hot_anchors(docs, kind)

    def emit(fps: list, ids: list, twice: list) -> pa.RecordBatch:
        f, c, m = np.concatenate(fps), np.concatenate(ids), np.concatenate(twice)
        order = np.lexsort((c, f))
        f, c, m = f[order], c[order], m[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])]
        f, c, m = f[new], c[new], m[new]
        b = ((f >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        if len(hot):  # by class, in buckets below 0
            is_hot = hot[np.minimum(np.searchsorted(hot, f), len(hot) - 1)] == f
            b = np.where(is_hot, -1 - (c.view(np.uint64) % np.uint64(buckets)).astype(np.int64), b)
        order = np.argsort(b, kind="stable")
        f, c, m, b = f[order], c[order], m[order], b[order]
        at = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)]
        runs = list(zip(at[:-1], at[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array([int(b[i]) for i, _ in runs], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in runs], pa.binary()) for x in (f, c, m))], ["bucket", "fps", "ids", "twice"]
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, ids, twice, held = [], [], [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                body = kind.body(t)
                h, place = anchors(kind.symbols(body), kind)
                if not len(place):
                    continue
                f, count = np.unique(h[place[np.r_[True, place[1:] != place[:-1]]]], return_counts=True)
                fps.append(f)
                ids.append(np.full(len(f), np.frombuffer(digest(body)[:8], np.int64)[0]))
                twice.append((count > 1).astype(np.uint8))
                held += len(f)
                if held > FLUSH:
                    yield emit(fps, ids, twice)
                    fps, ids, twice, held = [], [], [], 0
        if held:
            yield emit(fps, ids, twice)

    def merge(t: pa.Table) -> pa.Table:
        f, c, m = (np.frombuffer(b"".join(t.column(x).to_pylist()), k) for x, k in (("fps", np.uint64), ("ids", np.int64), ("twice", np.uint8)))
        order = np.lexsort((c, f))
        f, c, m = f[order], c[order], m[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])]
        f, c, m = f[new], c[new], m[new]
        if t.column("bucket")[0].as_py() < 0:
            return pa.table({"c64": c, "fp": f.view(np.int64)})
        start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        n = np.diff(np.r_[start, len(f)])
        many = n > 1
        if kind.within:
            many |= np.maximum.reduceat(m, start) > 0
        row = np.repeat(many, n)
        return pa.table({"c64": c[row], "fp": f[row].view(np.int64)})

    return docs.mapInArrow(send, "bucket int, fps binary, ids binary, twice binary").groupBy("bucket").applyInArrow(merge, "c64 long, fp long")


def stretch_id(key: int, part: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key.to_bytes(8, "little", signed=True) + part)


def signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def contexts(cand: DataFrame, kind: Kind) -> DataFrame:
    """digest, place, starts and the stretch (sid, key, at: its anchor's place in it, windows, body) of possible repeats.

    A text's equal stretches are one row, so that a line repeated all through it is sent once.
    """

    def rows(body: bytes, known: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        symbols = kind.symbols(body)
        h, place = anchors(symbols, kind)
        if not len(place):
            return
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        good = (known[at] == h)[place]
        if not good.any():
            return
        edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (good[1:] != good[:-1])])
        for a, b in zip(edge, np.r_[edge[1:], len(place)]):
            if good[a]:
                yield signed(h[place[a]]), int(a), int(place[a] - a), int(b - a), kind.stretch(body, symbols, a, b - 1 + kind.span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["digest", "place", "starts", "sid", "key", "at", "windows", "body"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                out = []
                for place, text, dig, fps in zip(*(b.column(c).to_pylist() for c in ("place", "text", "digest")), b.column("fps")):
                    body = kind.body(text)
                    if digest(body) != dig:  # another text under the same doc_id
                        continue
                    known = np.sort(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    equal: dict[tuple[int, int, int, bytes], list[int]] = {}
                    for key, s, a, n, part in rows(body, known):
                        equal.setdefault((key, a, n, part), []).append(s)
                    out += [(dig, place, starts, stretch_id(key, part), key, a, n, part) for (key, a, n, part), starts in equal.items()]
                cols = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return cand.mapInArrow(run, f"digest binary, place long, starts array<int>, {STRETCH}")


def room(kind: Kind, level: int) -> tuple[int, int]:
    """(symbols of the prefixes at this level, how many more the next level takes: half of what the window has besides)."""
    size = kind.k
    for _ in range(level):
        size += max(1, (kind.span - size) // 2)
    return size, max(1, (kind.span - size) // 2)


def longer(stretches: DataFrame, kind: Kind, level: int) -> DataFrame:
    """Stretches of heavy prefixes cut in two with longer ones: parent sid, offset in it, and the part's own columns.

    The first windows take symbols before the prefix into it, the others symbols after: as a prefix grows
    by half of the room in the window at most, every window has one or the other.
    """
    u, span = kind.unit, kind.span
    size, more = room(kind, level)

    def parts(key: int, at: int, windows: int, body: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        own = key.to_bytes(8, "little", signed=True)
        split = min(windows, max(0, at - more + 1))
        if split:
            yield 0, xxhash.xxh3_64_intdigest(own + b"<" + body[(at - more) * u : at * u]), at - more, split, body[: (split - 1 + span) * u]
        if split < windows:
            yield split, xxhash.xxh3_64_intdigest(own + b">" + body[(at + size) * u : (at + size + more) * u]), at - split, windows - split, body[split * u : (windows - 1 + span) * u]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        names = ["parent", "offset", "sid", "key", "at", "windows", "body", "n", "least"]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for sid, key, at, windows, body, n, least in zip(*(batch.slice(first, 256).column(c).to_pylist() for c in ("sid", "key", "at", "windows", "body", "n", "least"))):
                    for offset, new, place, w, part in parts(key, at, windows, body):
                        out.append((sid, offset, stretch_id(signed(new), part), signed(new), place, w, part, n, least))
                cols = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return stretches.select("sid", "key", "at", "windows", "body", "n", "least").mapInArrow(run, f"parent binary, offset int, {STRETCH}, n long, least long")


VERDICT = "sid binary, offset int, windows int, least long"


def verdicts(stretches: DataFrame, kind: Kind, decide: Callable[[pa.Table], pa.Table], group_bytes: int, level: int = 0) -> DataFrame:
    """(sid, offset, windows, least): windows of distinct stretches that repeat, and the least doc_id of them.

    stretches (stored): sid, key, at, windows, body, n (times), least.
    """
    # a prefix as long as the window has equal windows alone: one stretch, of one window
    whole = room(kind, level)[0] >= kind.span
    weight = F.sum(F.length("body"))
    heavy = stored(stretches.groupBy("key").agg(weight.alias("bytes"), F.count("*").alias("many")).filter(F.lit(not whole) & (F.col("bytes") > group_bytes) & (F.col("many") > 1)).select(F.col("key").alias("heavy")), "repeat-heavy")
    n = heavy.count()
    if not n:
        return in_groups(stretches, decide, group_bytes)
    side = F.broadcast(heavy) if n <= FEW_ROWS else heavy
    light = stretches.join(side, F.col("key") == F.col("heavy"), "left_anti")
    parts = stored(longer(stretches.join(side, F.col("key") == F.col("heavy"), "left_semi"), kind, level), "repeat-longer")
    folded = stored(parts.groupBy("sid", "key", "at", "windows", "body").agg(F.sum("n").alias("n"), F.min("least").alias("least")), "repeat-stretches")
    below = stored(verdicts(folded, kind, decide, group_bytes, level + 1), "repeat-verdicts").withColumnRenamed("offset", "inner")
    back = parts.select("parent", "offset", "sid").join(below, "sid").select(F.col("parent").alias("sid"), (F.col("offset") + F.col("inner")).alias("offset"), "windows", "least")
    return in_groups(light, decide, group_bytes).union(back)


def in_groups(stretches: DataFrame, decide: Callable[[pa.Table], pa.Table], group_bytes: int) -> DataFrame:
    """Verdicts of stretches in groups of some group_bytes / 2, prefixes kept whole."""
    total = stretches.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = max(1, -(-2 * total // group_bytes))
    dealt = stretches.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.select("bucket", "sid", "windows", "body", "n", "least").groupBy("bucket").applyInArrow(decide, VERDICT)


NOTHING = pa.table({"sid": pa.array([], pa.binary()), "offset": pa.array([], pa.int32()), "windows": pa.array([], pa.int32()), "least": pa.array([], pa.int64())})


def verdict_table(sids: pa.ChunkedArray, stretch: np.ndarray, offset: np.ndarray, windows: np.ndarray, least: np.ndarray) -> pa.Table:
    return pa.table({"sid": sids.take(pa.array(stretch)), "offset": pa.array(offset.astype(np.int32)), "windows": pa.array(windows.astype(np.int32)), "least": pa.array(least.astype(np.int64))})


def repeats(docs: DataFrame, kind: Kind, decide: Callable[[pa.Table], pa.Table], finish: Callable, out: str, later_only: bool, group_bytes: int | None = None) -> DataFrame:
    """rows with first and copies of their class, and the results of the classes with repeats (else null).

    decide: a group's distinct stretches to verdicts. later_only: a window stays in the text of its
    least doc_id. finish: (text, starts, windows) to the tuple of result columns `out`.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(LAST_ID)))
    rows = stored(classes(docs, kind), "repeat-rows")
    folded = stored(rows.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("copies")), "repeat-classes")
    found = repeated_anchors(docs, kind, buckets).groupBy("c64").agg(F.collect_list("fp").alias("fps"))
    cand = found.join(_half(folded), "c64").select("digest", "first", "fps")
    cand = stored(docs.join(cand, docs["place"] == cand["first"]).select("place", "text", "digest", "fps"), "repeat-candidates")
    places = stored(contexts(cand, kind), "repeat-places")
    stretches = stored(places.groupBy("sid", "key", "at", "windows", "body").agg(F.sum(F.size("starts")).alias("n"), F.min("place").alias("least")), "repeat-stretches")
    found = stored(verdicts(stretches, kind, decide, group_bytes or GROUP_BYTES), "repeat-verdicts").withColumnRenamed("windows", "many")
    # both sides are files: where one passage makes a hot stretch, AQE may split its rows
    hits = places.select("sid", "digest", "place", "starts").join(found, "sid")
    if later_only:
        hits = hits.filter("place > least")
    runs = hits.select("digest", F.explode("starts").alias("start"), "offset", "many").groupBy("digest").agg(F.collect_list((F.col("start") + F.col("offset")).cast("int")).alias("starts"), F.collect_list("many").alias("windows"))

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for b in batches:
            results = []
            for text, dig, starts, windows in zip(*(b.column(c).to_pylist() for c in ("text", "digest", "starts", "windows"))):
                if digest(kind.body(text)) == dig:
                    results.append((dig, *finish(text, starts, windows)))
            cols = list(zip(*results)) or [[]] * (1 + len(names))
            types = [pa.binary(), *(pa.string() if x.split()[1] == "string" else pa.int64() for x in out.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["digest", *names])

    results = cand.select("text", "digest").join(runs, "digest").mapInArrow(done, f"digest binary, {out}")
    per_class = stored(folded.join(results.dropDuplicates(["digest"]), "digest", "left"), "repeat-results")
    return rows.join(per_class, "digest")  # files on both sides: a class of many copies may be split


def _half(folded: DataFrame) -> DataFrame:
    """first and digest with c64, the digest's first eight bytes as a little-endian long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = [int.from_bytes(x[:8], "little", signed=True) for x in b.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("first"), b.column("digest"), pa.array(half, pa.int64())], ["first", "digest", "c64"])

    return folded.select("first", "digest").mapInArrow(run, "first long, digest binary, c64 long")
