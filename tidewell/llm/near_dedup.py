"""Near-duplicate groups by circulant MinHash.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation sigma maps a
hash into a universe of 2**20 places, one more, pi, ranks the places; coordinate k of the
signature is the least rank over the set with pi shifted k places round. So all coordinates of
an element are one slice of pi, and a signature is the least of some slices.

1. One Arrow pass makes set size, set digest and signature. Equal sets fold into one class.
2. Bands of signature coordinates are bucket keys. Each bucket pairs its members with its least
   member (a star, never all pairs); a member's few least heads are tried first. Pairs whose
   signatures agree enough make clusters; buckets
   that still hold several clusters are searched whole, in blocks of bounded size, and add a
   spanning forest of the agreements that join clusters. A link lies inside one cluster.
3. Agreeing stars are verified by exact Jaccard similarity of full sets. Clusters whose members
   that does not connect are searched whole, again in blocks: members of different components
   are compared exactly by counting shared shingles, and the links found are sent as a forest.
   Connected components of all links follow.

So what is sent grows with the members, not with pairs, and no bucket-mates' link between
different texts is lost to the stars. At 0.8 a pair misses all of 40 bands of 6 with probability
(1 - 0.8**6)**40 = 5e-6; its signatures agree in less than 0.68 of 240 coordinates with 2e-6.

Defined results: a null or wordless text has an empty set, is linked with nothing and stays; a
row without doc_id takes no part in links (component null, kept); rows that repeat a doc_id
count as one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text, packed, stored, with_ids

UNIVERSE = 1 << 20
BANDS, ROWS = 40, 6
SCREEN = 0.68
BLOCK = 2048  # members of a bucket that one task compares with another such block, by signatures
TEXTS = 512  # members of a cluster that one task compares with another such block, by full sets
BLOCK_BYTES = 8 << 20  # of a block's texts
WORDS_CACHED = 1 << 17  # some 25 MB in a worker
HEADS = 4  # stars of a member that are tried first

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > WORDS_CACHED:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    return (x ^ (x >> np.uint64(29))) * ODD[1]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter sequence is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone is lower-cased, ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mixed(out * ODD[2] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@cache
def slices(seed: int, width: int) -> np.ndarray:
    """Row s: the ranks that coordinates 0..width-1 give place s; overlapping views of one permutation."""
    pi = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
    round_ = np.r_[pi, pi[: width - 1]]
    return np.lib.stride_tricks.sliding_window_view(round_, width)


def signature(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    view = slices(seed, width)
    # sigma: an odd multiplier permutes the 64-bit hashes; the high bits are the place
    place = ((hashes * ODD[1]) ^ np.uint64(seed) * ODD[0]) >> np.uint64(44)
    least = np.full(width, UNIVERSE, np.int32)
    for at in range(0, len(place), 2048):
        np.minimum(least, view[place[at : at + 2048].astype(np.int64)].min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its signature (null for empty sets)."""
    width = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, shingle)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, width).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def band_keys(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id and key, one row for each band of each signature."""
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substr(F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows))))
    return sigs.select("id", F.explode(key).alias("key"))


def connected(links: DataFrame) -> DataFrame:
    """id and label (the least id reachable) of every id in links (a, b).

    Least labels pass along links and labels' labels are taken each round, until none changes.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("further"))
        new = stored(low.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("further", "low")).alias("label")), "labels")
        changed = not new.filter("label < old").isEmpty()
        labels = new.select("id", "label")
        if not changed:
            return labels


def agreeing(pairs: DataFrame, sigs: DataFrame, width: int, screen: float) -> DataFrame:
    """The pairs whose signatures agree in a share `screen` of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32).reshape(-1, width) for c in ("sa", "sb"))
            good = pa.array((x == y).sum(axis=1) >= screen * width)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    s = sigs.select("id", "sig")
    both = pairs.join(s.withColumnRenamed("id", "a").withColumnRenamed("sig", "sa"), "a").join(s.withColumnRenamed("id", "b").withColumnRenamed("sig", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets, from texts (id, text), have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                good = []
                for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                    x, y = shingle_set(x, shingle), shingle_set(y, shingle)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                good = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


class Forest:
    """Union-find over one task's members; remembers the links that joined."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(int(x), i) for i, x in enumerate(labels)]
        self.links: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[a] = b
            self.links.append((i, j))


def in_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """members (group, id, comp, size in bytes) of the groups that hold more than one comp, dealt to tasks (group, i, j, rest).

    A group's largest comp is cut into chunks, its other members into blocks. Task (i, j) holds block i
    and chunk j; task (i, j, rest) blocks i and j. So a member of the largest comp is sent once for each
    block of the others, which are few once stars have joined the most: work is their number times the
    group's, not the group's square.
    """
    per = members.groupBy(group, "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    top = F.max(F.struct("n", "comp", "bytes"))
    sizes = per.groupBy(group).agg(top.alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).filter("comps > 1")
    many = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("int")
    plan = sizes.select(group, F.col("top.comp").alias("main"), many(F.col("top.n"), F.col("top.bytes")).alias("chunks"), many(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("blocks"))
    part = members.join(stored(plan, "near-blocks"), group).withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("chunks")).otherwise(F.col("blocks"))).cast("int")
    task = lambda i, j, rest: F.struct(i.alias("i"), j.alias("j"), F.lit(rest).alias("rest"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_blocks = F.transform(upto("blocks"), lambda i: task(i, F.col("own"), False))
    with_rest = F.transform(upto("blocks"), lambda j: task(F.least(j, F.col("own")), F.greatest(j, F.col("own")), True))
    with_chunks = F.transform(upto("chunks"), lambda j: task(F.col("own"), j, False))
    tasks = F.when(F.col("is_main"), with_blocks).otherwise(F.concat(with_chunks, with_rest))
    return part.withColumn("own", own).select(group, "id", "comp", "is_main", F.inline(tasks))


TASK = ["i", "j", "rest"]


def forest_table(ids: np.ndarray, forest: Forest) -> pa.Table:
    a, b = ids[[i for i, _ in forest.links]], ids[[j for _, j in forest.links]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def queries_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, comps, rows to compare, whether a row may be compared with): the others with the largest comp's, or with each other."""
    ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
    main = t.column("is_main").to_numpy(zero_copy_only=False)
    return ids, comp, np.flatnonzero(~main), np.ones(len(ids), bool) if t.column("rest")[0].as_py() else main


def across_clusters(buckets: DataFrame, sigs: DataFrame, labels: DataFrame, width: int, screen: float, block: int = BLOCK) -> DataFrame:
    """Agreements (a, b) that join different clusters' bucket-mates: a forest for each task."""
    member = buckets.join(labels.withColumnRenamed("label", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    tasks = in_blocks(member.withColumn("size", F.lit(4 * width)), "key", block).join(sigs.select("id", "sig"), "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, some, to = queries_of(t)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.int32).reshape(-1, width)
        forest = Forest(comp)
        for x in some:
            other = np.flatnonzero(to & (comp != comp[x]))
            for at in range(0, len(other), 2048):
                y = other[at : at + 2048]
                for k in y[(sig[y] == sig[x]).sum(axis=1) >= screen * width]:
                    forest.join(int(x), int(k))
        return forest_table(ids, forest)

    return tasks.select("key", *TASK, "id", "comp", "is_main", "sig").groupBy("key", *TASK).applyInArrow(compare, "a long, b long")


def links_in_clusters(texts: DataFrame, clusters: DataFrame, labels: DataFrame, shingle: int, percent: int, block: int = TEXTS) -> DataFrame:
    """Links (a, b) that join different components (labels) of one cluster (id, label): a forest for each task."""
    member = clusters.withColumnRenamed("label", "cluster").join(labels.withColumnRenamed("label", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    member = member.join(texts.select("id", F.length("text").alias("size")), "id")
    tasks = stored(in_blocks(member, "cluster", block), "near-tasks")

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, some, to = queries_of(t)
        sets = [shingle_set(x, shingle) for x in t.column("text").to_pylist()]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        held = owner[order]  # for each token in turn, who holds it
        start = np.r_[0, np.cumsum(np.bincount(token))]
        first = np.r_[0, np.cumsum(size)]
        forest = Forest(comp)
        for x in some:
            mine = token[first[x] : first[x + 1]]
            shared = np.zeros(len(sets), np.int64)
            for at in range(0, len(mine), 512):
                part = mine[at : at + 512]
                n = start[part + 1] - start[part]
                places = np.repeat(start[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                shared += np.bincount(held[places], minlength=len(sets))
            linked = (100 * shared >= percent * (size + size[x] - shared)) & (shared > 0) & (comp != comp[x]) & to
            for k in np.flatnonzero(linked):
                forest.join(int(x), int(k))
        return forest_table(ids, forest)

    return tasks.join(texts, "id").select("cluster", *TASK, "id", "comp", "is_main", "text").groupBy("cluster", *TASK).applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    width = bands * rows
    src = ids_and_text(docs, id_col, text_col)
    sets = stored(signatures(src, shingle, bands, rows).withColumn("row_id", F.monotonically_increasing_id()), "near-sets")
    known = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.min(F.struct("doc_id", "row_id"))
    classes = stored(known.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")), "near-classes")
    # equal sets are one class, searched under its least id; its other rows join its component at the end
    folded = stored(known.select("row_id", "digest", "doc_id").join(classes.filter("n > 1"), "digest").select("row_id", "doc_id", F.col("first.doc_id").alias("id")), "near-folded")
    sigs = stored(known.select("row_id", "sig").join(classes.select(F.col("first.row_id").alias("row_id"), F.col("first.doc_id").alias("id")), "row_id").select("id", "sig"), "near-sigs")
    keys = band_keys(sigs, bands, rows)
    shared = keys.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    buckets = stored(keys.join(shared, "key"), "near-buckets")
    # a member's first HEADS heads make clusters; bucket-mates that they leave apart are compared below, all of them
    heads = buckets.filter("id <> head").groupBy("id").agg(F.slice(F.array_sort(F.collect_set("head")), 1, HEADS).alias("heads"))  # at most `bands` heads
    stars = heads.select(F.explode("heads").alias("a"), F.col("id").alias("b"))
    agree = stored(agreeing(stars, sigs, width, SCREEN), "near-agree")
    joins = stored(across_clusters(buckets.select("key", "id"), sigs, connected(agree), width, SCREEN), "near-agree")
    clusters = connected(agree.union(joins))
    # whole texts move once: those of clusters, by id
    texts = stored(with_ids(src, clusters.select(F.col("id").alias("doc_id"))).select(F.col("doc_id").alias("id"), "text"), "near-texts")
    links = stored(verified(agree, texts, shingle, percent), "near-links")
    more = stored(links_in_clusters(texts, clusters, connected(links), shingle, percent), "near-links")
    # a doc_id on rows of several classes links them
    one = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    of_repeats = known.join(one, "doc_id", "left_semi").select("doc_id", "digest").join(classes.select("digest", F.col("first.doc_id").alias("id")), "digest")
    bridges = of_repeats.filter("id <> doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = connected(links.union(more).union(bridges))
    joined = sets.select("doc_id", "n_shingles", "row_id").join(folded.select("row_id", "id"), "row_id", "left").withColumn("id", F.coalesce("id", "doc_id"))
    out = joined.join(labels, "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one document of each near-duplicate group; rows of one doc_id stay or go together."""
    found = near_components(docs, shingle, percent)
    gone = stored(found.filter("NOT kept").select("doc_id").distinct(), "near-dropped")
    return with_ids(packed(docs), gone, "left_anti").select("row.*")


NEAR_SQL_PERCENT = 80


def oracle_sql(shingle: int = 2, percent: int = NEAR_SQL_PERCENT) -> str:
    """The same rows by joining all documents that share a shingle."""
    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN n p ON b.a = p.doc_id JOIN n q ON b.b = q.doc_id WHERE 100 * k >= {percent} * (p.n + q.n - k)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
        SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, t.doc_id = m.c AS kept
        FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON t.doc_id = m.doc_id"""
