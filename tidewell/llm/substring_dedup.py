"""Substring dedup with prefix-partitioned suffix trees.

A suffix is a word position with the words that follow it. Suffixes that may repeat (see
repeats.py) are split into groups by a prefix of variable length: the words of their window's
anchor, with more words beside it where a counted prefix is too heavy for a group, up to the
whole window. In a group the suffixes are sorted by all their words to the end of their stretch,
and a stack over the common prefix lengths of neighbours gives the tree's internal nodes. A node
`span` or more words deep is a maximal repeat: of the documents below it the one with the
smallest doc_id keeps the words, the others lose them.

Defined results: a null text has no words; a null doc_id stands after all others; rows that
repeat a doc_id are one document (their repeats of each other stay) unless they are copies; of
equal word sequences of `span` words or more only the smallest doc_id keeps its words, shorter
texts lose none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text
from tidewell.llm.repeats import NOTHING, Kind, repeats, verdict_table

WORDS_CACHED = 1 << 19  # some 100 MB in a worker
_words: dict[bytes, int] = {}


def body(text: str | None) -> bytes:
    return b" ".join((text or "").encode().split())  # bytes split at ASCII white space alone


def word_hashes(joined: bytes) -> np.ndarray:
    words = joined.split()
    if len(_words) > WORDS_CACHED:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def word_kind(span: int, k: int) -> Kind:
    return Kind(span, k, False, body, word_hashes, lambda b, s, i, j: s[i:j].tobytes(), 8, lambda b: b.count(b" ") + 1 if b else 0)


def runs_of(context: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, length) of the runs of consecutive starts; both arrays sorted."""
    new = np.r_[True, (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)]
    at = np.flatnonzero(new)
    return context[at], start[at], np.diff(np.r_[at, len(start)])


def internal_nodes(common: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the suffix tree's nodes at least `span` deep, by a stack over the leaves' common prefixes.

    common[k]: how many words leaf k shares with leaf k - 1. A node comes after those below it.
    """
    nodes: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(common >= span)
    stack: list[tuple[int, int]] = []  # (depth, first leaf)
    before = -2
    for k, depth in zip(deep.tolist(), common[deep].tolist()):
        if k != before + 1:  # the leaf before shares too little with the one before it
            nodes += [(d, first, before) for d, first in reversed(stack)]
            stack = []
        first = k - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            nodes.append((d, first, before))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
        before = k
    return nodes + [(d, first, before) for d, first in reversed(stack)]


def suffix_tree(bodies: list[bytes], windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch and offset of each leaf in order, common prefix with the leaf before) of the suffixes at the stretches' windows."""
    words = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_inverse=True)[1].astype(np.int32) + 1
    size = windows + (span - 1)
    first = np.r_[0, np.cumsum(size[:-1])]
    stretch = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(stretch)) - np.repeat(np.r_[0, np.cumsum(windows[:-1])], windows)
    longest = int(size.max())
    place = (first[stretch] + offset)[:, None] + np.arange(longest)
    grid = np.where(np.arange(longest) < (size[stretch] - offset)[:, None], words[np.minimum(place, len(words) - 1)], 0)  # 0: past the stretch's end
    order = np.lexsort(grid.T[::-1])
    grid = grid[order]
    same = (grid[1:] == grid[:-1]) & (grid[1:] > 0)
    common = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(axis=1)]
    return stretch[order], offset[order], common


def deep_nodes(span: int):
    """A group's verdicts: the windows below the tree's deep nodes, with the least doc_id there."""

    def decide(t: pa.Table) -> pa.Table:
        windows, n, own = (t.column(c).to_numpy() for c in ("windows", "n", "least"))
        stretch, offset, common = suffix_tree(t.column("body").to_pylist(), windows, span)
        reach = np.where(n[stretch] > 1, windows[stretch] - offset, 0)  # windows from each leaf that repeat; copies of a stretch repeat to its end
        least = own[stretch]
        for depth, a, b in internal_nodes(common, span):  # a node comes after those below it: the shallowest, with most documents, has the last word
            least[a : b + 1] = least[a : b + 1].min()
            reach[a : b + 1] = depth - span + 1
        at = np.flatnonzero(reach > 0)
        at = at[np.lexsort((offset[at], stretch[at]))]
        if not len(at):
            return NOTHING
        s, o, r, m = stretch[at], offset[at], reach[at], least[at]
        new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (m[1:] != m[:-1])])
        return verdict_table(t.column("sid"), s[new], o[new], np.maximum.reduceat(o + r, new) - o[new], m[new])

    return decide


def covered(n: int, starts: list[int], windows: list[int], span: int) -> np.ndarray:
    """Which of n symbols stand in one of the windows."""
    step = np.zeros(n + 1, np.int64)
    s = np.asarray(starts, np.int64)
    np.add.at(step, s, 1)
    np.add.at(step, s + np.asarray(windows, np.int64) + span - 1, -1)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(docs: DataFrame, span: int = 13, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and n_spans (runs of removed words)."""

    def finish(text: str | None, starts: list[int], windows: list[int]) -> tuple[int, int, str]:
        words = (text or "").encode().split()
        gone = covered(len(words), starts, windows, span)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()

    src = ids_and_text(docs, id_col, text_col)
    joined = repeats(src, word_kind(span, min(k, span)), deep_nodes(span), finish, "n_removed long, n_spans long, kept string", True)
    copy = (F.col("place") > F.col("first")) & (F.col("n") >= span)
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
    )


def oracle_sql(span: int = 13) -> str:
    """The query's rows by grouping all windows."""
    return f"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + {span - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {span - 2})) AS i FROM t)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE doc_id > first),
        c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {span}))  AS p FROM r) GROUP BY doc_id),
        k AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN c USING (doc_id)),
        u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
        x AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN (SELECT doc_id, unnest(gone)  AS p FROM c) z ON u.doc_id = z.doc_id AND u.p = z.p WHERE z.p IS NULL GROUP BY u.doc_id)
        SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM k LEFT JOIN x USING (doc_id)"""
