"""Suffix-array dedup of byte strings.

Distinct stretches of windows that may repeat (see repeats.py) meet in groups. A group writes
them as phrases: a phrase runs from a cut to the end of the next cut's trigger, the eight bytes
whose hash makes it a cut, so no phrase is the beginning of another. Phrases numbered in byte order
make a text whose suffixes are in the order of the bytes. Its suffix array is built by linear
grouping: suffixes are grouped by their Lyndon prefix, groups are processed in descending order,
previous-smaller pointers carry each group's content to the suffixes before it, and a last sweep
emits each group's order; nothing is renamed or sorted again.

The array decides. Neighbours' common bytes cut it into runs that share `span - r` bytes; the
bytes before a cut, sorted from their ends, are cut into runs that share r. Two windows whose first
cut is r bytes in are equal exactly if both runs are the same. No window is hashed. The few
windows without any cut are compared as they are.

Defined results: a null text has no bytes; copies of `span` bytes or more lose all their bytes
(each stands elsewhere), shorter texts none; rows that repeat a doc_id are texts like any
others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text
from tidewell.llm.repeats import NOTHING, Kind, gram_hashes, repeats, verdict_table
from tidewell.llm.substring_dedup import covered, runs_of

TRIGGER, PHRASE = 8, 32  # a phrase starts where the hash of the next 8 bytes is 0 mod 32
LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order, by linear grouping.

    Group of a suffix: those with the same Lyndon prefix. From the highest group down, every
    member finds the last suffix before it in a lower group; suffixes found k times by one group
    take on its prefix k times, and leave their group for new ones right above it, more times
    further up. The sweep then goes through the finished part of the array: a suffix places
    those that it is the next smaller one of, each in the next place of its group.
    """
    n = len(text)
    if not n:
        return []
    letters = sorted(set(text))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    below = [g - 1 for g in range(len(letters))]
    above = [g + 1 for g in range(len(letters))]
    above[-1] = -1
    done = [False] * len(letters)
    before = [-1] * n
    descending: list[tuple[int, int]] = []
    g = len(letters) - 1
    while g != -1:
        done[g] = True
        found: dict[int, int] = {}
        inside = [i for i in members[g] if group[i] == g]
        inside.sort()
        for i in inside:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = before[j]
            before[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        members[g] = []
        descending.append((g, len(inside)))
        moves: dict[int, dict[int, list[int]]] = {}
        for j, times in found.items():
            moves.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(moves, reverse=True):
            for old, js in moves[times].items():
                new = len(below)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up != -1:
                    below[up] = new
                done.append(False)
                members.append(js)
                for j in js:
                    group[j] = new
        g = below[g]
    place = [0] * len(below)
    at = 0
    for g, size in reversed(descending):
        place[g] = at
        at += size
    out = [0] * n
    j = n - 1
    while j >= 0:
        g = group[j]
        out[place[g]] = j
        place[g] += 1
        j = before[j]
    for k in range(n):
        s = out[k]
        stop = before[s]
        j = s - 1
        while j != stop:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            j = before[j]
    return out


def neighbours_common(text: list[int], order: list[int]) -> list[int]:
    """For each suffix, by rank, how many symbols it shares with the one ranked before it."""
    n = len(text)
    rank = [0] * n
    for k, s in enumerate(order):
        rank[s] = k
    common = [0] * n
    h = 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            top = n - max(i, j)
            while h < top and text[i + h] == text[j + h]:
                h += 1
            common[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return common


def shared(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    top = min(len(a), len(b))
    if a[:top] == b[:top]:
        return top
    return next(i for i in range(top) if a[i] != b[i])


def right_runs(data: bytes, cut: np.ndarray, end: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each cut's bytes to the right, bytes that each rank shares with the one before, up to span).

    cut: ascending; end: where each cut's stretch ends.
    """
    last = np.r_[end[1:] != end[:-1], True]
    upto = np.where(last, end, np.r_[cut[1:], 0] + TRIGGER)
    # a stretch's last phrase is one of its own and stands before others that begin with its bytes
    phrases = [(data[a:b], int(k) if x else len(cut)) for k, (a, b, x) in enumerate(zip(cut.tolist(), upto.tolist(), last.tolist()))]
    number = {x: i for i, x in enumerate(sorted(set(phrases)))}
    symbols = [number[x] for x in phrases]
    order = suffix_array(symbols)
    common = np.asarray(neighbours_common(symbols, order), np.int64)
    order = np.asarray(order)
    size = np.r_[0, np.cumsum(np.where(last, 0, np.r_[cut[1:], 0] - cut))]
    same = size[order + common] - size[order]  # whole phrases
    raw = np.frombuffer(data, np.uint8)
    x, y = cut[order[1:]], cut[order[:-1]]
    got, most = same[1:].copy(), np.minimum(np.minimum(end[order[1:]] - x, end[order[:-1]] - y), span)
    live = np.flatnonzero(got < most)
    while len(live):  # then byte by byte
        live = live[raw[x[live] + got[live]] == raw[y[live] + got[live]]]
        got[live] += 1
        live = live[got[live] < most[live]]
    rank = np.zeros(len(cut), np.int64)
    rank[order] = np.arange(len(cut))
    return rank, np.r_[0, got]


def left_runs(data: bytes, cut: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same to the left, from each cut back to the cut before or the stretch's beginning; equal ones have one rank."""
    back = [data[a:c][::-1] for a, c in zip(begin.tolist(), cut.tolist())]
    names = sorted(set(back))
    number = {x: i for i, x in enumerate(names)}
    return np.array([number[x] for x in back], np.int64), np.array([0, *(shared(a, b) for a, b in zip(names, names[1:]))], np.int64)


def repeated(bodies: list[bytes], times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset) of the windows of distinct stretches that stand in two places."""
    data = b"".join(bodies)
    size = np.array([len(b) for b in bodies])
    first = np.r_[0, np.cumsum(size[:-1])]
    windows = size - span + 1
    stretch = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(stretch)) - np.repeat(np.r_[0, np.cumsum(windows[:-1])], windows)
    start = first[stretch] + offset
    hit = times[stretch] > 1
    h = gram_hashes(LETTERS[np.frombuffer(data, np.uint8)], TRIGGER)
    cut = np.flatnonzero(h % np.uint64(PHRASE) == 0)
    own = np.searchsorted(first, cut, side="right") - 1
    inside = cut + TRIGGER <= first[own] + size[own]
    cut, own = cut[inside], own[inside]
    at = np.searchsorted(cut, start)
    has = at < len(cut)
    has[has] = cut[at[has]] + TRIGGER <= start[has] + span
    if len(cut):
        rank, right = right_runs(data, cut, first[own] + size[own], span)
        begin = np.where(np.r_[True, own[1:] != own[:-1]], first[own], np.r_[0, cut[:-1]])
        lrank, left = left_runs(data, cut, begin)
        where = np.flatnonzero(has)
        r = cut[at[where]] - start[where]
        by_r = np.argsort(r, kind="stable")
        for part in np.split(by_r, np.flatnonzero(np.diff(r[by_r])) + 1):
            if not len(part):
                continue
            mine, depth = at[where[part]], int(r[part[0]])
            run = np.cumsum(right < span - depth)[rank[mine]] * np.int64(len(left) + 1) + np.cumsum(left < depth)[lrank[mine]]
            _, group, n = np.unique(run, return_inverse=True, return_counts=True)
            hit[where[part]] |= n[group] > 1
    seen: dict[bytes, int] = {}
    bare = np.flatnonzero(~has)
    names = [seen.setdefault(data[s : s + span], len(seen)) for s in start[bare].tolist()]
    hit[bare] |= np.bincount(names, minlength=len(seen) + 1)[names] > 1 if names else False
    good = np.flatnonzero(hit)
    return stretch[good], offset[good]


def repeated_windows(span: int):
    """A group's windows that stand in two places, as runs."""

    def decide(t: pa.Table) -> pa.Table:
        stretch, offset = repeated(t.column("body").to_pylist(), t.column("n").to_numpy(), span)
        if not len(stretch):
            return NOTHING
        s, o, n = runs_of(stretch, offset)
        return verdict_table(t.column("sid"), s, o, n, np.zeros(len(s), np.int64))

    return decide


def utf8(text: str | None) -> bytes:
    return (text or "").encode()


def byte_kind(span: int, k: int) -> Kind:
    return Kind(span, k, True, utf8, lambda b: LETTERS[np.frombuffer(b, np.uint8)], lambda b, s, i, j: b[i:j], 1, len)


def suffix_dedup(docs: DataFrame, span: int = 400, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256."""

    def finish(text: str | None, starts: list[int], windows: list[int]) -> tuple[int, int, str]:
        data = np.frombuffer(utf8(text), np.uint8)
        gone = covered(len(data), starts, windows, span)
        return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()

    src = ids_and_text(docs, id_col, text_col)
    joined = repeats(src, byte_kind(span, min(k, span)), repeated_windows(span), finish, "n_removed long, n_spans long, kept string", False)
    copy = (F.col("copies") > 1) & (F.col("n") >= span)
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def oracle_sql(span: int = 400) -> str:
    """The query's rows by grouping a digest of every window."""
    return f"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * span})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {span - 1})) AS i FROM t)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
        g AS (SELECT doc_id, min(i) AS a, max(i) + {span} AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
        m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g),
        q AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS part FROM m),
        s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM q GROUP BY doc_id, part),
        k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s),
        z AS (SELECT k.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS spans
            FROM k JOIN t ON k.doc_id = t.doc_id GROUP BY k.doc_id)
        SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM t LEFT JOIN z ON t.doc_id = z.doc_id"""
