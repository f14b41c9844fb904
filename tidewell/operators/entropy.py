"""Sample entropy of series of any length, by cells of templates.

Equal templates fold to one with a count. Two templates can match only if their first and their second
values do, so the plane of these is cut into cells a tolerance wide: a cell's templates meet each other and
those of the four cells after it, each pair once. Cells of many templates are dealt in chunks, so a task
holds one chunk of a cell and one of each cell beside it, a template is sent five times plus once for each
further chunk that it meets, and a long series is spread over as many tasks as it has cells and chunks.

In a task pairs are counted, not compared: what a template matches in one column is a range of the others'
ranks, and a range of every column holds as many templates as a wavelet matrix counts (two columns), in the
nodes of a tree over the third where there are three. So n templates take time by n and the square of log n.
Columns in which all match, such as the first two inside a cell, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

BLOCK = 16384
BLOCKS = 16  # in a chunk, at most
SLACK = 1e-9  # of the tolerance: what is sent may be a little more than what matches
AFTER = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))  # the cells that a cell's templates meet
PAIRS = 1 << 18  # compared at a time
LEAF = 256  # ranks in a leaf of the tree


def reach(own: np.ndarray, others: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each of the others, from and up to which rank each own value is within r of them): as subtraction says, to the last bit."""
    values, rank = np.unique(others, return_inverse=True)
    most = len(values)
    low, high = np.searchsorted(values, own - r, side="left"), np.searchsorted(values, own + r, side="right")
    at = lambda k: values[np.clip(k, 0, most - 1)]
    while (off := (low > 0) & (own - at(low - 1) <= r)).any():
        low -= off
    while (off := (low < most) & (own - at(low) > r)).any():
        low += off
    while (off := (high < most) & (at(high) - own <= r)).any():
        high += off
    while (off := (high > 0) & (at(high - 1) - own > r)).any():
        high -= off
    return rank.astype(np.int64), low, np.maximum(low, high)


def under(values: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query, the weight of values[start:end] below `least`: a wavelet matrix, walked for all queries while it is built."""
    out, start, end = np.zeros(len(start), np.int64), start.copy(), end.copy()
    for bit in range(max(1, int(max(values.max(initial=0), least.max(initial=0))).bit_length()) - 1, -1, -1):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        sums = np.concatenate([[0], np.cumsum(weight[~one])])
        s, e, up = zeros[start], zeros[end], (least >> bit & 1).astype(bool)
        out += np.where(up, sums[e] - sums[s], 0)
        start, end = np.where(up, zeros[-1] + start - s, s), np.where(up, zeros[-1] + end - e, e)
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        values, weight = values[order], weight[order]
    return out


def between(values: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query, the weight of values[start:end] from low to below high."""
    twice = lambda x: np.concatenate([x, x])
    got = under(values, weight, twice(start), twice(end), np.concatenate([high, low]))
    return got[: len(start)] - got[len(start) :]


def in_ranges(ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray, queries: int) -> np.ndarray:
    """For each query, the weight of the points whose ranks are in its range of every column (three at most)."""
    if not ranges:
        return np.full(queries, weight.sum())
    first = np.argsort(ranges[0][0], kind="stable")
    ordered, weight = ranges[0][0][first], weight[first]
    start, end = (np.searchsorted(ordered, x, side="left") for x in ranges[0][1:])
    if len(ranges) == 1:
        sums = np.concatenate([[0], np.cumsum(weight)])
        return sums[end] - sums[start]
    (b, b_low, b_high), *third = [(rank[first], low, high) for rank, low, high in ranges[1:]]
    if not third:
        return between(b, weight, start, end, b_low, b_high)
    c, c_low, c_high = third[0]
    out = np.zeros(queries, np.int64)

    # ends of a range that fill no leaf: compared
    leaves = -(-len(b) // LEAF)
    pad = lambda x: np.concatenate([x, np.full(leaves * LEAF - len(x), -1)]).reshape(leaves, LEAF)
    b_leaf, c_leaf, w_leaf, place = pad(b), pad(c), np.maximum(pad(weight), 0), np.arange(LEAF)
    l, h = -(-start // LEAF), end // LEAF
    inside = l > h  # a range inside one leaf
    for leaf, lo, hi, some in ((l - 1, start, end, inside), (l - 1, start, l * LEAF, ~inside & (start < l * LEAF)), (h, h * LEAF, end, ~inside & (h * LEAF < end))):
        some = np.flatnonzero(some & (lo < hi))
        for k in range(0, len(some), PAIRS // LEAF):
            q = some[k : k + PAIRS // LEAF]
            n, at = leaf[q], leaf[q, None] * LEAF + place
            near = (at >= lo[q, None]) & (at < hi[q, None]) & (b_leaf[n] >= b_low[q, None]) & (b_leaf[n] < b_high[q, None]) & (c_leaf[n] >= c_low[q, None]) & (c_leaf[n] < c_high[q, None])
            out[q] += (w_leaf[n] * near).sum(axis=1)

    # whole leaves: the nodes of a tree over them, level by level
    l, h, size, span = np.where(inside, 0, l), np.where(inside, 0, h), LEAF, max(int(b.max(initial=0)), int(b_high.max(initial=0))) + 2
    while (open_ := l < h).any():
        left, right = open_ & (l & 1 == 1), open_ & (h & 1 == 1)
        q = np.concatenate([np.flatnonzero(left), np.flatnonzero(right)])
        if len(q):
            node = np.concatenate([l[left], h[right] - 1])
            key = np.arange(len(b)) // size * span + b
            order = np.argsort(key, kind="stable")
            key = key[order]
            s, e = (np.searchsorted(key, node * span + x[q]) for x in (b_low, b_high))
            np.add.at(out, q, between(c[order], weight[order], s, e, c_low[q], c_high[q]))
        l, h, size = (l + (l & 1)) >> 1, h >> 1, size * 2
    return out


def met(own: np.ndarray, times: np.ndarray, others: np.ndarray, other_times: np.ndarray, r: float) -> tuple[int, int]:
    """(pairs of an own row and another that match in all columns but the last, pairs that match in all), each row standing for as many as its times say."""
    if not len(own) or not len(others):
        return 0, 0
    if len(own) * len(others) > 4 * PAIRS:
        all_ = [reach(own[:, c], others[:, c], r) for c in range(own.shape[1])]
        partly = [(low > 0).any() or (high <= rank.max()).any() for rank, low, high in all_]
        if sum(partly) <= 3:
            short, long = ([x for x, p in zip(some, partly) if p] for some in (all_[:-1], all_))
            return tuple(int((times * in_ranges(x, other_times, len(own))).sum()) for x in (short, long))
    return compared(own, times, others, other_times, r)


def compared(own: np.ndarray, times: np.ndarray, others: np.ndarray, other_times: np.ndarray, r: float) -> tuple[int, int]:
    """The same, pair by pair: for few rows, and for more than three columns."""
    step, weight, out = max(1, PAIRS // len(others)), other_times.astype(float), np.zeros(2, np.int64)  # sums are below 2**53
    for k in range(0, len(own), step):
        some, n = own[k : k + step], times[k : k + step]
        near = np.abs(others[None, :, 0] - some[:, None, 0]) <= r
        for c in range(1, others.shape[1] - 1):
            near &= np.abs(others[None, :, c] - some[:, None, c]) <= r
        all_ = near & (np.abs(others[None, :, -1] - some[:, None, -1]) <= r)
        out += [int((n * np.rint(x @ weight).astype(np.int64)).sum()) for x in (near, all_)]
    return int(out[0]), int(out[1])


def matches(own: np.ndarray, times: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], r: float, twice: bool = True) -> tuple[int, int]:
    """Matching pairs of own rows with each other (if twice) and with those of the others."""
    out = np.zeros(2, np.int64)
    if twice:
        out += (np.array(met(own, times, own, times, r), np.int64) - int(times.sum()) * bool(len(own))) // 2
    for rows, n in others:
        out += met(own, times, rows, n, r)
    return int(out[0]), int(out[1])


def sample_entropies(series: DataFrame, m: int = 2, share: float = 0.2, key: str = "entity", order: str = "t", value: str = "v", block: int = BLOCK) -> DataFrame:
    """key, n and sample_entropy: -ln(A / B) of matching (m + 1)- and m-templates over common starts; no m-match: null, no longer match: infinity.

    The tolerance is `share` of the series' population standard deviation. Nulls and NaN are left out; series shorter than m + 2 give null.
    """
    x = series.select(key, order, F.col(value).cast("double").alias("x0")).filter(F.col("x0").isNotNull() & ~F.isnan("x0"))
    in_time = W.partitionBy(key).orderBy(order)
    names = [f"x{i}" for i in range(m + 1)]
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    sizes = stored(x.groupBy(key).agg(F.count("*").alias("n"), (share * F.stddev_pop("x0")).alias("r"), F.max(F.abs("x0")).alias("_most")), "series")
    width = F.col("r") * (1 + SLACK) + F.col("_most") * 1e-12
    of = sizes.select(F.col(key).alias(f"_{key}"), "r", width.alias("_width"))
    # leads go over one series at a time; Spark sorts it with spilling
    t = x.withColumns({c: F.lead("x0", i).over(in_time) for i, c in enumerate(names) if i}).filter(F.col(names[-1]).isNotNull())
    t = t.groupBy(key, *names).agg(F.count("*").alias("times"))
    few = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    cell = lambda c: F.when(F.col("_width") > 0, F.floor(F.col(c) / F.col("_width"))).otherwise(0).cast("long")
    t = t.join(few(of), same(key)).select(key, *names, "times", "r", cell("x0").alias("c0"), cell("x1" if m > 1 else "x0").alias("c1"))
    templates = stored(t, "templates")
    chunk = BLOCKS * block
    cells = stored(templates.groupBy(key, "c0", "c1").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "template-cells")
    beside = F.explode(F.array(*[F.struct((F.col("c0") - a).alias("c0"), (F.col("c1") - b).alias("c1"), F.lit(k).alias("side")) for k, (a, b) in enumerate(AFTER)])).alias("to")
    # own: a cell's chunks; most: the most chunks among itself and the cells after it
    deals = cells.select(key, "chunks", beside).select(key, "to.*", "chunks").groupBy(key, "c0", "c1").agg(F.max(F.when(F.col("side") == 0, F.col("chunks"))).alias("own"), F.max("chunks").alias("most"))
    deals = stored(deals.filter("own IS NOT NULL"), "template-deals")
    named = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in (key, "c0", "c1")})
    mine = F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")
    held = templates.join(few(named(cells)), same(key) & same("c0") & same("c1")).select(key, *names, "times", "r", "c0", "c1", mine.alias("mine"))
    # a template is in its own cell and among the others of the cells that it comes after
    dealt = held.select(key, *names, "times", "r", "mine", beside).select(key, *names, "times", "r", "mine", "to.*")
    dealt = dealt.join(few(named(deals)), same(key) & same("c0") & same("c1"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda a, b, own: F.struct(a.alias("a"), b.alias("b"), F.lit(own).alias("own"))
    meets = F.when(F.col("side") > 0, F.transform(upto(F.col("own")), lambda a: group(a, F.col("mine"), False))).otherwise(
        F.concat(F.transform(upto(F.col("most")), lambda b: group(F.col("mine"), b, True)), F.transform(upto(F.col("mine")), lambda a: group(a, F.col("mine"), False)))
    )
    dealt = dealt.select(key, *names, "times", "r", "c0", "c1", "side", F.explode(meets).alias("meets")).select(key, *names, "times", "r", "c0", "c1", "side", "meets.*")

    def count(part: pa.Table) -> pa.Table:
        rows, times = np.column_stack([part.column(c).to_numpy() for c in names]), part.column("times").to_numpy()
        own, side = part.column("own").to_numpy(), part.column("side").to_numpy()
        others = [(rows[some], times[some]) for k in range(len(AFTER)) if (some := ~own & (side == k)).any()]
        # a chunk stands in as many groups as there are chunks to meet; in the first of them it meets itself
        short, long = matches(rows[own], times[own], others, part.column("r")[0].as_py(), part.column("b")[0].as_py() == 0)
        return pa.table({key: part.column(key).slice(0, 1), "short": pa.array([short], pa.int64()), "long": pa.array([long], pa.int64())})

    kind = series.schema[key].dataType.simpleString()
    counted = dealt.groupBy(key, "c0", "c1", "a", "b").applyInArrow(count, f"{key} {kind}, short long, long long")
    sums = counted.groupBy(F.col(key).alias("_key")).agg(F.sum("short").alias("b"), F.sum("long").alias("a"))
    out = F.when(F.col("b") > 0, F.when(F.col("a") == 0, float("inf")).otherwise(-F.log(F.col("a") / F.col("b"))))
    return sizes.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", F.when(F.col("n") >= m + 2, out).alias("sample_entropy"))
