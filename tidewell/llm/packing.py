"""Best-fit packing by a configuration linear program.

1. Tokenise each whole text (one Arrow pass); cut documents above the capacity.
2. Count piece lengths: a histogram of at most `capacity` rows, whatever the corpus.
3. On that histogram solve the configuration LP (cover all pieces with as few sequences as may
   be) by multiplicative weights, until the least covered length is covered; a knapsack dynamic
   program prices the lengths and gives the next configurations. Round, then place what is left
   best-fit, all in run lengths.
4. Rank the pieces of each length (in ranges of their hash, so that a length with a third of all
   rows spreads) and join ranks to the plan's runs. Only ids, lengths and ranks move. Where documents have
   slots of a schedule, pieces of a length rank by slot, and sequences are numbered by the
   earliest slot in them.

Defined results: a null text is empty, so its document is the end id alone; every row gives its
pieces, repeated doc_ids too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text, parts_for, ranks_of_hash, running, stored

log = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "_slot"]
# fixed value: the pieces that byte-level BPE of this kind merges within
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The vocabulary comes from a byte-level BPE file of the tokenizers library. Its ids are the
    ranks of its merges, so tiktoken, which is several times faster, gives the same ids from the
    same file; a text that it refuses (a huge run of white space) goes to tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def encode(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4").tobytes()
        except (ValueError, UnicodeError):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE files: itself if printable, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", slot_col: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and crc32 of each piece of each document; _slot too where slot_col is given."""
    fields = [(n, t) for n, t in zip(PIECE_NAMES, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))][: 6 if slot_col else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for doc_id, text, *slot in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
                    ids = enc.encode(text or "") + end
                    rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), *slot) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])

    texts = ids_and_text(docs, id_col, text_col)
    if slot_col:
        texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[slot_col].cast("long").alias("_slot"))
    return texts.mapInArrow(run, PIECES + (", _slot long" if slot_col else ""))


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room the best value of an unbounded knapsack, and the length it takes first (0: leave one token free)."""
    price = np.full(capacity + 1, -1.0)
    price[lengths] = prices
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1]
        k = int(value.argmax())
        best[room] = best[room - 1]
        if value[k] > best[room] + 1e-15:
            best[room], take[room] = value[k], k + 1
    return best, take


def filled(take: np.ndarray, room: int) -> dict[int, int]:
    """The configuration {length: copies} that a knapsack's choices give a room."""
    config: dict[int, int] = {}
    while room > 0:
        size = int(take[room])
        if size:
            config[size] = config.get(size, 0) + 1
        room -= size or 1
    return config


def priced(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The knapsack's best value and its configuration {length: copies}."""
    best, take = knapsack(prices, lengths, capacity)
    return float(best[capacity]), filled(take, capacity)


def cover(histogram: dict[int, int], capacity: int, eta: float = 0.5, slack: float = 0.02, gap: float = 0.01, rounds: int = 200) -> tuple[dict[tuple, float], float]:
    """({configuration: sequences}, lower bound): a fractional cover of every length, least covered one included.

    Multiplicative weights on the covering LP. In a round each length is covered once at most (the
    width), by configurations worth the round's best value but for `slack`: a knapsack prices the
    lengths still open, and each of them gives the configuration that holds it in the best company.
    Then the weights fall by what was covered. Any prices bound the LP from below, so rounds end when
    the cover, scaled by its least covered length, is within `gap` of the bound; or after `rounds`,
    but never before each length is covered.
    """
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    at = {int(x): i for i, x in enumerate(lengths)}
    weight = lengths * demand / (lengths * demand).sum()
    covered = np.zeros(len(lengths))
    configs: dict[tuple, float] = {}
    bound = total = 0.0
    done = 0
    while not covered.min() or (done < rounds and total > (1 + gap) * bound * covered.min()):
        price = weight / demand
        got = np.zeros(len(lengths))
        top = None
        while (free := got < 1 - 1e-9).any():
            best, take = knapsack(price[free], lengths[free], capacity)
            if top is None:
                top = best[capacity]
                bound = max(bound, float(weight.sum() / top))
            value = np.where(free, price + best[capacity - lengths], 0.0)
            near = [i for i in np.argsort(-value, kind="stable").tolist() if value[i] >= (1 - slack) * top]
            if not near:
                break
            for i in near:
                size = int(lengths[i])
                config = filled(take, capacity - size)
                config[size] = config.get(size, 0) + 1
                step = min((1 - got[at[s]]) * demand[at[s]] / n for s, n in config.items())
                if step <= 1e-9:
                    continue
                key = tuple(sorted(config.items()))
                configs[key] = configs.get(key, 0.0) + step
                total += step
                for s, n in config.items():
                    got[at[s]] += n * step / demand[at[s]]
        covered += got
        weight = weight * np.exp(-eta * got)
        weight /= weight.sum()
        done += 1
    return {c: x / covered.min() for c, x in configs.items()}, bound


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(configuration {length: copies}, times)] that holds each length as often as the histogram.

    The cover is rounded down, then each configuration gets one sequence more while its pieces
    last; what is left, best-fit decreasing places on open room.
    """
    plan: list[tuple[dict[int, int], int]] = []
    left = {int(k): int(v) for k, v in histogram.items()}
    if capacity in left:
        plan.append(({capacity: 1}, left.pop(capacity)))
    if left:
        configs, bound = cover(left, capacity)
        order = sorted(configs.items(), key=lambda x: -x[1])
        from_cover: list[tuple[dict[int, int], int]] = []
        for most in ([int(x + 1e-9) for _, x in order], [1] * len(order)):
            for (config, _), times in zip(order, most):
                n = min(times, *(left[s] // k for s, k in config))
                if n > 0:
                    from_cover.append((dict(config), n))
                    for s, k in config:
                        left[s] -= k * n
        rest = best_fit(left, capacity)
        log.info("sequences below the capacity: %d by the linear program, %d by best-fit, bound %.1f", sum(n for _, n in from_cover), sum(n for _, n in rest), bound)
        plan += from_cover + rest
    return plan


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing in run lengths: sequences that look alike are opened and filled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    done: list[tuple[dict[int, int], int]] = []
    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                fill = min(capacity // size, n)
                times = n // fill
                runs = [({size: fill}, times)]
                room_after = capacity - fill * size
                n -= fill * times
            else:
                config, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                fill = min(room // size, n)
                used = min(times, n // fill)
                if used < times:
                    open_.setdefault(room, []).append((config, times - used))
                runs = [(config | {size: fill}, used)]
                room_after = room - fill * size
                n -= fill * used
            if room_after:
                open_.setdefault(room_after, []).extend(runs)
            else:
                done += runs
    return done + [x for runs in open_.values() for x in runs]


def plan_runs(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies in a sequence, first offset) of each run."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for config, times in plan:
        offset = 0
        for size in sorted(config, reverse=True):
            k = config[size]
            first = used.get(size, 0)
            runs.append((size, first, k * times, sequence, k, offset))
            used[size] = first + k * times
            offset += k * size
        sequence += times
    return runs


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be stored (it is read twice)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan_runs(solve(histogram, capacity))
    plan = spark.createDataFrame(runs, "length long, first long, ranks long, sequence long, copies long, place long")
    # One list of runs for each length: at most `capacity` rows, each found by bisection on the first rank.
    by_length = plan.groupBy(F.col("length").alias("_length")).agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "copies", "place"))).alias("runs"))
    scheduled = "_slot" in pieces.columns
    parts = parts_for(spark)
    order = [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    keyed = pieces.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", "piece"), 4))
    part, of_slots = ranks_of_hash(F.col("_h"), parts), None
    if scheduled:
        # ranges of slots take the place of ranges of hashes
        last = (pieces.agg(F.max("_slot")).first()[0] or 0) + 1
        of_slots = lambda slot: F.floor(slot * F.lit(parts) / F.lit(last)).cast("int")
        part, order = of_slots(F.col("_slot")), [F.col("_slot"), *order]
    ranked = running(keyed.withColumn("_part", part), ["length"], "_part", order, "rank")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    j = ranked.join(F.broadcast(by_length), F.col("length") == F.col("_length")).withColumn("_run", run)  # at most `capacity` rows
    within = F.col("rank") - F.col("_run.first")
    placed = j.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(within / F.col("_run.copies")).cast("long")).alias("sequence_id"),
        (F.col("_run.place") + F.pmod(within, F.col("_run.copies")) * F.col("length")).cast("long").alias("offset"),
    )
    if not scheduled:
        return placed
    placed = stored(placed, "placed")
    first = stored(placed.groupBy("sequence_id").agg(F.min("_slot").alias("_first")).withColumn("_part", of_slots(F.col("_first"))), "sequences")
    number = running(first, [], "_part", [F.col("_first"), F.col("sequence_id")], "_number").select(F.col("sequence_id").alias("_sequence"), "_number")
    return placed.join(number, F.col("sequence_id") == F.col("_sequence")).select(*[c for c in pieces.columns if c != "_slot"], F.col("_number").cast("long").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, slot_col: str | None = None) -> DataFrame:
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, slot_col=slot_col), "pieces")
    return pack(pieces, capacity)
