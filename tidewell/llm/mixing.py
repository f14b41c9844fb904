"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, fill blocks of `block_chars` characters (or of the corpus
over `slots`, if that is more, so that a schedule has some `slots` slots at any size). With target
weight w, block j is released at slot floor(j / w) and due by ceil((j + 1) / w). Earliest deadline
first over the whole schedule, from the weights themselves and in one fold over an array of
sources, gives each block its slot: at no slot is a source a block or more ahead of or behind its
weight. That holds until the first source has no block left (`on_target`); from there on no weights
can hold, and all other blocks follow by deadline. No document is dropped.

DataFrame functions only. A hot source's documents are ranked in ranges of their hash; rows move
once, for that. The fold's work is slots times sources: sources are parts of a mixture, at most
some thousands; for a corpus of web hosts group them first.

Defined results: a null text counts one character, like an empty one; a null source is a source
of its own; rows that repeat a doc_id are placed each; an empty table gives no rows; weights
given for absent sources are left out, sources without a given weight follow last (release and
deadline null); if no source has a weight, all weigh alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import md5_long, parts_for, ranks_of_hash, running, stored

SLOTS = 1 << 18
BLOCK_CHARS = 1 << 16
FOLD = 1 << 24  # slots times sources
CHUNK = 256  # slots whose choices are gathered in one array


def targets(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, block_chars: int, slots: int) -> tuple[DataFrame, int, int]:
    """(source, w and blocks of each source; characters of a block; slots until the first weighted source ends)."""
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        raw = F.coalesce(F.element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("raw", raw)
    n, chars, total = sizes.agg(F.count("*"), F.sum("chars"), F.sum("raw")).first()
    grain = max(block_chars, -(-(chars or 0) // max(1, min(slots, FOLD // max(1, n)))))
    w = F.col("raw") / F.lit(total) if total else F.lit(1.0 / max(1, n))
    plan = sizes.select("source", F.round(w, 12).alias("w"), F.ceil(F.col("chars") / F.lit(grain)).cast("long").alias("blocks"))
    last = plan.filter("w > 0").agg(F.min(F.floor(F.round(F.col("blocks") / F.col("w"), 9)))).first()[0]
    return plan, grain, int(last or 0)


def release(j: Column, w: Column) -> Column:
    return F.floor(F.round(j / w, 9)).cast("long")


def deadline(j: Column, w: Column) -> Column:
    return F.ceil(F.round((j + 1) / w, 9)).cast("long")


def earliest_deadlines(plan: DataFrame, last: int) -> DataFrame:
    """source, block and slot of the slots before `last`.

    The fold's state is each source's count of blocks, the choice for the slot before (not yet
    counted) and the choices so far. Choices are gathered by chunks, as arrays grow by copies.
    """
    one = plan.filter("w > 0").agg(F.array_sort(F.collect_list(F.struct("source", "w"))).alias("src"))  # a row for each source
    one = one.select(F.transform("src", lambda s, i: F.struct(s["source"].alias("source"), s["w"].alias("w"), i.cast("int").alias("i"))).alias("src"))
    none = F.array().cast("array<int>")

    def step(state: Column, t: Column) -> Column:
        done = F.transform(state["done"], lambda c, i: F.when(i == state["pick"], c + 1).otherwise(c))
        due = F.zip_with("src", done, lambda s, c: F.when(release(c, s["w"]) <= t, F.struct(deadline(c, s["w"]).alias("d"), s["i"].alias("i"))))
        pick = F.coalesce(F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"], F.lit(-1))
        return F.struct(done.alias("done"), pick.alias("pick"), F.concat(state["out"], F.array(state["pick"])).alias("out"))

    def chunk(runs: Column, a: Column) -> Column:
        before = F.element_at(runs, -1)
        slots = F.sequence(a, F.least(a + (CHUNK - 1), F.lit(last - 1).cast("long")))
        return F.concat(runs, F.array(F.aggregate(slots, F.struct(before["done"].alias("done"), before["pick"].alias("pick"), none.alias("out")), step)))

    start = F.array(F.struct(F.transform("src", lambda s: F.lit(0).cast("long")).alias("done"), F.lit(-1).alias("pick"), none.alias("out")))
    chunks = F.sequence(F.lit(0).cast("long"), F.lit(last - 1).cast("long"), F.lit(CHUNK).cast("long"))
    ran = one.select("src", F.aggregate(chunks, start, chunk).alias("runs"))
    # a slot's choice stands one place later, the last one in the state
    choices = F.concat(F.flatten(F.transform("runs", lambda r: r["out"])), F.array(F.element_at("runs", -1)["pick"]))
    picked = ran.select("src", F.posexplode(choices).alias("place", "i")).filter("i >= 0")
    slots = picked.select(F.get("src", F.col("i"))["source"].alias("source"), (F.col("place") - 1).cast("long").alias("slot"))
    nth = F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1  # at most SLOTS rows in all
    return slots.withColumn("block", nth.cast("long"))


def schedule(plan: DataFrame, last: int) -> DataFrame:
    """source, block, slot, release, deadline and on_target of every block."""
    blocks = plan.filter("blocks > 0").select("source", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    timed = blocks.select("source", "block", F.when(F.col("w") > 0, release(F.col("block"), F.col("w"))).alias("release"), F.when(F.col("w") > 0, deadline(F.col("block"), F.col("w"))).alias("deadline"))
    if not last:
        return timed.withColumns({"slot": F.lit(0).cast("long"), "on_target": F.lit(False)})
    early = stored(earliest_deadlines(plan, last), "mixing-early").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot")
    both = stored(timed.join(early, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b"), "mixing-blocks")
    # the rest are at most a schedule's blocks; they go by deadline
    order = W.orderBy(F.asc_nulls_last("deadline"), F.asc_nulls_first("source"), "block")
    rest = both.filter("slot IS NULL").withColumn("slot", F.lit(last - 1).cast("long") + F.row_number().over(order))
    return both.filter("slot IS NOT NULL").withColumn("on_target", F.lit(True)).unionByName(rest.withColumn("on_target", F.lit(False)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_chars: int = BLOCK_CHARS, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """Per row: doc_id, source, chars, block, slot, release, deadline and on_target; carry: also row, all columns of docs as one struct.

    weights: by source, or by characters ** alpha.
    """
    parts = parts_for(docs.sparkSession)
    src = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), (F.coalesce(F.length(docs["text"].cast("string")), F.lit(0)) + F.lit(1)).cast("long").alias("chars"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    src = src.withColumn("h", md5_long(F.col("doc_id").cast("string"))).withColumn("part", ranks_of_hash(F.col("h"), parts))
    narrow = stored(src.drop("row"), "mixing-sizes")
    sizes = stored(narrow.groupBy("source").agg(F.sum("chars").alias("chars")), "mixing-sources")
    plan, grain, last = targets(sizes, weights, alpha, block_chars, slots)
    blocks = stored(schedule(plan, last), "mixing-slots")
    placed = running(src if carry else narrow, ["source"], "part", [F.col("h"), F.col("doc_id"), F.col("chars")], "before", "chars", narrow)
    placed = placed.withColumn("block", F.floor(F.col("before") / F.lit(grain)).cast("long"))
    at = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot", "release", "deadline", "on_target")
    if blocks.count() <= 2 * SLOTS:  # rows of some 50 bytes
        at = F.broadcast(at)
    joined = placed.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    return joined.select("doc_id", "source", "chars", "block", "slot", "release", "deadline", "on_target", *(["row"] if carry else []))


def with_slots(docs: DataFrame, slot_col: str, **how) -> DataFrame:
    """docs, all rows and columns, with the slot of each row's block."""
    return mix(docs, carry=True, **how).select("row.*", F.col("slot").alias(slot_col))


def in_schedule_order(docs: DataFrame, **how) -> DataFrame:
    """docs, all rows and columns, dealt out and sorted by their slots."""
    placed = mix(docs, carry=True, **how).select("row", "slot")
    return placed.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def oracle_sql(alpha: float = 0.7, block_chars: int = BLOCK_CHARS, slots: int = SLOTS) -> str:
    """The query's rows in another engine's SQL."""
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(coalesce(length(text), 0) + 1 AS BIGINT) AS chars,
            CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
        s1 AS (SELECT source, sum(chars) AS chars, pow(CAST(sum(chars) AS DOUBLE), {alpha}e0) AS raw FROM d GROUP BY source),
        g AS MATERIALIZED (SELECT greatest({block_chars}, CAST(ceil(sum(chars) * 1e0 / least({slots}, {FOLD} // count(*))) AS BIGINT)) AS grain FROM s1),
        s2 AS MATERIALIZED (SELECT source, round(raw / sum(raw) OVER (), 12) AS w, CAST(ceil(chars * 1e0 / grain) AS BIGINT) AS blocks FROM s1, g),
        one AS MATERIALIZED (SELECT list(source ORDER BY source) AS src, list(w ORDER BY source) AS ws, CAST(min(floor(round(blocks / w, 9))) AS BIGINT) AS last FROM s2),
        f(t, done, pick) AS (
            SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM one
            UNION ALL
            SELECT t + 1, list_transform(done, lambda c, i: CASE WHEN i = k THEN c + 1 ELSE c END), k FROM (
                SELECT t, done, list_min(list_filter(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN floor(round(done[i] / ws[i], 9)) <= t + 1
                    THEN {{'d': ceil(round((done[i] + 1) / ws[i], 9)), 'i': i}} END), lambda x: x IS NOT NULL)).i AS k
                FROM f, one WHERE t + 1 < last)),
        e AS MATERIALIZED (SELECT src[pick] AS source, done[pick] - 1 AS block, t AS slot FROM f, one WHERE pick IS NOT NULL),
        j AS (SELECT source, w, unnest(range(0, blocks)) AS block FROM s2),
        k AS (SELECT j.source, j.block, slot, CAST(floor(round(j.block / w, 9)) AS BIGINT) AS release, CAST(ceil(round((j.block + 1) / w, 9)) AS BIGINT) AS deadline
            FROM j LEFT JOIN e ON j.source = e.source AND j.block = e.block),
        c AS MATERIALIZED (SELECT source, block, release, deadline, slot, true AS on_target FROM k WHERE slot IS NOT NULL
            UNION ALL SELECT source, block, release, deadline, (SELECT last FROM one) - 1 + row_number() OVER (ORDER BY deadline, source, block), false FROM k WHERE slot IS NULL),
        b AS (SELECT d.*, CAST(floor(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY h, doc_id, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1e0 / grain) AS BIGINT) AS block FROM d, g)
        SELECT b.doc_id, b.source, b.chars, b.block, slot, release, deadline, on_target FROM b JOIN c ON b.source = c.source AND b.block = c.block"""
