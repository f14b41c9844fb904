"""DeLong's comparison of two scores, isotonic calibration, paired multinomial bootstrap and permutation importances."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import text_hash
from tidewell.operators import replicates
from tidewell.sources.shared import stored

DIGITS = 6


# --- DeLong ----------------------------------------------------------------------------------

# fixed values: a published approximation of the complementary error function, error below 2e-7
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal Z."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + ERFC[0] * x)
    poly = reduce(lambda acc, c: (acc + c) * t, reversed(ERFC[1:]), F.lit(0.0))
    return poly * F.exp(-x * x)


def placements(rows: DataFrame, score: str, digits: int) -> DataFrame:
    """Per distinct score: the share of negatives below a positive that stands there, and of positives above a negative; ties count half.

    Counts at each distinct score meet in one running sum: scores are rounded to `digits`, so it goes over 10**digits rows at most.
    """
    tied = rows.groupBy(F.round(score, digits).alias(score)).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    under = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0.0))
    every = lambda c: F.sum(c).over(W.partitionBy())
    of_pos = (under("neg") + F.col("neg") / 2) / every("neg")
    of_neg = (every("pos") - under("pos") - F.col("pos") / 2) / every("pos")
    return tied.select(score, of_pos.alias(f"{score}_pos"), of_neg.alias(f"{score}_neg"))


def delong(rows: DataFrame, a: str, b: str, digits: int = DIGITS) -> DataFrame:
    """AUROC of scores a and b on the same rows (y of 0 and 1), the variance of their difference, z and p; one row.

    Rows fold to distinct pairs of scores by class; the covariance of placement values is made of sums
    over these, so no positive is ever paired with a negative.
    """
    y = rows.select(F.col("y").cast("double").alias("y"), F.round(a, digits).alias(a), F.round(b, digits).alias(b))
    folded = y.groupBy("y", a, b).agg(F.count("*").cast("double").alias("n"))
    at = folded.join(placements(y, a, digits), a).join(placements(y, b, digits), b)
    va, vb = (F.when(F.col("y") == 1, F.col(f"{s}_pos")).otherwise(F.col(f"{s}_neg")) for s in (a, b))
    n, d = F.col("n"), vb - va
    per = at.groupBy("y").agg(F.sum("n").alias("n"), F.sum(n * va).alias("sa"), F.sum(n * vb).alias("sb"), F.sum(n * d).alias("sd"), F.sum(n * d * d).alias("sdd"))
    # the variance of the mean difference of placements, by class
    spread = F.try_divide(F.col("sdd") - F.col("sd") * F.col("sd") / F.col("n"), (F.col("n") - 1) * F.col("n"))
    one = per.withColumn("spread", spread).agg(
        F.max(F.when(F.col("y") == 1, F.col("sa") / F.col("n"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("sb") / F.col("n"))).alias("auc_b"),
        F.max(F.when(F.col("y") == 1, F.col("n"))).cast("long").alias("positives"), F.max(F.when(F.col("y") == 0, F.col("n"))).cast("long").alias("negatives"), F.sum("spread").alias("variance"),
    )
    z = F.try_divide(F.col("auc_b") - F.col("auc_a"), F.sqrt("variance"))
    shown = [F.round(c, DIGITS).alias(c) for c in ("auc_a", "auc_b")]
    return one.select("positives", "negatives", *shown, F.round("variance", 12).alias("variance"), F.round(z, 4).alias("z"), F.round(two_sided(z), 5).alias("p_value"))


# --- isotonic calibration --------------------------------------------------------------------

BLOCK = "low double, high double, w double, wy double"
FAN = 16


def pooled(w: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """Where pooled blocks begin: neighbours whose means do not increase become one, from the left."""
    first: list[int] = []
    weight: list[float] = []
    total: list[float] = []
    for i, (a, b) in enumerate(zip(w.tolist(), wy.tolist())):
        first.append(i)
        weight.append(a)
        total.append(b)
        while len(first) > 1 and total[-2] * weight[-1] >= total[-1] * weight[-2]:
            first.pop()
            a, b = weight.pop(), total.pop()
            weight[-1] += a
            total[-1] += b
    return np.array(first, np.int64)


def isotonic_blocks(rows: DataFrame, digits: int = DIGITS, parts: int = 64) -> DataFrame:
    """low, high, w and value of the blocks of weighted isotonic regression of y on p, in p order.

    Rows (y, p, w) fold to distinct scores, which are cut into ranges. Each range pools its own violators
    and sends blocks; FAN neighbouring ranges then pool theirs together, and so on. Pooling pooled blocks gives what
    one pass over all would, as means only ever fall together.
    """
    tied = rows.groupBy(F.round("p", digits).alias("p")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).filter("w > 0")
    part = F.least(F.floor(F.col("p") * parts), F.lit(parts - 1)).cast("int")
    blocks = tied.select(part.alias("part"), F.col("p").alias("low"), F.col("p").alias("high"), "w", "wy")

    def pool(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("low").to_numpy())
        low, high, w, wy = (t.column(c).to_numpy()[order] for c in ("low", "high", "w", "wy"))
        at = pooled(w, wy)
        end = np.r_[at[1:], len(w)] - 1
        return pa.table({"part": pa.array(np.full(len(at), t.column("part")[0].as_py()), pa.int32()), "low": low[at], "high": high[end], "w": np.add.reduceat(w, at), "wy": np.add.reduceat(wy, at)})

    while True:
        blocks = stored(blocks.groupBy("part").applyInArrow(pool, f"part int, {BLOCK}"), "isotonic")
        if parts == 1:
            return blocks.select("low", "high", "w", (F.col("wy") / F.col("w")).alias("value"))
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))


def isotonic(rows: DataFrame, blocks: DataFrame, score: str = "p", out: str = "p_isotonic") -> DataFrame:
    """rows with the value of the last block that begins at or below the score (the first block below all).

    Blocks and rows meet in ranges of the score; a range also gets the last block before it.
    """
    steps = blocks.select(F.col("low").alias(score), F.col("value").alias("_value"), F.lit(True).alias("_step"))
    lowest = blocks.agg(F.min(F.struct("low", "value")).alias("m")).select("m.value")
    parts = 256
    part = lambda c: F.least(F.floor(c * parts), F.lit(parts - 1)).cast("int")
    steps = steps.withColumn("_part", part(F.col(score)))
    last = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = steps.groupBy("_part").agg(F.max(F.struct(F.col(score), "_value")).alias("_end"))  # a row a range
    spine = rows.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left").withColumn("_before", F.last("_end", True).over(last))
    mine = rows.withColumns({"_part": part(F.col(score)), "_value": F.lit(None).cast("double"), "_step": F.lit(False)})
    both = mine.unionByName(steps, allowMissingColumns=True)
    upto = W.partitionBy("_part").orderBy(F.col(score), F.col("_step").desc()).rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("_held", F.last("_value", True).over(upto)).filter(~F.col("_step"))
    found = held.join(F.broadcast(spine.select("_part", F.col("_before._value").alias("_carried"))), "_part", "left").crossJoin(F.broadcast(lowest.withColumnRenamed("value", "_lowest")))  # one row
    return found.withColumn(out, F.coalesce("_held", "_carried", "_lowest")).select(*rows.columns, out)


# --- paired multinomial bootstrap ------------------------------------------------------------

BUCKET = 20_000  # entities, on average, whose copies one task draws
TRIES = 10


def _buckets(entities: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(entity, label, bucket: a range of the entity's hash; how many entities each bucket has)."""
    n = entities.count()
    many = max(1, -(-n // BUCKET))
    at = F.floor(text_hash(F.lit("bucket"), F.col("entity").cast("string")) / F.lit(float(1 << 60)) * many).cast("int")
    dealt = stored(entities.select("entity", "label", at.alias("bucket")), "bootstrap-entities")
    sizes = np.zeros(many, np.int64)
    for r in dealt.groupBy("bucket").count().collect():  # a number for each bucket
        sizes[r["bucket"]] = r["count"]
    return dealt, sizes


def multinomial_copies(entities: DataFrame, reps: int, seed: int) -> DataFrame:
    """entity, rep and copies (above 0) of a bootstrap that draws as many entities as there are, with replacement, in every replicate.

    entities: entity and label (0, 1), a row each. A replicate's total is split between hash ranges of
    entities on the driver (a number for each range and replicate), and in each range between its entities by the task that
    holds it; both are multinomial, so all is. A replicate without both labels is drawn again, TRIES times at most, then left out.
    """
    dealt, sizes = _buckets(entities)
    total = int(sizes.sum())
    tries = {r: 0 for r in range(1, reps + 1)}
    shares = sizes / max(1, total)

    def drawn(some: dict[int, int]) -> DataFrame:
        split = {(r, k): np.random.default_rng([seed, r, k]).multinomial(total, shares).astype(np.int32) for r, k in some.items()}
        sent = dealt.sparkSession.sparkContext.broadcast(split)

        def run(t: pa.Table) -> pa.Table:
            order = t.column("entity").take(pc.sort_indices(t.column("entity")))
            label = t.column("label").take(pc.sort_indices(t.column("entity")))
            bucket, n = t.column("bucket")[0].as_py(), t.num_rows
            out = []
            for (r, k), m in sent.value.items():
                copies = np.random.default_rng([seed, r, k, bucket + 1]).multinomial(m[bucket], np.full(n, 1 / n))
                at = np.flatnonzero(copies)
                out.append(pa.table({"entity": order.take(pa.array(at)), "label": label.take(pa.array(at)), "rep": pa.array(np.full(len(at), r), pa.int32()), "copies": pa.array(copies[at], pa.int64())}))
            return pa.concat_tables(out)

        kind = dealt.schema["entity"].dataType.simpleString()
        return dealt.groupBy("bucket").applyInArrow(run, f"entity {kind}, label int, rep int, copies long")

    done: list[DataFrame] = []
    while tries:
        now = stored(drawn(tries), "bootstrap-copies")
        both = {r["rep"] for r in now.groupBy("rep").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("rep").collect()}  # numbers of replicates
        done.append(now.filter(F.col("rep").isin(sorted(both))).drop("label") if len(both) < len(tries) else now.drop("label"))
        tries = {r: k + 1 for r, k in tries.items() if r not in both and k + 1 <= TRIES}
    return reduce(DataFrame.unionByName, done)


def paired_bootstrap(rows: DataFrame, scores: tuple[str, str], reps: int, seed: int) -> DataFrame:
    """figure, estimate, low, high and reps of average precision and Brier score of two scores, and of their differences.

    rows: entity, y, w and both scores. Both are taken from the same draws; entities are drawn, not rows.
    """
    a, b = scores
    entities = rows.groupBy("entity").agg(F.max("y").cast("int").alias("label"))
    copies = multinomial_copies(entities, reps, seed)
    every = entities.select("entity", F.lit(0).alias("rep"), F.lit(1).cast("long").alias("copies"))
    long = rows.select("entity", "y", "w", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("p")) for s in scores])).alias("x")).select("entity", "y", "w", "x.*")
    folded = long.groupBy("entity", "score", "p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    per = replicates.scores(folded, replicates.dense(copies.unionByName(every), reps), 0)
    at = lambda s, f: F.max(F.when(F.col("score") == s, F.col(f)))
    wide = per.groupBy("rep").agg(*[x for f in ("ap", "brier") for x in (at(a, f).alias(f"{f}_{a}"), at(b, f).alias(f"{f}_{b}"), (at(b, f) - at(a, f)).alias(f"{f}_difference"))])
    figures = wide.unpivot("rep", [c for c in wide.columns if c != "rep"], "figure", "value")
    ends = [F.round(F.percentile(F.when(F.col("rep") > 0, F.col("value")), F.lit(s)), DIGITS).alias(n) for n, s in (("low", 0.025), ("high", 0.975))]  # a value a replicate
    return figures.groupBy("figure").agg(F.round(F.max(F.when(F.col("rep") == 0, F.col("value"))), DIGITS).alias("estimate"), *ends, F.count(F.when(F.col("rep") > 0, F.col("value"))).alias("reps"))


# --- importances -----------------------------------------------------------------------------


def shuffled(rows: DataFrame, column: str, seed: int, within: str | None = None, keys: tuple[str, ...] = ("entity", "t")) -> DataFrame:
    """rows with the values of one column dealt anew among them (inside each group of `within`), by hash: no row keeps its own but by chance.

    Values and rows are ranked by two hashes, in ranges of the hash, and meet by rank.
    """
    from tidewell.operators.selection import ranked_by_hash

    group = [within] if within else []
    h = lambda side: text_hash(F.lit(f"{seed}|{side}"), *[F.col(k).cast("string") for k in keys])
    to = ranked_by_hash(rows.drop(column).withColumn("_h", h("to")), group, "_h", list(keys), "_rank").drop("_h")
    of = ranked_by_hash(rows.select(*group, *keys, column).withColumn("_h", h("of")), group, "_h", list(keys), "_rank").select(*group, "_rank", column)
    return to.join(of, [*group, "_rank"]).select(*rows.columns)


def importances(rows: DataFrame, inputs: list[str], score: Callable[[DataFrame], Column], loss: Callable[[DataFrame], float], seed: int, within: str | None = None) -> DataFrame:
    """input, loss and rise (over the loss with all inputs as they are), the largest rise first; each input is permuted in turn.

    score: the prediction column for rows; loss: a number for rows with y, w and p. Rows are held-out ones.
    """
    at = lambda df: float(loss(df.withColumn("p", score(df))))
    rows = stored(rows, "importance-rows")
    base = at(rows)
    found = [(x, at(shuffled(rows, x, seed + i, within)), base) for i, x in enumerate(inputs)]
    out = rows.sparkSession.createDataFrame(found, "input string, loss double, base double")
    return out.select("input", F.round("loss", DIGITS).alias("loss"), F.round(F.col("loss") - F.col("base"), DIGITS).alias("rise")).orderBy(F.desc("rise"), "input")


def log_loss(rows: DataFrame) -> float:
    p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    return rows.agg(F.sum(-F.col("w") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))) / F.sum("w")).first()[0]
