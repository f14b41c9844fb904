"""Signal support, robust scales, folds, strata and profile choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import text_hash
from tidewell.operators.quantiles import quantiles
from tidewell.sources.shared import stored

DIGITS = 6
FEW_GROUPS = 1000


def long_signals(panel: DataFrame, signals: list[str]) -> DataFrame:
    return panel.unpivot(["entity", "source", "t"], signals, "signal", "value")


def signal_support(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Per signal: share of rows observed, and entities with two observations or more."""
    per = long_signals(panel, signals).groupBy("signal", "entity").agg(F.count("*").alias("rows"), F.count("value").alias("seen"))
    return per.groupBy("signal").agg(F.round(F.sum("seen") / F.sum("rows"), DIGITS).alias("coverage"), F.sum(F.when(F.col("seen") >= 2, 1).otherwise(0)).alias("entities"))


def top_signals(support: DataFrame, k: int) -> DataFrame:
    return support.orderBy(F.desc("coverage"), "signal").limit(k)


def supported_signals(panel: DataFrame, signals: list[str], least_coverage: float, least_entities: int, most: int) -> tuple[str, ...]:
    """Signals with enough coverage and entities, best covered first (ties by name): a list of names."""
    good = signal_support(panel, signals).filter((F.col("coverage") >= least_coverage) & (F.col("entities") >= least_entities))
    return tuple(r["signal"] for r in top_signals(good, most).collect())


def location_scale(panel: DataFrame, signals: list[str]) -> DataFrame:
    """Per signal: median and interquartile range (1 where that is 0 or missing)."""
    names = panel.sparkSession.createDataFrame([(s,) for s in signals], "signal string")
    found = quantiles(long_signals(panel, signals), ["signal"], "value", [0.25, 0.5, 0.75])
    q = names.join(F.broadcast(found), "signal", "left")  # a row for each signal
    iqr = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    return q.select("signal", F.round(F.get("q", F.lit(1)), DIGITS).alias("median"), F.round(F.when(F.coalesce(iqr, F.lit(0.0)) > 0, iqr).otherwise(1.0), DIGITS).alias("scale"))


def stratified_folds(entities: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """entities (entity, label) with a fold: hash order within a label, dealt in turn; same rows, same folds."""
    ranked = ranked_by_hash(entities.withColumn("_h", text_hash(F.lit(str(seed)), F.col("entity").cast("string"))), ["label"], "_h", ["entity"], "_rank")
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_h", "_rank")


def ranked_by_hash(df: DataFrame, group: list[str], h: str, ties: list[str], out: str) -> DataFrame:
    """Rank of each row in its group by a 60-bit hash h, from 0, in ranges of the hash: no task holds a group.

    Rows are ranked inside a range and shifted by the sizes of the ranges before, a row for each
    group and range; groups are few here (classes, strata), and more than FEW_GROUPS are refused.
    """
    parts = max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_part", F.floor(F.col(h) / F.lit(float(1 << 60)) * parts).cast("int"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored(dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n")), "range-sizes")
    if sizes.count() > FEW_GROUPS * parts:
        raise ValueError(f"more than {FEW_GROUPS} groups: rank them by their own key")
    shift = sizes.select(*[F.col(c).alias(f"_{c}_") for c in [*group, "_part"]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = dealt.withColumn("_inner", F.row_number().over(W.partitionBy(*group, "_part").orderBy(h, *ties)) - 1)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*group, "_part"]])
    return inner.join(F.broadcast(shift), on).select(*df.columns, (F.col("_inner") + F.col("_shift")).alias(out))


def codes(df: DataFrame, key: str, out: str = "code") -> DataFrame:
    """Distinct keys with their place in sorted order, from 0: ranked in ranges of the key, shifted by the sizes of the ranges before."""
    ids = df.select(F.col(key)).distinct()
    parts = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = sorted(set(ids.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: e < F.col(key)))
    dealt = ids.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select(F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))  # a row for each range
    ranked = dealt.withColumn("_inner", F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1)
    return ranked.join(F.broadcast(shift), F.col("_part") == F.col("_at")).select(key, (F.col("_inner") + F.col("_shift")).alias(out))


def round_count(rounds: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median of value in each group, rounded half to even, at least 1."""
    return rounds.groupBy(*by).agg(F.greatest(F.lit(1), F.bround(F.percentile(value, F.lit(0.5))).cast("int")).alias("rounds"))


def top_of_strata(df: DataFrame, strata: list[str], most: int, order: str = "entity") -> DataFrame:
    """The first n rows of each stratum, n the smaller of `most` and the smallest stratum's size.

    n is counted first, so that each partition sends no more than n rows of a stratum.
    """
    n = df.groupBy(*strata).count().agg(F.least(F.min("count"), F.lit(most).cast("long")).alias("n")).first()["n"] or 0
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*strata).orderBy(order))).filter(F.col("rank") <= n)


def smallest_fast_enough(profiles: DataFrame, slack: float = 0.05) -> DataFrame:
    """Of profiles (name, cost, elapsed) within slack of the fastest, the cheapest (then fastest, then by name)."""
    fast = F.col("elapsed") <= (1 + slack) * F.min("elapsed").over(W.partitionBy())
    return profiles.withColumn("fast", fast).filter("fast").drop("fast").orderBy("cost", "elapsed", "name").limit(1)
