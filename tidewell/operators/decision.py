"""Decision curves, time-dependent utility, and cluster bootstrap of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import poisson_count, unit_hash
from tidewell.operators import replicates
from tidewell.policy import UtilityPolicy

DIGITS = 6


def per_entity_benefit(rows: DataFrame, curve: tuple[int, ...], scores: list[str]) -> DataFrame:
    """Weighted benefit sums by entity and threshold (hundredths), thresholds exploded after the fold."""
    return exploded(wide_benefit(rows, curve, scores), ["entity"], curve, scores)


def wide_benefit(rows: DataFrame, curve: tuple[int, ...], scores: list[str]) -> DataFrame:
    """Per entity w, wy and the benefit sums <score>_<threshold>: one pass over rows (entity, y, w and score columns)."""
    aggs = [F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")]
    for s in scores:
        for k in curve:
            alarm = (F.col(s) >= k / 100).cast("double")
            cost = (k / 100) / (1 - k / 100)
            aggs.append(F.sum(F.col("w") * alarm * (F.col("y") - (1 - F.col("y")) * cost)).alias(f"{s}_{k}"))
    return rows.groupBy("entity").agg(*aggs)


def exploded(wide: DataFrame, keys: list[str], curve: tuple[int, ...], scores: list[str]) -> DataFrame:
    """One row for each threshold from the columns <score>_<threshold>."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("pct"), *[F.col(f"{s}_{k}").alias(f"b_{s}") for s in scores]) for k in curve])).alias("x")
    return wide.select(*keys, "w", "wy", at).select(*keys, "w", "wy", "x.*")


def decision_curve(rows: DataFrame, curve: tuple[int, ...], scores: list[str]) -> DataFrame:
    """Net benefit of each score, of treating all and of treating none, at each threshold."""
    b = per_entity_benefit(rows, curve, scores).groupBy("pct").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), *[F.sum(f"b_{s}").alias(f"b_{s}") for s in scores])
    cost = F.col("pct") / (100 - F.col("pct"))
    return b.select(
        "pct", *[F.round(F.col(f"b_{s}") / F.col("w"), DIGITS).alias(f"net_{s}") for s in scores],
        F.round((F.col("wy") - (F.col("w") - F.col("wy")) * cost) / F.col("w"), DIGITS).alias("treat_all"), F.lit(0.0).alias("treat_none"),
    )


def replicated(per_entity: DataFrame, reps: int, seed: int) -> DataFrame:
    """per_entity with rep and copies: a Poisson(1) cluster bootstrap, each entity's copies from a hash.

    No task needs the list of entities, so replicates spread; rows that get no copy are left out.
    """
    out = per_entity.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return out.withColumn("copies", poisson_count(unit_hash(F.lit(str(seed)), F.col("rep").cast("string"), F.col("entity").cast("string")))).filter("copies > 0")


def bootstrap_curve(rows: DataFrame, curve: tuple[int, ...], scores: list[str], reps: int, seed: int) -> DataFrame:
    """Percentile intervals of net benefit by entity-cluster bootstrap; paired differences for two scores."""
    wide = wide_benefit(rows, curve, scores)
    sums = [c for c in wide.columns if c != "entity"]
    # an entity's copies are drawn once for each replicate; thresholds stay columns until replicates are summed
    per = replicates.totals(wide, sums, reps, seed)
    by = exploded(per, ["rep"], curve, scores)
    nets = {f"net_{s}": F.col(f"b_{s}") / F.col("w") for s in scores}
    if len(scores) == 2:
        nets["difference"] = (F.col(f"b_{scores[1]}") - F.col(f"b_{scores[0]}")) / F.col("w")
    by = by.withColumns(nets)
    aggs = []
    for n in nets:
        for name, q in (("low", 0.025), ("high", 0.975)):
            aggs.append(F.round(F.percentile(n, F.lit(q)), DIGITS).alias(f"{n}_{name}"))
    return by.groupBy("pct").agg(F.count("*").alias("reps"), *aggs)


def bootstrap_scores(rows: DataFrame, scores: list[str], reps: int, seed: int) -> DataFrame:
    """Percentile intervals of average precision and Brier score, and of the difference of two scores."""
    long = rows.select("entity", "y", "w", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("p")) for s in scores])).alias("x")).select("entity", "y", "w", "x.*")
    # rows fold to (entity, score, p) first; copies go with them as arrays, so replicates add no rows
    folded = long.groupBy("entity", "score", "p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    copies = folded.select("entity").distinct().withColumn("copies", replicates.poisson_copies(reps, seed))
    m = replicates.scores(folded, copies, 1)
    wide = m.groupBy("rep").agg(*[F.max(F.when(F.col("score") == s, F.col(c))).alias(f"{c}_{s}") for s in scores for c in ("ap", "brier")])
    names = [f"{c}_{s}" for s in scores for c in ("ap", "brier")]
    if len(scores) == 2:
        wide = wide.withColumns({f"{c}_difference": F.col(f"{c}_{scores[1]}") - F.col(f"{c}_{scores[0]}") for c in ("ap", "brier")})
        names += ["ap_difference", "brier_difference"]
    aggs = [F.round(F.percentile(n, F.lit(q)), DIGITS).alias(f"{n}_{k}") for n in names for k, q in (("low", 0.025), ("high", 0.975))]
    return wide.agg(F.count("*").alias("reps"), *aggs)


def row_utility(d: Column, positive: Column, alarm: Column, u: UtilityPolicy = UtilityPolicy()) -> Column:
    """A row's worth, d rows after the onset (null d: an entity without onset)."""
    rise = F.when(d <= u.optimal, F.greatest(d / float(u.optimal - u.early) + 2.0, F.lit(u.false_alarm))).otherwise(-d / float(u.late - u.optimal) + u.late / float(u.late - u.optimal))
    fall = F.when(d <= u.optimal, 0.0).otherwise(u.worst_miss / float(u.late - u.optimal) * d + u.worst_miss * -u.optimal / float(u.late - u.optimal))
    worth = F.when(alarm, rise).otherwise(fall)
    return F.when(~positive, F.when(alarm, u.false_alarm).otherwise(0.0)).otherwise(F.when(d <= u.late, worth).otherwise(0.0))


def utilities_by_entity(panel: DataFrame, score: str, thresholds: list[float], shift: int = 6, u: UtilityPolicy = UtilityPolicy()) -> DataFrame:
    """Per entity: observed_<k> utility at each threshold, best and inaction utility. Onset: row of the first positive label plus shift."""
    w = W.partitionBy("entity")
    i = panel.withColumn("i", F.row_number().over(w.orderBy("t")) - 1)
    i = i.withColumn("first", F.min(F.when(F.col("label") == 1, F.col("i"))).over(w)).withColumn("d", F.col("i") - (F.col("first") + shift))
    positive = F.col("first").isNotNull()
    best = positive & F.col("d").between(u.early, u.late)
    worth = lambda alarm: F.sum(row_utility(F.col("d"), positive, alarm, u))
    observed = [F.round(worth(F.col(score) >= x), DIGITS).alias(f"observed_{k}") for k, x in enumerate(thresholds)]
    return i.groupBy("entity", "source").agg(*observed, F.round(worth(best), DIGITS).alias("best"), F.round(worth(F.lit(False)), DIGITS).alias("inaction"))


def utility_by_entity(panel: DataFrame, score: str, threshold: float, shift: int = 6, u: UtilityPolicy = UtilityPolicy()) -> DataFrame:
    """Per entity: observed, best and inaction utility at one threshold."""
    return utilities_by_entity(panel, score, [threshold], shift, u).withColumnRenamed("observed_0", "observed")


def bootstrap_utility(per: DataFrame, reps: int, seed: int) -> DataFrame:
    """Percentile interval of normalised utility by entity-cluster bootstrap, from utility_by_entity's rows."""
    sums = replicates.totals(per, ["observed", "best", "inaction"], reps, seed)
    by = sums.select("rep", F.try_divide(F.col("observed") - F.col("inaction"), F.col("best") - F.col("inaction")).alias("u"))
    return by.agg(F.count("u").alias("reps"), *[F.round(F.percentile("u", F.lit(q)), DIGITS).alias(f"utility_{n}") for n, q in (("low", 0.025), ("high", 0.975))])


def normalised_utility(per: DataFrame) -> DataFrame:
    o, b, i = (F.sum(c) for c in ("observed", "best", "inaction"))
    return per.agg(F.round(F.try_divide(o - i, b - i), DIGITS).alias("utility"))
