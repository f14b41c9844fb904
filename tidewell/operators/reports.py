"""Comparison tables, tests on paired predictions, and the decision gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6


def confusion(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """Counts and rates at each threshold (hundredths), from one fold of rows to score bins."""
    top = F.floor(F.round(F.col("p") * 100, 9)).cast("int")
    bins = rows.groupBy(top.alias("top")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    at = bins.sparkSession.createDataFrame([(k,) for k in thresholds], "threshold_pct int")
    hit = F.col("top") >= F.col("threshold_pct")
    s = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    c = at.crossJoin(bins).groupBy("threshold_pct").agg(s(hit, "pos").alias("tp"), s(hit, "neg").alias("fp"), s(~hit, "pos").alias("fn"), s(~hit, "neg").alias("tn"))  # at most 101 bins times the thresholds
    r = lambda a, b: F.round(F.try_divide(a, b), DIGITS)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("*", r(tp, tp + fn).alias("sensitivity"), r(tn, tn + fp).alias("specificity"), r(tp, tp + fp).alias("precision"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


def entity_confusion(rows: DataFrame, threshold: float) -> DataFrame:
    per = rows.groupBy("entity").agg(F.max("y").alias("y"), F.max("p").alias("p"))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    return per.agg(n(y & hit)("tp"), n(~y & hit)("fp"), n(y & ~hit)("fn"), n(~y & ~hit)("tn"))


def discordant(rows: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """McNemar's counts: rows only a, or only b, gets right, and the corrected statistic."""
    right = lambda s: (F.col(s) >= threshold) == (F.col("y") == 1)
    c = rows.agg(F.sum(F.when(right(a) & ~right(b), 1).otherwise(0)).alias("only_a"), F.sum(F.when(~right(a) & right(b), 1).otherwise(0)).alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return c.withColumn("statistic", F.round(F.try_divide(d * d, F.col("only_a") + F.col("only_b")), DIGITS))


def false_discovery(tests: DataFrame) -> DataFrame:
    """tests (name, p_value) with Benjamini-Hochberg adjusted values."""
    up = W.orderBy("p_value", "name")  # a list of tests
    n = F.count("*").over(W.partitionBy())
    raw = tests.withColumn("rank", F.row_number().over(up)).withColumn("raw", F.col("p_value") * n / F.col("rank"))
    rest = W.orderBy("rank").rowsBetween(0, W.unboundedFollowing)
    return raw.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.min("raw").over(rest)), DIGITS)).drop("raw")


def paired_differences(long: DataFrame, keys: list[str], by: str, base: str, other: str, values: list[str]) -> DataFrame:
    """other minus base for each value, by conditional aggregation (no self-join)."""
    pick = lambda v, k: F.max(F.when(F.col(by) == k, F.col(v)))
    return long.groupBy(*keys).agg(*[F.round(pick(v, other) - pick(v, base), DIGITS).alias(f"{v}_difference") for v in values])


def against_base(table: DataFrame, by: str, base: str, values: list[str]) -> DataFrame:
    """table with each value's difference to the row where by = base (one row)."""
    b = table.filter(F.col(by) == base).select(*[F.col(v).alias(f"_{v}") for v in values])
    return table.crossJoin(F.broadcast(b)).select(*table.columns, *[F.round(F.col(v) - F.col(f"_{v}"), DIGITS).alias(f"{v}_vs_{base}") for v in values])


def robustness(rows: DataFrame, columns: list[tuple[str, str, str]], base: str, other: str) -> DataFrame:
    """Figures of every (representation, configuration) and other minus base for each configuration; none is chosen.

    columns: (representation, configuration, its probability column); rows also have y and w.
    """
    from tidewell.operators.metrics import performance

    each = F.explode(F.array(*[F.struct(F.lit(r).alias("representation"), F.lit(c).alias("configuration"), F.col(p).alias("p")) for r, c, p in columns])).alias("x")
    table = performance(rows.select("y", "w", each).select("y", "w", "x.*"), ["representation", "configuration"])
    pair = paired_differences(table, ["configuration"], "representation", base, other, ["ap", "auroc", "brier"])
    return table.join(pair, "configuration")


def master(parts: dict[tuple[str, str], DataFrame], scores: list[str]) -> DataFrame:
    """section, configuration, score and its figures: parts by (section, configuration) hold rows with y, w and the scores."""
    from tidewell.operators.metrics import performance

    out = []
    for (section, configuration), rows in parts.items():
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("p")) for s in scores])).alias("x")
        table = performance(rows.select("y", "w", each).select("y", "w", "x.*"), ["score"]).select("score", "ap", "auroc", "brier")
        out.append(table.select(F.lit(section).alias("section"), F.lit(configuration).alias("configuration"), "*"))
    return reduce(DataFrame.unionByName, out)


def utility_by_threshold(panel: DataFrame, score: str, thresholds: list[int]) -> DataFrame:
    """threshold_pct, observed utility and its normalised form at each threshold (hundredths).

    Utility sums by entity at all thresholds come from one pass; rows are not repeated for each.
    """
    from tidewell.operators.decision import utilities_by_entity

    per = utilities_by_entity(panel, score, [k / 100 for k in thresholds])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold_pct"), F.col(f"observed_{i}").alias("observed")) for i, k in enumerate(thresholds)])).alias("x")
    o, b, n = (F.sum(c) for c in ("observed", "best", "inaction"))
    return per.select("best", "inaction", at).select("best", "inaction", "x.*").groupBy("threshold_pct").agg(o.alias("observed"), F.try_divide(o - n, b - n).alias("utility"))


GATES = ("ap_above_zero", "sensitivity_superior", "false_alarms_in_budget", "brier_not_worse", "lead_not_shorter", "decision_curve_favorable")


def gates(alarm: DataFrame, inference: DataFrame, curve: DataFrame, transport: DataFrame, base: str, other: str, budget: float = 0.25) -> DataFrame:
    """The six gates, the transport directions and the status they give; a missing figure fails its gate. All inputs are small tables.

    alarm: representation, sensitivity, false_per_day, median_lead. inference: ap_low, brier_low
    (lower ends of other minus base). curve: difference_low, net_low, treat_all, by threshold.
    transport: direction, representation, ap.
    """
    at = lambda c, k: F.max(F.when(F.col("representation") == k, F.col(c)))
    a = alarm.agg(*[at(c, k).alias(f"{n}_{c}") for c in ("sensitivity", "false_per_day", "median_lead") for k, n in ((base, "base"), (other, "other"))])
    good = (F.col("difference_low") > 0) & (F.col("net_low") >= F.col("treat_all")) & (F.col("net_low") >= 0)
    d = curve.agg(F.max(F.coalesce(good, F.lit(False))).alias("favorable"))
    way = transport.groupBy("direction").agg((at("ap", other) > at("ap", base)).alias("better"))
    t = way.agg(F.count("*").alias("directions"), F.sum(F.coalesce(F.col("better").cast("int"), F.lit(0))).alias("directions_better"))
    one = a.crossJoin(inference).crossJoin(d).crossJoin(t)  # one row each
    sure = lambda test: F.coalesce(test, F.lit(False))
    tests = [
        F.col("ap_low") > 0, F.col("other_sensitivity") > F.col("base_sensitivity"), F.col("other_false_per_day") <= budget,
        F.col("brier_low") <= 0, F.col("other_median_lead") >= F.col("base_median_lead"), F.col("favorable"),
    ]
    out = one.select(*[sure(t).alias(n) for n, t in zip(GATES, tests)], "directions", "directions_better")
    internal = F.lit(True)
    for n in GATES:
        internal = internal & F.col(n)
    status = F.when(internal & (F.col("directions_better") == F.col("directions")), "TRANSPORT_ROBUSTNESS_CONFIRMED").when(internal, "PROMISING_BUT_NOT_TRANSPORTABLE").otherwise("NO_VERIFIED_IMPROVEMENT")
    return out.withColumn("status", status)


def gate(differences: DataFrame, least_gain: float = 0.0) -> DataFrame:
    """Status from the per-direction gains: all, some or none above least_gain; a missing gain fails its gate."""
    ok = F.coalesce(F.col("ap_difference") > least_gain, F.lit(False))
    return differences.agg(F.count("*").alias("gates"), F.sum(F.when(ok, 1).otherwise(0)).alias("passed")).withColumn(
        "status", F.when(F.col("passed") == F.col("gates"), "CONFIRMED").when(F.col("passed") > 0, "PARTIAL").otherwise("NOT_CONFIRMED")
    )
