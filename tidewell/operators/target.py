"""Event time and fixed-horizon target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.policy import TargetPolicy

NEGATIVE, CENSORED, EXACT = "negative", "left_censored", "exact"


def onsets(panel: DataFrame, policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """Per entity: status and onset (first positive + shift; unknown where the first row is positive)."""
    positive = F.min(F.when(F.col("label") == 1, F.col("t")))
    per = panel.groupBy("entity", "source").agg(positive.alias("first"), F.min("t").alias("a"), F.max("t").alias("z"))
    status = F.when(F.col("first").isNull(), NEGATIVE).when(F.col("first") == F.col("a"), CENSORED).otherwise(EXACT)
    return per.select("entity", "source", status.alias("status"), F.when(F.col("first") > F.col("a"), F.col("first") + policy.onset_shift).alias("onset"), F.col("z").alias("last_t"))


def with_onset(panel: DataFrame, policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """panel with status, onset and last_t by window: one shuffle on the entity, shared with other windows."""
    every = W.partitionBy("entity")
    out = panel.withColumns({"_first": F.min(F.when(F.col("label") == 1, F.col("t"))).over(every), "_a": F.min("t").over(every), "last_t": F.max("t").over(every)})
    status = F.when(F.col("_first").isNull(), NEGATIVE).when(F.col("_first") == F.col("_a"), CENSORED).otherwise(EXACT)
    return out.withColumns({"status": status, "onset": F.when(F.col("_first") > F.col("_a"), F.col("_first") + policy.onset_shift)}).drop("_first", "_a")


def with_target(panel: DataFrame, policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """panel with hours_to_onset, eligible and target.

    Exact: eligible before the onset, target 1 from 1 to `horizon` hours before. Negative:
    eligible up to `horizon` before the last row, target 0. Left-censored: never eligible.
    """
    out = with_onset(panel, policy)
    hours = F.col("onset") - F.col("t")
    eligible = F.when(F.col("status") == EXACT, hours > 0).when(F.col("status") == NEGATIVE, F.col("t") <= F.col("last_t") - policy.horizon).otherwise(F.lit(False))
    target = F.when(F.col("eligible") == 1, F.when((F.col("status") == EXACT) & F.col("hours_to_onset").between(1, policy.horizon), 1).otherwise(0))
    return out.withColumns({"hours_to_onset": hours, "eligible": eligible.cast("int")}).withColumn("target", target)


def onset_violations(panel: DataFrame, given: DataFrame, policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """Entities whose given status or onset is not what the labels say: entity, status, onset, want_status, want_onset."""
    want = onsets(panel, policy).select("entity", F.col("status").alias("want_status"), F.col("onset").alias("want_onset"))
    both = given.select("entity", "status", "onset").join(want, "entity", "full_outer")
    return both.filter(~(F.col("status").eqNullSafe(F.col("want_status")) & F.col("onset").eqNullSafe(F.col("want_onset"))))


def decisions(targeted: DataFrame) -> DataFrame:
    return targeted.filter("eligible = 1")


def target_violations(targeted: DataFrame) -> DataFrame:
    """Rows whose target, eligibility or onset contradict each other."""
    bad = (
        ((F.col("eligible") == 1) & F.col("target").isNull()) | ((F.col("eligible") == 0) & F.col("target").isNotNull())
        | ((F.col("status") != EXACT) & F.col("onset").isNotNull()) | ((F.col("status") == CENSORED) & (F.col("eligible") == 1))
    )
    return targeted.filter(bad)
