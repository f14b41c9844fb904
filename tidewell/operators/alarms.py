"""Alarm episodes: rising edges, a refractory period, and what each episode was worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.target import CENSORED, EXACT
from tidewell.operators.windows import refractory, rising_edge
from tidewell.policy import AlarmPolicy


def edges(scored: DataFrame, positive: Column) -> DataFrame:
    return scored.withColumn("positive", positive).withColumn("edge", rising_edge(F.col("positive"))).filter("edge").drop("positive", "edge")


def episodes(edge_rows: DataFrame, keys: list[str], policy: AlarmPolicy = AlarmPolicy()) -> DataFrame:
    """keys and the accepted times. Only edges are gathered per entity, never whole timelines."""
    times = F.array_sort(F.collect_list("t"))
    return edge_rows.groupBy(*keys).agg(times.alias("edges")).select(*keys, refractory(F.col("edges"), policy.refractory).alias("times"))


def classified(per: DataFrame, policy: AlarmPolicy = AlarmPolicy()) -> DataFrame:
    """Counts of an entity's episodes against its onset: useful, false, late, after, of censored entities.

    An entity without onset has false episodes up to its last eligible hour; later ones are right-censored, as
    nobody knows what would have followed.
    """
    times = F.coalesce("times", F.array().cast("array<bigint>"))
    count = lambda test: F.size(F.filter(times, test))
    onset, exact = F.col("onset"), F.col("status") == EXACT
    useful = lambda x: (x >= onset - policy.useful_from) & (x <= onset - policy.useful_to)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ";")
    watched = lambda x: F.coalesce(x <= F.col("last_eligible"), F.lit(False))
    first_useful = F.when(exact, F.array_min(F.filter(times, useful)))
    return per.withColumns({
        "n_episodes": F.size(times),
        "n_useful": F.when(exact, count(useful)).otherwise(0),
        "n_false": F.when(exact, count(lambda x: x < onset - policy.useful_from)).when(F.col("status") == CENSORED, 0).otherwise(count(watched)),
        "n_late": F.when(exact, count(lambda x: (x > onset - policy.useful_to) & (x < onset))).otherwise(0),
        "n_after": F.when(exact, count(lambda x: x >= onset)).otherwise(0),
        "n_censored": F.when(F.col("status") == CENSORED, F.size(times)).otherwise(0),
        "n_right_censored": F.when(exact | (F.col("status") == CENSORED), 0).otherwise(count(lambda x: ~watched(x))),
        "n_repeated": F.greatest(F.size(times) - 1, F.lit(0)),
        "first_alert": F.array_min(times),
        "first_useful": first_useful,
        "lead": onset - first_useful,
        "times_text": text(times),
        "useful_text": F.when(exact, text(F.filter(times, useful))).otherwise(""),
    })


def alarm_rows(scored: DataFrame, positive: Column, policy: AlarmPolicy = AlarmPolicy()) -> DataFrame:
    """One row for each entity: status, onset, eligible hours, watched days and its episodes' classes and times.

    scored needs with_target's columns. All rows make episodes; eligible rows are the exposure.
    """
    per = scored.groupBy("entity", "source").agg(
        F.min("status").alias("status"), F.min("onset").alias("onset"), F.sum("eligible").alias("eligible_hours"), F.max(F.when(F.col("eligible") == 1, F.col("t"))).alias("last_eligible"),
    ).withColumns({"monitored": (F.col("eligible_hours") > 0).cast("int"), "onset_known": (F.col("status") == EXACT).cast("int"), "days": F.round(F.col("eligible_hours") / 24, 6)})
    found = episodes(edges(scored, positive), ["entity"], policy)
    out = classified(per.join(found, "entity", "left"), policy).drop("times", "last_eligible")
    return out.withColumns({"detected": (F.col("n_useful") > 0).cast("int"), "missed": ((F.col("onset_known") == 1) & (F.col("n_useful") == 0)).cast("int")})


def alarm_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Event sensitivity, false episodes a day and lead time, over all rows or by columns."""
    days = F.sum("eligible_hours") / 24
    aggs = [
        F.count("*").alias("entities"), F.sum("monitored").alias("monitored"), F.sum("n_episodes").alias("episodes"),
        F.sum("detected").alias("detected"), F.sum("missed").alias("missed"),
        F.sum("n_false").alias("false_episodes"), F.sum("n_repeated").alias("repeated_episodes"), F.sum("n_late").alias("late_episodes"), F.sum("n_after").alias("after_episodes"),
        F.sum("n_censored").alias("censored_episodes"), F.sum("n_right_censored").alias("right_censored_episodes"),
        F.round(days, 6).alias("days"),
        F.round(F.try_divide(F.sum("n_false"), days), 6).alias("false_per_day"),
        F.round(F.percentile(F.col("lead").cast("double"), F.lit(0.5)), 6).alias("median_lead"),
    ]
    out = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    return out.withColumn("sensitivity", F.round(F.try_divide(F.col("detected"), F.col("detected") + F.col("missed")), 6))


def threshold_sweep(eligible: DataFrame, score: str, policy: AlarmPolicy = AlarmPolicy()) -> DataFrame:
    """alarm_summary's main figures at every threshold of the grid (hundredths), on eligible rows.

    A row's score tells which thresholds it passes, its predecessor's which were passed before:
    the thresholds of its edges are a range, so edges are exploded, not rows times the grid.
    """
    from tidewell.operators.windows import order

    top = F.floor(F.round(F.col(score) * 100, 9)).cast("int")
    grid = F.array(*map(F.lit, policy.grid))
    e = eligible.withColumn("top", top).withColumn("before", F.coalesce(F.lag("top").over(order()), F.lit(-1)))
    edge = e.withColumn("k", F.explode(F.filter(grid, lambda k: (k <= F.col("top")) & (k > F.col("before")))))
    per = eligible.groupBy("entity").agg(F.min("status").alias("status"), F.min("onset").alias("onset"), F.count("*").alias("eligible_hours"), F.max("t").alias("last_eligible"))
    found = episodes(edge, ["entity", "k"], policy).join(per, "entity")
    c = classified(found, policy)
    total = per.agg((F.sum("eligible_hours") / 24).alias("days"), F.sum(F.when(F.col("status") == EXACT, 1).otherwise(0)).alias("at_stake"))
    at = c.groupBy("k").agg(F.sum(F.when(F.col("n_useful") > 0, 1).otherwise(0)).alias("detected"), F.sum("n_false").alias("false_episodes"))
    every = eligible.sparkSession.createDataFrame([(k,) for k in policy.grid], "k int").crossJoin(F.broadcast(total))  # the grid times one row
    out = every.join(at, "k", "left").withColumns({"detected": F.coalesce("detected", F.lit(0)), "false_episodes": F.coalesce("false_episodes", F.lit(0))})
    return out.select(
        F.col("k").alias("threshold_pct"), "detected", "false_episodes",
        F.round(F.try_divide("detected", "at_stake"), 6).alias("sensitivity"), F.round(F.try_divide("false_episodes", "days"), 6).alias("false_per_day"),
    )


def choose_threshold(sweep: DataFrame, policy: AlarmPolicy = AlarmPolicy()) -> DataFrame:
    """The feasible threshold with the best sensitivity, then fewest false episodes, then the lowest."""
    return sweep.filter(F.col("false_per_day") <= policy.most_false_per_day).orderBy(F.desc("sensitivity"), "false_per_day", "threshold_pct").limit(1)
