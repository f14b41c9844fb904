"""Queries over the panel that the events table makes, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import alarms, decision, metrics, selection, target, validate, windows
from tidewell.policy import AlarmPolicy, ModelPolicy, PanelPolicy, UtilityPolicy
from tidewell.sources.panel import densify, hours_since, panel_from_events

SIGNALS = list(PanelPolicy().signals)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from_events(table(spark, sf_dir, "events"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(panel(spark, sf_dir))


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.with_target(panel(spark, sf_dir))


def scored(df: DataFrame) -> DataFrame:
    """p0 and p1, two deterministic probabilities from the last observed signals."""
    logistic = lambda x, a, b: F.round(1 / (1 + F.exp(-(F.coalesce(x, F.lit(0.0)) - a) / b)), 6)
    return df.withColumns({"p0": logistic(windows.last_observation("click"), 40.0, 40.0), "p1": logistic(windows.last_observation("error"), 60.0, 30.0)})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision rows as (entity, source, t, y, p, p0, p1, w): the metrics' input."""
    d = target.decisions(scored(targeted(spark, sf_dir)))
    return d.select("entity", "source", "t", F.col("target").cast("double").alias("y"), F.col("p0").alias("p"), "p0", "p1", scalars.equal_entity_weight().alias("w"))


_avg = ", ".join(f"round(avg(CASE WHEN event_type = '{s}' THEN value END), 6) AS {s}" for s in SIGNALS)
PANEL = f"""WITH e AS (SELECT user_id AS entity, event_id, event_type, value,
      CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) + 1 AS t FROM events),
    p0_ AS (SELECT entity, t, {_avg}, max(CASE WHEN event_type = 'error' AND value >= 130 THEN 1 ELSE 0 END) AS trigger_ FROM e GROUP BY entity, t),
    panel AS (SELECT entity, CASE WHEN entity % 2 = 0 THEN 'A' ELSE 'B' END AS source, t, {', '.join(SIGNALS)},
      CAST(max(trigger_) OVER (PARTITION BY entity ORDER BY t) AS INTEGER) AS label FROM p0_)"""
DENSE = PANEL + f""", spine AS (SELECT entity, source, unnest(range(min(t), max(t) + 1)) AS t FROM panel GROUP BY entity, source),
    dense AS (SELECT s.entity, s.source, s.t, {', '.join(SIGNALS)}, max(label) OVER (PARTITION BY s.entity ORDER BY s.t) AS label
      FROM spine s LEFT JOIN panel p ON s.entity = p.entity AND s.t = p.t)"""
TARGET = PANEL + """, o AS (SELECT *, min(CASE WHEN label = 1 THEN t END) OVER w AS first_, min(t) OVER w AS a_, max(t) OVER w AS last_t FROM panel WINDOW w AS (PARTITION BY entity)),
    o2 AS (SELECT *, CASE WHEN first_ IS NULL THEN 'negative' WHEN first_ = a_ THEN 'left_censored' ELSE 'exact' END AS status,
      CASE WHEN first_ > a_ THEN first_ + 6 END AS onset FROM o),
    o3 AS (SELECT *, onset - t AS hours_to_onset, CASE WHEN status = 'exact' THEN CAST(onset - t > 0 AS INTEGER) WHEN status = 'negative' THEN CAST(t <= last_t - 6 AS INTEGER) ELSE 0 END AS eligible FROM o2),
    targeted AS (SELECT *, CAST(CASE WHEN eligible = 1 THEN CASE WHEN status = 'exact' AND hours_to_onset BETWEEN 1 AND 6 THEN 1 ELSE 0 END END AS INTEGER) AS target FROM o3)"""
_last = lambda s: f"CASE WHEN t - last_value(CASE WHEN {s} IS NOT NULL THEN t END IGNORE NULLS) OVER w <= 24 THEN last_value({s} IGNORE NULLS) OVER w END"
SCORED = TARGET + f""", scored AS (SELECT *, round(1 / (1 + exp(-(coalesce({_last('click')}, 0e0) - 40e0) / 40e0)), 6) AS p0,
      round(1 / (1 + exp(-(coalesce({_last('error')}, 0e0) - 60e0) / 30e0)), 6) AS p1
      FROM targeted WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
LABELLED = SCORED + """, d AS (SELECT entity, source, t, CAST(target AS DOUBLE) AS y, p0 AS p, p0, p1, 1e0 / count(*) OVER (PARTITION BY entity) AS w FROM scored WHERE eligible = 1)"""

# --- the panel and its checks -------------------------------------------------------------


@query(PANEL + " SELECT * FROM panel")
def panel_hourly(spark, sf_dir):
    return panel(spark, sf_dir)


@query(DENSE + " SELECT * FROM dense")
def panel_dense(spark, sf_dir):
    return dense(spark, sf_dir)


@query(PANEL + """, per AS (SELECT entity, source, max(label) AS m, count(*) AS n, max(CASE WHEN label = 1 AND t = a THEN 1 ELSE 0 END) AS c
      FROM (SELECT *, min(t) OVER (PARTITION BY entity) AS a FROM panel) GROUP BY entity, source)
    SELECT coalesce(source, 'all') AS source, count(*) AS entities, CAST(sum(n) AS BIGINT) AS panel_rows, CAST(sum(m) AS BIGINT) AS positive,
      count(*) - CAST(sum(m) AS BIGINT) AS negative, CAST(sum(c) AS BIGINT) AS left_censored FROM per GROUP BY GROUPING SETS ((source), ())""")
def cohort_flow(spark, sf_dir):
    per = target.onsets(panel(spark, sf_dir))
    rows = panel(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"))
    j = per.join(rows, "entity").withColumn("pos", F.when(F.col("status") == target.NEGATIVE, 0).otherwise(1))
    return j.rollup("source").agg(
        F.count("*").alias("entities"), F.sum("n").alias("panel_rows"), F.sum("pos").alias("positive"), (F.count("*") - F.sum("pos")).alias("negative"),
        F.sum(F.when(F.col("status") == target.CENSORED, 1).otherwise(0)).alias("left_censored"),
    ).withColumn("source", F.coalesce("source", F.lit("all")))


def hourly_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), "event_id", "event_type", "value", hours_since(F.col("ts")).alias("t"))


@query(PANEL + " SELECT entity, t, count(*) AS n FROM e GROUP BY entity, t HAVING count(*) > 1")
def panel_duplicates(spark, sf_dir):
    return validate.duplicates(hourly_events(spark, sf_dir), ["entity", "t"])


@query(PANEL + " SELECT * FROM (SELECT entity, event_id, t, lag(t) OVER (PARTITION BY entity ORDER BY event_id) AS previous FROM e) WHERE t <= previous")
def chronology_violations(spark, sf_dir):
    return validate.out_of_order(hourly_events(spark, sf_dir), "event_id").select("entity", "event_id", "t", "previous")


@query(PANEL + " SELECT * FROM (SELECT entity, t, trigger_ AS label, lag(trigger_) OVER (PARTITION BY entity ORDER BY t) AS previous FROM p0_) WHERE previous > label")
def label_persistence_violations(spark, sf_dir):
    e = hourly_events(spark, sf_dir)
    raw = e.groupBy("entity", "t").agg(F.max(F.when((F.col("event_type") == "error") & (F.col("value") >= 130), 1).otherwise(0)).alias("label"))
    return validate.label_drops(raw).select("entity", "t", "label", "previous")


@query(PANEL + " SELECT entity, count(DISTINCT event_type) AS values FROM e GROUP BY entity HAVING count(DISTINCT event_type) > 1".replace(" AS values", ' AS "values"'))
def static_constancy(spark, sf_dir):
    return validate.not_constant(hourly_events(spark, sf_dir), "event_type")


@query("""SELECT "column", value FROM (SELECT 'props' AS "column", props AS value FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events)
    WHERE value IS NOT NULL AND (try_cast(value AS DOUBLE) IS NULL OR isnan(try_cast(value AS DOUBLE)) OR isinf(try_cast(value AS DOUBLE)))""")
def numeric_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("props", F.get_json_object("props", "$.k").alias("k"))
    return validate.not_numeric(e, ["props", "k"])


@query("SELECT event_id, value FROM events WHERE value IS NULL OR NOT (value BETWEEN 0 AND 1)")
def probability_violations(spark, sf_dir):
    return validate.not_probability(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def membership_violations(spark, sf_dir):
    return validate.not_in(table(spark, sf_dir, "events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query(PANEL + """, got AS (SELECT source, count(DISTINCT entity) AS got_entities, count(*) AS got_rows FROM panel GROUP BY source)
    SELECT source, x.entities, x."rows", got_entities, got_rows FROM (VALUES ('A', 75, 1), ('C', 1, 1)) x(source, entities, "rows") FULL JOIN got USING (source)
    WHERE NOT (x.entities IS NOT DISTINCT FROM got_entities AND x."rows" IS NOT DISTINCT FROM got_rows)""")
def cohort_identity(spark, sf_dir):
    expected = spark.createDataFrame([("A", 75, 1), ("C", 1, 1)], "source string, entities int, rows int")
    return validate.cohort_identity(panel(spark, sf_dir), expected)


# --- causal windows -----------------------------------------------------------------------

W_ = "(PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
B_ = "(PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
R_ = "(PARTITION BY entity ORDER BY t RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)"
SEEN = "last_value(CASE WHEN {x} IS NOT NULL THEN t END IGNORE NULLS) OVER {w}"
KEPT = "last_value({x} IGNORE NULLS) OVER {w}"


@query(PANEL + " SELECT entity, t, " + ", ".join(f"CAST({s} IS NULL AS INTEGER) AS {s}_is_missing" for s in SIGNALS) + " FROM panel")
def missing_flags(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "t", *[F.col(s).isNull().cast("int").alias(f"{s}_is_missing") for s in SIGNALS])


@query(PANEL + " SELECT entity, t, " + " + ".join(f"CAST({s} IS NOT NULL AS INTEGER)" for s in SIGNALS) + " AS n FROM panel")
def measurement_count(spark, sf_dir):
    total = sum((F.col(s).isNotNull().cast("int") for s in SIGNALS[1:]), F.col(SIGNALS[0]).isNotNull().cast("int"))
    return panel(spark, sf_dir).select("entity", "t", total.alias("n"))


@query(PANEL + " SELECT entity, t, " + ", ".join(f"t - {SEEN.format(x=s, w=W_)} AS {s}_age" for s in SIGNALS) + " FROM panel")
def obs_age(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "t", *[windows.observation_age(s).alias(f"{s}_age") for s in SIGNALS])


@query(PANEL + " SELECT entity, t, " + ", ".join(f"CASE WHEN t - {SEEN.format(x=s, w=W_)} <= 24 THEN {KEPT.format(x=s, w=W_)} END AS {s}_last" for s in SIGNALS) + " FROM panel")
def last_obs_24h(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "t", *[windows.last_observation(s).alias(f"{s}_last") for s in SIGNALS])


@query(DENSE + " SELECT entity, t, " + ", ".join(f"CASE WHEN t - {SEEN.format(x=s, w=W_)} <= 24 THEN {KEPT.format(x=s, w=W_)} END AS {s}_last" for s in ("click", "view")) + " FROM dense")
def last_obs_24h_dense(spark, sf_dir):
    return dense(spark, sf_dir).select("entity", "t", *[windows.last_observation(s).alias(f"{s}_last") for s in ("click", "view")])


@query(PANEL + " SELECT entity, t, " + ", ".join(
    f"CASE WHEN t - {SEEN.format(x=s, w=B_)} <= 24 THEN {KEPT.format(x=s, w=B_)} END AS {s}_value, CASE WHEN t - {SEEN.format(x=s, w=B_)} > 24 THEN 24 ELSE t - {SEEN.format(x=s, w=B_)} END AS {s}_age" for s in SIGNALS) + " FROM panel")
def prev_state(spark, sf_dir):
    cols = []
    for s in SIGNALS:
        value, age = windows.previous_state(s)
        cols += [value.alias(f"{s}_value"), age.alias(f"{s}_age")]
    return panel(spark, sf_dir).select("entity", "t", *cols)


@query(PANEL + " SELECT entity, t, lag(t) OVER (PARTITION BY entity ORDER BY t) IS NOT NULL AS previous_exists FROM panel")
def previous_exists(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "t", windows.previous_exists().alias("previous_exists"))


def _rolling_sql(stat: str) -> str:
    return DENSE + f" SELECT entity, t, CASE WHEN count(view) OVER r >= 2 THEN round({stat}, 6) END AS x FROM dense WINDOW r AS {R_}"


def _rolling(what: str) -> Query:
    return lambda spark, sf_dir: dense(spark, sf_dir).select("entity", "t", F.round(windows.rolling("view", 8, what), 6).alias("x"))


for _name, _what, _stat in (
    ("rolling_mean_8h", "mean", "avg(view) OVER r"), ("rolling_std_8h", "std", "stddev_samp(view) OVER r"), ("rolling_max_8h", "max", "max(view) OVER r"),
    ("rolling_iqr_8h", "iqr", "quantile_cont(view, 0.75) OVER r - quantile_cont(view, 0.25) OVER r"),
):
    QUERIES[_name], SQL[_name] = _rolling(_what), _rolling_sql(_stat)


@query(DENSE + f" SELECT entity, t, CASE WHEN count(view) OVER r >= 2 THEN round(stddev_samp(view) OVER r / nullif(abs(avg(view) OVER r), 0), 6) END AS cv FROM dense WINDOW r AS {R_}")
def cv_8h(spark, sf_dir):
    return dense(spark, sf_dir).select("entity", "t", F.round(windows.coefficient_of_variation("view", 8), 6).alias("cv"))


_MICRO = "CAST(round(({x} - {k}) * 1000000e0) AS BIGINT)"


@query(PANEL + ", ch AS (SELECT entity, t, " + ", ".join(
    f"{_MICRO.format(x=s, k=KEPT.format(x=s, w=B_))} AS {s}_d, t - {SEEN.format(x=s, w=B_)} AS {s}_h" for s in ("click", "view", "error")) + " FROM panel) SELECT entity, t, "
    + ", ".join(f"{s}_d / 1000000e0 AS {s}_delta, sign({s}_d) * ((2 * abs({s}_d) + {s}_h) // (2 * {s}_h)) / 1000000e0 AS {s}_slope" for s in ("click", "view", "error")) + " FROM ch")
def deltas_slopes(spark, sf_dir):
    """Differences and slopes in whole millionths: no tie at the last digit is left to an engine's rounding."""
    cols = []
    for s in ("click", "view", "error"):
        change, hours = windows.change_and_hours(s)
        d = scalars.millionths(change)
        cols += [(d / 1_000_000).alias(f"{s}_delta"), (scalars.whole_ratio(d, hours) / 1_000_000).alias(f"{s}_slope")]
    return panel(spark, sf_dir).select("entity", "t", *cols)


# --- target -------------------------------------------------------------------------------


@query(TARGET + " SELECT DISTINCT entity, source, status, onset, last_t FROM o2")
def onset_status(spark, sf_dir):
    return target.onsets(panel(spark, sf_dir))


@query(TARGET + " SELECT entity, source, t, label, status, onset, last_t, hours_to_onset, eligible, target FROM targeted")
def primary_target(spark, sf_dir):
    return targeted(spark, sf_dir).select("entity", "source", "t", "label", "status", "onset", "last_t", "hours_to_onset", "eligible", "target")


@query(TARGET + " SELECT entity, t, target FROM targeted WHERE eligible = 1")
def decision_rows(spark, sf_dir):
    return target.decisions(targeted(spark, sf_dir)).select("entity", "t", "target")


@query(TARGET + " SELECT status, count(*) AS n, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(target) AS BIGINT) AS positive FROM targeted GROUP BY status")
def target_consistency(spark, sf_dir):
    t = targeted(spark, sf_dir)
    validate.enforce(target.target_violations(t).select("entity", "t"), "target and eligibility contradict each other")
    return t.groupBy("status").agg(F.count("*").alias("n"), F.sum("eligible").alias("eligible"), F.sum("target").alias("positive"))


# --- alarms -------------------------------------------------------------------------------

EDGES = SCORED + ", edges AS (SELECT * FROM (SELECT *, p0 >= 0.6 AND NOT coalesce(lag(p0 >= 0.6) OVER (PARTITION BY entity ORDER BY t), false) AS edge FROM scored) WHERE edge)"
_ACCEPT = """list_reduce(list_transform(list(t ORDER BY t), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 6 THEN list_concat(a, x) ELSE a END)"""
EPISODES = EDGES + f", ep AS (SELECT entity, {_ACCEPT} AS times FROM edges GROUP BY entity)"
ALARMS = EPISODES + """, per AS (SELECT entity, source, min(status) AS status, min(onset) AS onset, CAST(sum(eligible) AS BIGINT) AS eligible_hours, max(CASE WHEN eligible = 1 THEN t END) AS z FROM scored GROUP BY entity, source),
    cls AS (SELECT per.*, coalesce(times, []) AS ts FROM per LEFT JOIN ep USING (entity)),
    cnt AS (SELECT entity, source, status, onset, eligible_hours, CAST(eligible_hours > 0 AS INTEGER) AS monitored, CAST(status = 'exact' AS INTEGER) AS onset_known, round(eligible_hours / 24e0, 6) AS days, CAST(len(ts) AS INTEGER) AS n_episodes,
      CAST(CASE WHEN status = 'exact' THEN len(list_filter(ts, lambda x: x >= onset - 6 AND x <= onset - 1)) ELSE 0 END AS INTEGER) AS n_useful,
      CAST(CASE WHEN status = 'exact' THEN len(list_filter(ts, lambda x: x < onset - 6)) WHEN status = 'left_censored' THEN 0 ELSE len(list_filter(ts, lambda x: coalesce(x <= z, false))) END AS INTEGER) AS n_false,
      CAST(CASE WHEN status = 'exact' THEN len(list_filter(ts, lambda x: x > onset - 1 AND x < onset)) ELSE 0 END AS INTEGER) AS n_late,
      CAST(CASE WHEN status = 'exact' THEN len(list_filter(ts, lambda x: x >= onset)) ELSE 0 END AS INTEGER) AS n_after,
      CAST(CASE WHEN status = 'left_censored' THEN len(ts) ELSE 0 END AS INTEGER) AS n_censored,
      CAST(CASE WHEN status = 'negative' THEN len(list_filter(ts, lambda x: NOT coalesce(x <= z, false))) ELSE 0 END AS INTEGER) AS n_right_censored,
      CAST(greatest(len(ts) - 1, 0) AS INTEGER) AS n_repeated, list_min(ts) AS first_alert,
      CASE WHEN status = 'exact' THEN list_min(list_filter(ts, lambda x: x >= onset - 6 AND x <= onset - 1)) END AS first_useful,
      array_to_string(ts, ';') AS times_text, CASE WHEN status = 'exact' THEN array_to_string(list_filter(ts, lambda x: x >= onset - 6 AND x <= onset - 1), ';') ELSE '' END AS useful_text FROM cls),
    rows_ AS (SELECT *, onset - first_useful AS lead, CAST(n_useful > 0 AS INTEGER) AS detected, CAST(status = 'exact' AND n_useful = 0 AS INTEGER) AS missed FROM cnt)"""
_SUMMARY = """count(*) AS entities, CAST(sum(monitored) AS BIGINT) AS monitored, CAST(sum(n_episodes) AS BIGINT) AS episodes,
      CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(missed) AS BIGINT) AS missed,
      CAST(sum(n_false) AS BIGINT) AS false_episodes, CAST(sum(n_repeated) AS BIGINT) AS repeated_episodes, CAST(sum(n_late) AS BIGINT) AS late_episodes, CAST(sum(n_after) AS BIGINT) AS after_episodes,
      CAST(sum(n_censored) AS BIGINT) AS censored_episodes, CAST(sum(n_right_censored) AS BIGINT) AS right_censored_episodes,
      round(sum(eligible_hours) / 24e0, 6) AS days, round(sum(n_false) / nullif(sum(eligible_hours) / 24e0, 0), 6) AS false_per_day,
      round(quantile_cont(CAST(lead AS DOUBLE), CAST(0.5 AS DOUBLE)), 6) AS median_lead"""


def alarm_input(spark, sf_dir):
    return scored(targeted(spark, sf_dir))


@query(EDGES + " SELECT entity, t, p0 FROM edges")
def rising_edges(spark, sf_dir):
    return alarms.edges(alarm_input(spark, sf_dir), F.col("p0") >= 0.6).select("entity", "t", "p0")


@query(EPISODES + " SELECT entity, array_to_string(times, ';') AS times FROM ep")
def alarm_episodes(spark, sf_dir):
    e = alarms.episodes(alarms.edges(alarm_input(spark, sf_dir), F.col("p0") >= 0.6), ["entity"])
    return e.select("entity", F.array_join(F.transform("times", lambda x: x.cast("string")), ";").alias("times"))


@query(ALARMS + " SELECT * FROM rows_")
def alarm_event_rows(spark, sf_dir):
    return alarms.alarm_rows(alarm_input(spark, sf_dir), F.col("p0") >= 0.6)


@query(ALARMS + f", s AS (SELECT {_SUMMARY} FROM rows_) SELECT *, round(detected * 1e0 / nullif(detected + missed, 0), 6) AS sensitivity FROM s")
def alarm_metrics(spark, sf_dir):
    return alarms.alarm_summary(alarms.alarm_rows(alarm_input(spark, sf_dir), F.col("p0") >= 0.6))


@query(ALARMS + f", s AS (SELECT source, {_SUMMARY} FROM rows_ GROUP BY source) SELECT *, round(detected * 1e0 / nullif(detected + missed, 0), 6) AS sensitivity FROM s")
def alarm_metrics_by_source(spark, sf_dir):
    return alarms.alarm_summary(alarms.alarm_rows(alarm_input(spark, sf_dir), F.col("p0") >= 0.6), ["source"])


SWEEP = SCORED + f""", el AS (SELECT * FROM scored WHERE eligible = 1), grid AS (SELECT unnest(range(1, 101)) AS k),
    el2 AS (SELECT *, floor(round(p0 * 100, 9)) AS top, coalesce(lag(floor(round(p0 * 100, 9))) OVER (PARTITION BY entity ORDER BY t), -1) AS before_ FROM el),
    ed AS (SELECT entity, k, {_ACCEPT} AS times FROM el2, grid WHERE k <= top AND k > before_ GROUP BY entity, k),
    per AS (SELECT entity, min(status) AS status, min(onset) AS onset, count(*) AS n FROM el GROUP BY entity),
    tot AS (SELECT sum(n) / 24e0 AS days, sum(CASE WHEN status = 'exact' THEN 1 ELSE 0 END) AS at_stake FROM per),
    c AS (SELECT k, sum(CASE WHEN status = 'exact' AND len(list_filter(times, lambda x: x >= onset - 6 AND x <= onset - 1)) > 0 THEN 1 ELSE 0 END) AS detected,
      sum(CASE WHEN status = 'exact' THEN len(list_filter(times, lambda x: x < onset - 6)) ELSE len(times) END) AS fe FROM ed JOIN per USING (entity) GROUP BY k),
    sweep AS (SELECT CAST(grid.k AS INTEGER) AS threshold_pct, CAST(coalesce(detected, 0) AS BIGINT) AS detected, CAST(coalesce(fe, 0) AS BIGINT) AS false_episodes,
      round(coalesce(detected, 0) * 1e0 / nullif(at_stake, 0), 6) AS sensitivity, round(coalesce(fe, 0) / nullif(days, 0), 6) AS false_per_day FROM grid LEFT JOIN c ON grid.k = c.k, tot)"""


def _sweep(spark, sf_dir):
    return alarms.threshold_sweep(target.decisions(alarm_input(spark, sf_dir)), "p0")


@query(SWEEP + " SELECT * FROM sweep")
def alarm_threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(SWEEP + " SELECT * FROM sweep WHERE false_per_day <= 0.25 ORDER BY sensitivity DESC, false_per_day, threshold_pct LIMIT 1")
def alarm_threshold_select(spark, sf_dir):
    return alarms.choose_threshold(_sweep(spark, sf_dir), AlarmPolicy())


# --- metrics ------------------------------------------------------------------------------

TIED = """, tied AS (SELECT {by} p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM d GROUP BY {by} p),
    run AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg FROM tied
      WINDOW o AS ({part} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({part}))"""
RANKED = TIED + """, pr AS (SELECT *, tp / nullif(tp + fp, 0) AS precision_, tp / nullif(all_pos, 0) AS recall_ FROM run),
    tr AS (SELECT *, coalesce(lag(precision_) OVER ({part} ORDER BY p DESC), 1) AS pp, coalesce(lag(recall_) OVER ({part} ORDER BY p DESC), 0) AS rr FROM pr),
    rk AS (SELECT {by} round(sum(pos * precision_) / nullif(max(all_pos), 0), 6) AS ap, round(sum(neg * (tp - pos / 2)) / nullif(max(all_pos) * max(all_neg), 0), 6) AS auroc,
      round(sum((recall_ - rr) * (precision_ + pp) / 2), 6) AS pr_area FROM tr {group})"""
ALL_RANKED = RANKED.format(by="", part="", group="")
BY_SOURCE = RANKED.format(by="source,", part="PARTITION BY source", group="GROUP BY source")


@query(LABELLED + " SELECT entity, t, round(w, 9) AS w FROM d")
def weights_equal_entity(spark, sf_dir):
    return labelled(spark, sf_dir).select("entity", "t", F.round("w", 9).alias("w"))


@query(LABELLED + " SELECT entity, t, round(w / (2 * sum(w) OVER (PARTITION BY y)), 9) AS w FROM d")
def weights_class_balanced(spark, sf_dir):
    return scalars.class_balanced(labelled(spark, sf_dir), "w", "y").select("entity", "t", F.round("w", 9).alias("w"))


@query(LABELLED + ALL_RANKED + " SELECT ap FROM rk")
def weighted_ap(spark, sf_dir):
    return metrics.ranking(labelled(spark, sf_dir)).select("ap")


@query(LABELLED + ALL_RANKED + " SELECT auroc FROM rk")
def weighted_auroc(spark, sf_dir):
    return metrics.ranking(labelled(spark, sf_dir)).select("auroc")


@query(LABELLED + ALL_RANKED + " SELECT pr_area FROM rk")
def pr_auc_trapezoid(spark, sf_dir):
    return metrics.ranking(labelled(spark, sf_dir)).select("pr_area")


@query(LABELLED + " SELECT round(sum(w * (y - p) * (y - p)) / sum(w), 6) AS brier FROM d")
def weighted_brier(spark, sf_dir):
    return metrics.brier(labelled(spark, sf_dir))


@query(LABELLED + ALL_RANKED + " SELECT rk.*, (SELECT round(sum(w * (y - p) * (y - p)) / sum(w), 6) FROM d) AS brier FROM rk")
def primary_performance(spark, sf_dir):
    return metrics.performance(labelled(spark, sf_dir))


@query(LABELLED + BY_SOURCE + " SELECT rk.*, brier FROM rk JOIN (SELECT source, round(sum(w * (y - p) * (y - p)) / sum(w), 6) AS brier FROM d GROUP BY source) USING (source)")
def sourcewise_metrics(spark, sf_dir):
    return metrics.performance(labelled(spark, sf_dir), ["source"])


@query(LABELLED + TIED.format(by="", part="") + " SELECT p AS threshold, round(tp / nullif(all_pos, 0), 6) AS tpr, round(fp / nullif(all_neg, 0), 6) AS fpr FROM run")
def roc_points(spark, sf_dir):
    return metrics.roc_points(labelled(spark, sf_dir))


@query(LABELLED + """, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, sum(w) AS ws, sum(w * (p - y)) AS gap FROM d GROUP BY 1)
    SELECT round(sum(abs(gap)) / sum(ws), 6) AS ece FROM b""")
def ece_10(spark, sf_dir):
    return metrics.ece(labelled(spark, sf_dir))


@query(LABELLED + """, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, sum(w) AS ws, sum(w * p) AS wp, sum(w * y) AS wy FROM d GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(ws, 0), 6) AS weight, round(wp / nullif(ws, 0), 6) AS mean_p, round(wy / nullif(ws, 0), 6) AS mean_y
    FROM (SELECT unnest(range(0, 10)) AS bin) g LEFT JOIN b ON g.bin = b.bin""")
def reliability_rows(spark, sf_dir):
    return metrics.reliability(labelled(spark, sf_dir))


# --- decision curves, utility, bootstrap ---------------------------------------------------

CURVE = list(ModelPolicy().curve)
_BENEFIT = ", ".join(f"sum(w * CASE WHEN {s} >= k / 100e0 THEN 1 ELSE 0 END * (y - (1 - y) * k / (100e0 - k))) AS b_{s}" for s in ("p0", "p1"))
BENEFIT = LABELLED + f", grid AS (SELECT unnest({CURVE}) AS k), be AS (SELECT entity, CAST(k AS INTEGER) AS pct, sum(w) AS w, sum(w * y) AS wy, {_BENEFIT} FROM d, grid GROUP BY entity, k)"


@query(BENEFIT + """ SELECT pct, round(sum(b_p0) / sum(w), 6) AS net_p0, round((sum(wy) - (sum(w) - sum(wy)) * pct / (100e0 - pct)) / sum(w), 6) AS treat_all, 0e0 AS treat_none FROM be GROUP BY pct""")
def decision_curve(spark, sf_dir):
    return decision.decision_curve(labelled(spark, sf_dir), tuple(CURVE), ["p0"])


@query(BENEFIT + " SELECT pct, round(sum(b_p0) / sum(w), 6) AS net_p0, round(sum(b_p1) / sum(w), 6) AS net_p1, round((sum(b_p1) - sum(b_p0)) / sum(w), 6) AS difference FROM be GROUP BY pct")
def decision_curve_paired(spark, sf_dir):
    b = decision.per_entity_benefit(labelled(spark, sf_dir), tuple(CURVE), ["p0", "p1"])
    s = lambda c: F.sum(c)
    return b.groupBy("pct").agg(F.round(s("b_p0") / s("w"), 6).alias("net_p0"), F.round(s("b_p1") / s("w"), 6).alias("net_p1"), F.round((s("b_p1") - s("b_p0")) / s("w"), 6).alias("difference"))


REPS, SEED = ModelPolicy().bootstrap, 11
_UNIT = f"(CAST(('0x' || substr(md5('{SEED}|' || rep || '|' || entity), 1, 15)) AS BIGINT) / 1152921504606846976e0)"


def _copies_sql() -> str:
    import math

    total, parts = 0.0, []
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        parts.append(f"CASE WHEN {_UNIT} >= {total!r} THEN 1 ELSE 0 END")
    return " + ".join(parts)


BOOT = BENEFIT + f""", reps AS (SELECT unnest(range(1, {REPS + 1})) AS rep), bx AS (SELECT be.*, rep, {_copies_sql()} AS copies FROM be, reps),
    br AS (SELECT pct, rep, sum(copies * w) AS w, sum(copies * b_p0) AS b0, sum(copies * b_p1) AS b1 FROM bx GROUP BY pct, rep)"""
_Q = lambda x, n: f"round(quantile_cont({x}, CAST(0.025 AS DOUBLE)), 6) AS {n}_low, round(quantile_cont({x}, CAST(0.975 AS DOUBLE)), 6) AS {n}_high"


@query(BOOT + f" SELECT pct, count(*) AS reps, {_Q('b0 / w', 'net_p0')}, {_Q('b1 / w', 'net_p1')}, {_Q('(b1 - b0) / w', 'difference')} FROM br GROUP BY pct")
def bootstrap_dca_ci(spark, sf_dir):
    return decision.bootstrap_curve(labelled(spark, sf_dir), tuple(CURVE), ["p0", "p1"], REPS, SEED)


@query(LABELLED + f""", long AS (SELECT entity, y, w, 'p0' AS score, p0 AS p FROM d UNION ALL SELECT entity, y, w, 'p1', p1 FROM d),
    fo AS (SELECT entity, score, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM long GROUP BY ALL), reps AS (SELECT unnest(range(1, {REPS + 1})) AS rep),
    rp AS (SELECT fo.*, rep, {_copies_sql()} AS copies FROM fo, reps),
    ti AS (SELECT rep, score, p, sum(copies * pos) AS pos, sum(copies * neg) AS neg FROM rp WHERE copies > 0 GROUP BY ALL),
    ru AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM ti WINDOW o AS (PARTITION BY rep, score ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (SELECT rep, score, sum(pos * (tp / nullif(tp + fp, 0))) / nullif(sum(pos), 0) AS ap, sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg) AS brier FROM ru GROUP BY rep, score),
    wd AS (SELECT rep, max(CASE WHEN score = 'p0' THEN ap END) AS a0, max(CASE WHEN score = 'p1' THEN ap END) AS a1, max(CASE WHEN score = 'p0' THEN brier END) AS b0, max(CASE WHEN score = 'p1' THEN brier END) AS b1 FROM m GROUP BY rep)
    SELECT count(*) AS reps, {_Q('a0', 'ap_p0')}, {_Q('b0', 'brier_p0')}, {_Q('a1', 'ap_p1')}, {_Q('b1', 'brier_p1')}, {_Q('a1 - a0', 'ap_difference')}, {_Q('b1 - b0', 'brier_difference')} FROM wd""")
def bootstrap_ap_brier_ci(spark, sf_dir):
    return decision.bootstrap_scores(labelled(spark, sf_dir), ["p0", "p1"], REPS, SEED)


def _utility_sql(alarm: str) -> str:
    rise = "CASE WHEN d <= -6 THEN greatest(d / 6e0 + 2, -0.05) ELSE -d / 9e0 + 3 / 9e0 END"
    fall = "CASE WHEN d <= -6 THEN 0 ELSE -2 / 9e0 * d - 12 / 9e0 END"
    return f"round(sum(CASE WHEN first_ IS NULL THEN CASE WHEN {alarm} THEN -0.05 ELSE 0 END WHEN d <= 3 THEN CASE WHEN {alarm} THEN {rise} ELSE {fall} END ELSE 0 END), 6)"


UTILITY = SCORED + f""", i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS i FROM (SELECT * EXCLUDE (first_) FROM scored)),
    f AS (SELECT *, min(CASE WHEN label = 1 THEN i END) OVER (PARTITION BY entity) AS first_ FROM i), g AS (SELECT *, i - (first_ + 6) AS d FROM f),
    u AS (SELECT entity, source, CAST({_utility_sql('p0 >= 0.6')} AS DOUBLE) AS observed, CAST({_utility_sql('d BETWEEN -12 AND 3')} AS DOUBLE) AS best, CAST({_utility_sql('false')} AS DOUBLE) AS inaction FROM g GROUP BY entity, source)"""


@query(UTILITY + " SELECT * FROM u")
def utility_by_entity(spark, sf_dir):
    return decision.utility_by_entity(scored(panel(spark, sf_dir)), "p0", 0.6, 6, UtilityPolicy())


@query(UTILITY + " SELECT round((sum(observed) - sum(inaction)) / nullif(sum(best) - sum(inaction), 0), 6) AS utility FROM u")
def utility_normalized(spark, sf_dir):
    return decision.normalised_utility(decision.utility_by_entity(scored(panel(spark, sf_dir)), "p0", 0.6))


# --- selection ----------------------------------------------------------------------------

LONG = PANEL + ", long AS (" + " UNION ALL ".join(f"SELECT entity, t, '{s}' AS signal, {s} AS value FROM panel" for s in SIGNALS) + ")"
_SUPPORT = """, pe AS (SELECT signal, entity, count(*) AS n, count(value) AS seen FROM long GROUP BY signal, entity),
    support AS (SELECT signal, round(sum(seen) / sum(n), 6) AS coverage, CAST(sum(CASE WHEN seen >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS entities FROM pe GROUP BY signal)"""


@query(LONG + _SUPPORT + " SELECT * FROM support")
def signal_support(spark, sf_dir):
    return selection.signal_support(panel(spark, sf_dir), SIGNALS)


@query(LONG + _SUPPORT + " SELECT * FROM support ORDER BY coverage DESC, signal LIMIT 3")
def signal_topk(spark, sf_dir):
    return selection.top_signals(selection.signal_support(panel(spark, sf_dir), SIGNALS), 3)


@query(LONG + """ SELECT signal, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS median,
    round(coalesce(nullif(quantile_cont(value, CAST(0.75 AS DOUBLE)) - quantile_cont(value, CAST(0.25 AS DOUBLE)), 0), 1), 6) AS scale FROM long GROUP BY signal""")
def location_scale(spark, sf_dir):
    return selection.location_scale(panel(spark, sf_dir), SIGNALS)


_FOLDS = """, en AS (SELECT entity, source, max(label) AS label FROM panel GROUP BY entity, source),
    folds AS (SELECT entity, source, label, CAST((row_number() OVER (PARTITION BY label ORDER BY CAST(('0x' || substr(md5('7|' || entity), 1, 15)) AS BIGINT), entity) - 1) % 5 AS INTEGER) AS fold FROM en)"""


def folds(spark, sf_dir):
    return selection.stratified_folds(panel(spark, sf_dir).groupBy("entity", "source").agg(F.max("label").alias("label")), 5, 7)


@query(PANEL + _FOLDS + " SELECT * FROM folds")
def fold_assign(spark, sf_dir):
    return folds(spark, sf_dir)


@query(PANEL + _FOLDS + " SELECT fold, folds.label, count(*) AS n, count(DISTINCT entity) AS entities FROM panel JOIN folds USING (entity) GROUP BY fold, folds.label")
def fold_join(spark, sf_dir):
    f = folds(spark, sf_dir).select("entity", "fold", F.col("label").alias("entity_label"))
    j = panel(spark, sf_dir).join(f, "entity", "left")
    return j.groupBy("fold", F.col("entity_label").alias("label")).agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


@query(PANEL + _FOLDS + """, n AS (SELECT least(min(c), 10) AS n FROM (SELECT count(*) AS c FROM en GROUP BY source, label))
    SELECT entity, source, label, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, label ORDER BY entity) AS INTEGER) AS rank FROM en), n WHERE rank <= n""")
def stratum_topn(spark, sf_dir):
    en = panel(spark, sf_dir).groupBy("entity", "source").agg(F.max("label").alias("label"))
    return selection.top_of_strata(en, ["source", "label"], 10)


@query("""WITH p AS (SELECT o_orderpriority AS name, count(*) AS cost, round(avg(o_totalprice), 2) AS elapsed FROM orders GROUP BY 1)
    SELECT * FROM p WHERE elapsed <= 1.05 * (SELECT min(elapsed) FROM p) ORDER BY cost, elapsed, name LIMIT 1""")
def profile_select(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("cost"), F.round(F.avg("o_totalprice"), 2).alias("elapsed"))
    return selection.smallest_fast_enough(p)
