"""Checks that fail closed, rolling and lifted features, hashes and summaries, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import alarms, decision, metrics, reports, selection, target, validate, windows
from tidewell.operators import features as feats
from tidewell.plans import panel_queries as pq
from tidewell.plans.model_queries import LONGSCORES, _BY, long_scores
from tidewell.plans.panel_queries import DENSE, LABELLED, PANEL, SCORED, TARGET, dense, labelled, panel, table, targeted

QUERIES: dict[str, pq.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: pq.Query) -> pq.Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- features -----------------------------------------------------------------------------

_BIN = "least(floor((v - lo) / (hi - lo) * 10), 9)"


@query(DENSE + f""", fr AS (SELECT entity, t, list(view) FILTER (WHERE view IS NOT NULL) OVER r AS vs, min(view) OVER r AS lo, max(view) OVER r AS hi, count(view) OVER r AS n FROM dense WINDOW r AS {pq.R_}),
    va AS (SELECT entity, t, n, lo, hi, unnest(vs) AS v FROM fr WHERE n >= 2),
    bi AS (SELECT entity, t, n, count(*) * 1e0 / n AS share FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE {_BIN.replace('(hi - lo)', 'nullif(hi - lo, 0)')} END AS bin FROM va) GROUP BY entity, t, n, bin),
    en AS (SELECT entity, t, round(abs(sum(share * ln(share))), 6) AS x FROM bi GROUP BY entity, t)
    SELECT entity, t, x FROM fr LEFT JOIN en USING (entity, t)""")
def rolling_entropy_8h(spark, sf_dir):
    return dense(spark, sf_dir).select("entity", "t", F.round(F.abs(windows.rolling("view", 8, "entropy")), 6).alias("x"))


_THREE = ("click", "view", "error")


def _feature_sql(s: str) -> str:
    seen, kept = pq.SEEN.format(x=s, w=pq.W_), pq.KEPT.format(x=s, w=pq.W_)
    return (
        f"{s} AS raw__{s}, CAST({s} IS NULL AS INTEGER) AS {s}_is_missing, t - {seen} AS {s}_age, CASE WHEN t - {seen} <= 24 THEN {kept} END AS {s}_last, "
        f"CASE WHEN count({s}) OVER r >= 2 THEN round(stddev_samp({s}) OVER r / nullif(abs(avg({s}) OVER r), 0), 6) END AS {s}_cv_8h"
    )


@query(TARGET + " SELECT entity, t, target, " + " + ".join(f"CAST({s} IS NOT NULL AS INTEGER)" for s in _THREE) + " AS measurement_count, " + ", ".join(map(_feature_sql, _THREE)) + f" FROM targeted WINDOW r AS {pq.R_}")
def feature_frame(spark, sf_dir):
    out = feats.features(targeted(spark, sf_dir), list(_THREE))
    each = [F.round(f"{s}_{c}", 6).alias(f"{s}_{c}") if c == "cv_8h" else F.col(f"{s}_{c}") for s in _THREE for c in ("is_missing", "age", "last", "cv_8h")]
    return out.select("entity", "t", "target", "measurement_count", *[f"raw__{s}" for s in _THREE], *each)


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_linenumber AS DOUBLE) AS x2, CAST(l_quantity * l_quantity AS DOUBLE) AS x3,
    CAST(l_quantity * l_linenumber AS DOUBLE) AS x4, CAST(l_linenumber * l_linenumber AS DOUBLE) AS x5 FROM lineitem""")
def quadratic_lift(spark, sf_dir):
    x = scalars.lifted(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", *[F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in range(5)])


# --- hashes and JSON ----------------------------------------------------------------------


@query("SELECT s_nationkey, count(*) AS n, sha256(string_agg(CAST(s_suppkey AS VARCHAR), chr(10) ORDER BY CAST(s_suppkey AS VARCHAR))) AS ids_sha256 FROM supplier GROUP BY s_nationkey")
def id_hashes(spark, sf_dir):
    """Hash of each group's sorted ids; for groups whose ids fit a task, as folds' and sources' do."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("id"))
    return s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).select("s_nationkey", "n", scalars.sorted_ids_hash(F.col("ids")).alias("ids_sha256"))


@query("SELECT CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey, 'rate', CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 2e0 END) AS VARCHAR) AS said FROM nation")
def canonical_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rate = F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") / 2).otherwise(F.lit(float("nan")))
    return n.select(scalars.canonical_json({"n_regionkey": F.col("n_regionkey"), "rate": rate, "n_name": F.col("n_name"), "n_nationkey": F.col("n_nationkey")}).alias("said"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(json_extract_string(props, '$.k')) AS size FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k IS NOT NULL")
    return e.withColumn("size", F.length("k").cast("long"))


# --- checks -------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey AS c_custkey FROM orders)")
def empty_entities(spark, sf_dir):
    return validate.without_rows(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


_RAW = PANEL + ", raw AS (SELECT entity, event_id, t, CASE WHEN event_type = 'error' AND value >= 130 THEN 1 ELSE 0 END AS label FROM e)"


@query(_RAW + """ SELECT entity, t, what FROM (SELECT entity, t, 'order' AS what, t <= lag(t) OVER (PARTITION BY entity ORDER BY event_id) AS bad FROM raw
    UNION ALL SELECT entity, t, 'label', label < lag(label) OVER (PARTITION BY entity ORDER BY t) FROM (SELECT entity, t, max(label) AS label FROM raw GROUP BY entity, t)) WHERE bad""")
def longitudinal_violations(spark, sf_dir):
    raw = pq.hourly_events(spark, sf_dir).withColumn("label", F.when((F.col("event_type") == "error") & (F.col("value") >= 130), 1).otherwise(0))
    hourly = raw.groupBy("entity", "t").agg(F.max("label").alias("label"))
    late = validate.longitudinal_violations(raw, by="event_id").filter("what = 'order'")
    return late.unionByName(validate.longitudinal_violations(hourly).filter("what = 'label'"))


_GIVEN = ", given AS (SELECT entity, CASE WHEN entity % 13 = 0 THEN 1 - label ELSE label END AS label, CASE WHEN entity % 11 = 0 THEN fold + 0.5 WHEN entity % 7 = 0 THEN 9 ELSE fold END AS fold FROM folds WHERE entity % 17 <> 0 UNION ALL SELECT entity, label, fold FROM folds WHERE entity % 19 = 0 UNION ALL SELECT -1, 0, 0)"


@query(PANEL + pq._FOLDS + _GIVEN + """, per AS (SELECT entity, count(*) AS n, min(label) AS label, max(CASE WHEN fold = floor(fold) AND fold BETWEEN 0 AND 4 THEN 0 ELSE 1 END) AS bad FROM given GROUP BY entity),
    x AS (SELECT entity, CASE WHEN n IS NULL THEN 'no fold' WHEN en.label IS NULL THEN 'unknown entity' WHEN n > 1 THEN 'several folds' WHEN bad = 1 THEN 'no such fold' WHEN en.label IS DISTINCT FROM per.label THEN 'other label' END AS what
      FROM en FULL JOIN per USING (entity)) SELECT * FROM x WHERE what IS NOT NULL""")
def fold_context(spark, sf_dir):
    f = pq.folds(spark, sf_dir)
    e, fold = F.col("entity"), F.col("fold").cast("double")
    given = f.filter(e % 17 != 0).select("entity", F.when(e % 13 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), F.when(e % 11 == 0, fold + 0.5).when(e % 7 == 0, 9.0).otherwise(fold).alias("fold"))
    given = given.union(f.filter(e % 19 == 0).select("entity", "label", fold)).union(spark.createDataFrame([(-1, 0, 0.0)], "entity long, label int, fold double"))
    return validate.fold_violations(panel(spark, sf_dir), given, 5)


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice * (1 + 1e-14) END AS o_totalprice, CASE WHEN o_orderkey % 70 = 0 THEN 'other' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 90 <> 0)
    SELECT a.o_orderkey FROM orders a LEFT JOIN b ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR abs(a.o_totalprice - b.o_totalprice) > 1e-12 * abs(b.o_totalprice)""")
def frame_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, k = o.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus"), F.col("o_orderkey")
    b = a.filter(k % 90 != 0).select("o_orderkey", F.when(k % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") * (1 + 1e-14)).alias("o_totalprice"), F.when(k % 70 == 0, "other").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return validate.frame_differences(a, b, ["o_orderkey"], 1e-12).select("o_orderkey")


@query(TARGET + """, given AS (SELECT DISTINCT entity, CASE WHEN entity % 10 = 0 THEN 'exact' ELSE status END AS status, CASE WHEN entity % 15 = 0 THEN coalesce(onset, 0) + 1 ELSE onset END AS onset FROM o2 WHERE entity % 25 <> 0),
    want AS (SELECT DISTINCT entity, status AS want_status, onset AS want_onset FROM o2)
    SELECT entity, status, onset, want_status, want_onset FROM given FULL JOIN want USING (entity) WHERE status IS DISTINCT FROM want_status OR onset IS DISTINCT FROM want_onset""")
def onset_provenance(spark, sf_dir):
    p, e = panel(spark, sf_dir), F.col("entity")
    given = target.onsets(p).filter(e % 25 != 0).select("entity", F.when(e % 10 == 0, "exact").otherwise(F.col("status")).alias("status"), F.when(e % 15 == 0, F.coalesce("onset", F.lit(0)) + 1).otherwise(F.col("onset")).alias("onset"))
    return target.onset_violations(p, given)


@query(PANEL + pq._FOLDS + ", c AS (SELECT fold, source, CAST(sum(1 - label) AS BIGINT) AS zeros, CAST(sum(label) AS BIGINT) AS ones FROM folds GROUP BY fold, source) SELECT * FROM c WHERE zeros < 3 OR ones < 3")
def class_count_guard(spark, sf_dir):
    return validate.thin_classes(pq.folds(spark, sf_dir), ["fold", "source"], "label", 3)


_RULES = {"brand": "regexp_matches(p_brand, '^Brand#[1-4][1-5]$')", "size": "p_size BETWEEN 2 AND 45", "price": "p_retailprice > 950"}


@query(" UNION ALL ".join(f"SELECT p_partkey, '{n}' AS rule FROM part WHERE NOT coalesce({t}, false)" for n, t in _RULES.items()))
def rule_violations(spark, sf_dir):
    rules = {"brand": F.col("p_brand").rlike("^Brand#[1-4][1-5]$"), "size": F.col("p_size").between(2, 45), "price": F.col("p_retailprice") > 950}
    return validate.rule_violations(table(spark, sf_dir, "part"), "p_partkey", rules)


# --- joins and aggregates -----------------------------------------------------------------


@query(TARGET + " SELECT entity, t, label FROM panel WHERE entity IN (SELECT entity FROM o2 WHERE status = 'exact')")
def membership_filter(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.join(target.onsets(p).filter("status = 'exact'").select("entity"), "entity", "left_semi").select("entity", "t", "label")


_THRESHOLDS = [(0, 0.4), (1, 0.5), (2, 0.6), (3, 0.7), (4, 0.8)]


@query(LABELLED + pq._FOLDS.replace("en AS", "en_ AS").replace("FROM en)", "FROM en_)") + f""", th(fold, threshold) AS (VALUES {', '.join(f'({a}, {b}e0)' for a, b in _THRESHOLDS)})
    SELECT fold, threshold, count(*) AS n, CAST(sum(CASE WHEN p >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS alarms FROM d JOIN folds USING (entity) JOIN th USING (fold) GROUP BY fold, threshold""")
def fold_thresholds(spark, sf_dir):
    rows = labelled(spark, sf_dir).join(pq.folds(spark, sf_dir).select("entity", "fold"), "entity")
    joined = validate.many_to_one(rows, spark.createDataFrame(_THRESHOLDS, "fold int, threshold double"), ["fold"])
    return joined.groupBy("fold", "threshold").agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0)).alias("alarms"))


@query("SELECT l_orderkey, CAST(greatest(1, round_even(quantile_cont(l_linenumber, CAST(0.5 AS DOUBLE)), 0)) AS INTEGER) AS rounds FROM lineitem GROUP BY l_orderkey")
def median_rounds(spark, sf_dir):
    return selection.round_count(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT DISTINCT user_id AS entity, dense_rank() OVER (ORDER BY user_id) - 1 AS code FROM events")
def entity_codes(spark, sf_dir):
    return selection.codes(table(spark, sf_dir, "events").select(F.col("user_id").alias("entity")), "entity")


# --- summaries ----------------------------------------------------------------------------

_CONFIGURED = LABELLED + """, both_ AS (SELECT 'C0' AS representation, 'plain' AS configuration, y, p0 AS p, w FROM d UNION ALL SELECT 'C3', 'plain', y, p1, w FROM d
    UNION ALL SELECT 'C0', 'shrunk', y, round(0.9e0 * p0 + 0.05e0, 6), w FROM d UNION ALL SELECT 'C3', 'shrunk', y, round(0.9e0 * p1 + 0.05e0, 6), w FROM d)"""


@query(_CONFIGURED + _BY("representation, configuration") + """, pair AS (SELECT configuration, """ + ", ".join(
    f"round(max(CASE WHEN representation = 'C3' THEN {m} END) - max(CASE WHEN representation = 'C0' THEN {m} END), 6) AS {m}_difference" for m in ("ap", "auroc", "brier")) + """ FROM ta GROUP BY configuration)
    SELECT * FROM ta JOIN pair USING (configuration)""")
def robustness_summary(spark, sf_dir):
    shrunk = lambda p: F.round(F.lit(0.9) * F.col(p) + F.lit(0.05), 6)
    rows = labelled(spark, sf_dir).withColumns({"s0": shrunk("p0"), "s1": shrunk("p1")})
    return reports.robustness(rows, [("C0", "plain", "p0"), ("C3", "plain", "p1"), ("C0", "shrunk", "s0"), ("C3", "shrunk", "s1")], "C0", "C3")


@query(pq.UTILITY + f""", reps AS (SELECT unnest(range(1, {pq.REPS + 1})) AS rep), bx AS (SELECT u.*, rep, {pq._copies_sql()} AS copies FROM u, reps),
    br AS (SELECT rep, sum(copies * (observed - inaction)) / nullif(sum(copies * (best - inaction)), 0) AS u FROM bx GROUP BY rep)
    SELECT count(u) AS reps, {pq._Q('u', 'utility')} FROM br""")
def utility_bootstrap(spark, sf_dir):
    per = decision.utility_by_entity(pq.scored(panel(spark, sf_dir)), "p0", 0.6)
    return decision.bootstrap_utility(per, pq.REPS, pq.SEED)


@query(LABELLED + pq.BY_SOURCE + """, a AS (SELECT source, ap, auroc FROM rk), oo_ AS (SELECT y, p, w, 'all' AS g FROM d)"""
       + pq.RANKED.format(by="g,", part="PARTITION BY g", group="GROUP BY g").replace("tied", "tied9").replace("run", "run9").replace(" pr ", " pr9 ").replace("FROM pr)", "FROM pr9)").replace(" tr ", " tr9 ").replace("rk", "rk9").replace("FROM d ", "FROM oo_ ")
       + " SELECT source, round(a.ap - rk9.ap, 6) AS ap_delta, round(a.auroc - rk9.auroc, 6) AS auroc_delta FROM a, rk9")
def sourcewise_deltas(spark, sf_dir):
    d = labelled(spark, sf_dir)
    every = metrics.ranking(d).select(F.col("ap").alias("_ap"), F.col("auroc").alias("_auroc"))  # one row
    by = metrics.ranking(d, ["source"]).crossJoin(F.broadcast(every))
    return by.select("source", F.round(F.col("ap") - F.col("_ap"), 6).alias("ap_delta"), F.round(F.col("auroc") - F.col("_auroc"), 6).alias("auroc_delta"))


def _alarm_sql(p: str) -> str:
    return f"({pq.ALARMS.replace('p0 >= 0.6', f'{p} >= 0.6')}, s AS (SELECT {pq._SUMMARY} FROM rows_) SELECT *, round(detected * 1e0 / nullif(detected + missed, 0), 6) AS sensitivity FROM s)"


def _summary(spark, sf_dir, p: str) -> DataFrame:
    return alarms.alarm_summary(alarms.alarm_rows(pq.alarm_input(spark, sf_dir), F.col(p) >= 0.6))


@query("SELECT m.*, ece, n_decisions, n_entities, n_positive, utility, monitored, episodes, detected, missed, false_episodes, false_per_day, median_lead, sensitivity FROM "
       + f"({pq.SQL['primary_performance']}) m, ")
def model_summary(spark, sf_dir):
    """One row for a score: ranking, calibration, alarms and utility."""
    d = labelled(spark, sf_dir)
    counts = d.agg(F.count("*").alias("n_decisions"), F.countDistinct("entity").alias("n_entities"), F.sum("y").cast("long").alias("n_positive"))
    utility = decision.normalised_utility(decision.utility_by_entity(pq.scored(panel(spark, sf_dir)), "p0", 0.6))
    kept = ["monitored", "episodes", "detected", "missed", "false_episodes", "false_per_day", "median_lead", "sensitivity"]
    out = metrics.performance(d)
    for part in (metrics.ece(d), counts, utility, _summary(spark, sf_dir, "p0").select(*kept)):  # one row each
        out = out.crossJoin(part)
    return out


SQL["model_summary"] += (
    f"({pq.SQL['ece_10']}) e, ({LABELLED} SELECT count(*) AS n_decisions, count(DISTINCT entity) AS n_entities, CAST(sum(y) AS BIGINT) AS n_positive FROM d) c, ({pq.SQL['utility_normalized']}) u, {_alarm_sql('p0')} a"
)


@query(f"""WITH al AS (SELECT 'C0' AS representation, * FROM {_alarm_sql('p0')} UNION ALL SELECT 'C3', * FROM {_alarm_sql('p1')}),
    tr AS (SELECT * FROM ({LONGSCORES + _BY('source, representation')} SELECT source, representation, ap FROM ta)),
    ci AS (SELECT * FROM ({pq.SQL['bootstrap_ap_brier_ci']})),
    cu AS (SELECT pct, net_p1_low, difference_low, treat_all FROM ({pq.SQL['bootstrap_dca_ci']}) JOIN (SELECT pct, treat_all FROM ({pq.SQL['decision_curve']})) USING (pct)),
    g AS (SELECT coalesce((SELECT ap_difference_low FROM ci) > 0, false) AS ap_above_zero,
      coalesce((SELECT max(CASE WHEN representation = 'C3' THEN sensitivity END) > max(CASE WHEN representation = 'C0' THEN sensitivity END) FROM al), false) AS sensitivity_superior,
      coalesce((SELECT max(CASE WHEN representation = 'C3' THEN false_per_day END) <= 0.25 FROM al), false) AS false_alarms_in_budget,
      coalesce((SELECT brier_difference_low FROM ci) <= 0, false) AS brier_not_worse,
      coalesce((SELECT max(CASE WHEN representation = 'C3' THEN median_lead END) >= max(CASE WHEN representation = 'C0' THEN median_lead END) FROM al), false) AS lead_not_shorter,
      coalesce((SELECT bool_or(difference_low > 0 AND net_p1_low >= treat_all AND net_p1_low >= 0) FROM cu), false) AS decision_curve_favorable,
      (SELECT count(DISTINCT source) FROM tr) AS directions,
      (SELECT count(*) FROM (SELECT source FROM tr GROUP BY source HAVING max(CASE WHEN representation = 'C3' THEN ap END) > max(CASE WHEN representation = 'C0' THEN ap END))) AS directions_better)
    SELECT *, CASE WHEN ap_above_zero AND sensitivity_superior AND false_alarms_in_budget AND brier_not_worse AND lead_not_shorter AND decision_curve_favorable
      THEN CASE WHEN directions = directions_better THEN 'TRANSPORT_ROBUSTNESS_CONFIRMED' ELSE 'PROMISING_BUT_NOT_TRANSPORTABLE' END ELSE 'NO_VERIFIED_IMPROVEMENT' END AS status FROM g""")
def primary_gates(spark, sf_dir):
    """The six gates with p1 as the candidate, by the lower ends of the bootstrap intervals."""
    alarm = [_summary(spark, sf_dir, p).withColumn("representation", F.lit(n)) for p, n in (("p0", "C0"), ("p1", "C3"))]
    ci = pq.bootstrap_ap_brier_ci(spark, sf_dir).select(F.col("ap_difference_low").alias("ap_low"), F.col("brier_difference_low").alias("brier_low"))
    treat = decision.decision_curve(labelled(spark, sf_dir), tuple(pq.CURVE), ["p0", "p1"]).select("pct", "treat_all")
    curve = pq.bootstrap_dca_ci(spark, sf_dir).join(treat, "pct").select("difference_low", F.col("net_p1_low").alias("net_low"), "treat_all")
    by_source = metrics.performance(long_scores(spark, sf_dir), ["source", "representation"]).withColumnRenamed("source", "direction")
    return reports.gates(alarm[0].unionByName(alarm[1]), ci, curve, by_source, "C0", "C3")


@query()
def calibration_ci(spark, sf_dir):
    """Calibration figures with 300 cluster-bootstrap replicates; Newton steps have no SQL, a test fits them by hand."""
    return metrics.calibration_intervals(labelled(spark, sf_dir), pq.REPS, pq.SEED)
