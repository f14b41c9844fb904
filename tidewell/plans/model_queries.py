"""Queries over models, calibration, comparison tables, reshaping and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import features as feats
from tidewell.operators import innovations, lineage, metrics, models, reports, selection, target, windows
from tidewell.plans import panel_queries as pq
from tidewell.plans.panel_queries import LABELLED, PANEL, SCORED, TARGET, labelled, panel, scored, table, targeted
from tidewell.policy import ModelPolicy

QUERIES: dict[str, pq.Query] = {}
SQL: dict[str, str] = {}
D = lambda q: f"CAST({q} AS DOUBLE)"


def query(sql: str | None = None):
    def register(f: pq.Query) -> pq.Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- entropy ------------------------------------------------------------------------------


def view_series(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir).filter("view IS NOT NULL")
    s = p.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("t", "view"))).alias("s"))
    return s.select("entity", F.transform("s", lambda x: x["view"]).alias("v"))


@query(PANEL + """, x AS (SELECT entity, view AS v, min(view) OVER w AS lo, max(view) OVER w AS hi, count(*) OVER w AS n FROM panel WHERE view IS NOT NULL WINDOW w AS (PARTITION BY entity)),
    a AS (SELECT entity, n, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / nullif(hi - lo, 0) * 10), 9) END AS bin FROM x),
    b AS (SELECT entity, bin, count(*) * 1e0 / n AS share FROM a GROUP BY entity, n, bin)
    SELECT entity, round(abs(-sum(share * ln(share))), 6) AS entropy FROM b GROUP BY entity""")
def shannon_entropy(spark, sf_dir):
    return view_series(spark, sf_dir).select("entity", F.round(F.abs(scalars.shannon_entropy(F.col("v"))), 6).alias("entropy"))


@query(PANEL + """, x AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY t) AS i, view AS v, count(*) OVER (PARTITION BY entity) AS n, 0.2 * stddev_pop(view) OVER (PARTITION BY entity) AS r FROM panel WHERE view IS NOT NULL),
    y AS (SELECT *, lead(v, 1) OVER (PARTITION BY entity ORDER BY i) AS v1, lead(v, 2) OVER (PARTITION BY entity ORDER BY i) AS v2 FROM x),
    m AS (SELECT a.entity, sum(CASE WHEN abs(a.v - b.v) <= a.r AND abs(a.v1 - b.v1) <= a.r THEN 1 ELSE 0 END) AS b2, sum(CASE WHEN abs(a.v - b.v) <= a.r AND abs(a.v1 - b.v1) <= a.r AND abs(a.v2 - b.v2) <= a.r THEN 1 ELSE 0 END) AS a3
      FROM y a JOIN y b ON a.entity = b.entity AND a.i < b.i WHERE a.i <= a.n - 2 AND b.i <= b.n - 2 GROUP BY a.entity)
    SELECT e.entity, round(CASE WHEN b2 > 0 AND a3 > 0 THEN -ln(a3 * 1e0 / b2) END, 6) AS sample_entropy FROM (SELECT DISTINCT entity FROM x) e LEFT JOIN m ON e.entity = m.entity""")
def sample_entropy(spark, sf_dir):
    v = scalars.sample_entropy(F.col("v"))
    return view_series(spark, sf_dir).select("entity", F.round(F.when(v < float("inf"), v), 6).alias("sample_entropy"))


# --- innovations --------------------------------------------------------------------------

ONE = ["view"]
STATES = TARGET + """, ls AS (SELECT round(quantile_cont(view, CAST(0.5 AS DOUBLE)), 6) AS c, round(quantile_cont(view, CAST(0.75 AS DOUBLE)) - quantile_cont(view, CAST(0.25 AS DOUBLE)), 6) AS s FROM panel),
    st AS (SELECT *, lag(t) OVER (PARTITION BY entity ORDER BY t) IS NOT NULL AS pe, last_value(view IGNORE NULLS) OVER b AS lv, t - last_value(CASE WHEN view IS NOT NULL THEN t END IGNORE NULLS) OVER b AS la
      FROM targeted WINDOW b AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    sx AS (SELECT st.*, (CASE WHEN la <= 24 THEN lv END - c) / s AS v, CASE WHEN la > 24 THEN 24 ELSE la END / 24e0 AS a, (view - c) / s AS y, pe AND (status = 'negative' OR (status = 'exact' AND hours_to_onset > 12)) AS quiet FROM st, ls),
    fm AS (SELECT quantile_cont(v, CAST(0.5 AS DOUBLE)) AS fv, quantile_cont(a, CAST(0.5 AS DOUBLE)) AS fa FROM sx WHERE quiet),
    xx AS (SELECT sx.*, coalesce(v, fv) AS x1, coalesce(a, fa) AS x2 FROM sx, fm),
    tr AS (SELECT * FROM xx WHERE quiet AND y IS NOT NULL),
    mo AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) + 1 AS s11, var_pop(x2) * count(*) + 1 AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM tr),
    be AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM mo),
    co AS (SELECT n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM be),
    rs AS (SELECT quantile_cont(y - b0 - b1 * x1 - b2 * x2, CAST(0.5 AS DOUBLE)) AS rm, quantile_cont(y - b0 - b1 * x1 - b2 * x2, CAST(0.75 AS DOUBLE)) - quantile_cont(y - b0 - b1 * x1 - b2 * x2, CAST(0.25 AS DOUBLE)) AS ri FROM tr, co),
    inn AS (SELECT entity, t, CASE WHEN pe THEN (y - b0 - b1 * x1 - b2 * x2 - rm) / ri END AS e FROM xx, co, rs)"""


@query(STATES + " SELECT 'view' AS signal, round(b0, 6) AS intercept, round(b1, 6) AS value, round(b2, 6) AS age FROM co")
def innovation_ridge_coefficients(spark, sf_dir):
    m = innovations.fit(targeted(spark, sf_dir), ONE)
    b = m.coefficients["view"]
    return spark.createDataFrame([("view", *(round(x, 6) for x in b))], "signal string, intercept double, value double, age double")


def _innovations(spark, sf_dir) -> DataFrame:
    t = targeted(spark, sf_dir)
    return innovations.transform(innovations.with_states(t, ONE), innovations.fit(t, ONE), digits=None)


@query(STATES + " SELECT entity, t, round(e, 5) AS innovation FROM inn")
def innovation_rows(spark, sf_dir):
    return _innovations(spark, sf_dir).select("entity", "t", F.round("view_innovation", 5).alias("innovation"))


@query(STATES + """, en AS (SELECT entity, t, e * e AS g FROM inn)
    SELECT entity, t, round(avg(g) OVER r, 4) AS energy_mean, round(max(g) OVER r, 4) AS energy_max FROM en WINDOW r AS (PARTITION BY entity ORDER BY t RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def innovation_energy_8h(spark, sf_dir):
    return _innovations(spark, sf_dir).select("entity", "t", F.round("energy_mean_8h", 4).alias("energy_mean"), F.round("energy_max_8h", 4).alias("energy_max"))


@query()
def innovation_lifted(spark, sf_dir):
    """All signals, quadratic lift."""
    t = targeted(spark, sf_dir)
    m = innovations.fit(t, pq.SIGNALS, lift=True)
    return innovations.transform(innovations.with_states(t, pq.SIGNALS), m).select("entity", "t", *[f"{s}_innovation" for s in pq.SIGNALS], "innovation_count", "energy")


@query(TARGET + """, q AS (SELECT *, lag(t) OVER (PARTITION BY entity ORDER BY t) IS NOT NULL AS pe FROM targeted)
    SELECT entity, t FROM q WHERE pe AND (status = 'negative' OR (status = 'exact' AND hours_to_onset > 12))""")
def normal_dynamics_rows(spark, sf_dir):
    return innovations.normal_rows(targeted(spark, sf_dir).withColumn("previous_exists", windows.previous_exists())).select("entity", "t")


@query(STATES + " SELECT 'view' AS signal, round(fv, 6) AS value_fill, round(fa, 6) AS age_fill FROM fm")
def state_fill(spark, sf_dir):
    m = innovations.fit(targeted(spark, sf_dir), ONE)
    return spark.createDataFrame([("view", round(m.fill[0], 6), round(m.fill[1], 6))], "signal string, value_fill double, age_fill double")


# --- calibration --------------------------------------------------------------------------

_Z = ", dz AS (SELECT y, w, ln(greatest(least(p, 0.999999e0), 0.000001e0) / (1 - greatest(least(p, 0.999999e0), 0.000001e0))) AS z, p FROM d)"


@query(LABELLED.replace("WITH e AS", "WITH RECURSIVE e AS") + _Z + """, lz AS MATERIALIZED (SELECT list({'w': w, 'y': y, 'z': z}) AS l FROM dz),
    it(k, a) AS (SELECT 0, 0e0 UNION ALL SELECT k + 1, a + list_sum(list_transform(l, lambda r: r.w * (r.y - 1 / (1 + exp(-(r.z + a))))))
      / list_sum(list_transform(l, lambda r: r.w * (1 / (1 + exp(-(r.z + a)))) * (1 - 1 / (1 + exp(-(r.z + a)))))) FROM it, lz WHERE k < 12)
    SELECT round(a, 5) AS offset_ FROM it WHERE k = 12""")
def calibration_in_the_large(spark, sf_dir):
    return spark.createDataFrame([(round(metrics.calibration_offset(labelled(spark, sf_dir)), 5),)], "offset_ double")


_LINE = LABELLED.replace("WITH e AS", "WITH RECURSIVE e AS") + _Z + """, lz AS MATERIALIZED (SELECT list({'w': w, 'y': y, 'z': z}) AS l FROM dz),
    it(k, a, b) AS (SELECT 0, 0e0, 1e0 UNION ALL SELECT k + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
      SELECT k, a, b, list_sum(list_transform(l, lambda r: r.w * (r.y - 1 / (1 + exp(-(a + b * r.z)))))) AS g0,
        list_sum(list_transform(l, lambda r: r.w * r.z * (r.y - 1 / (1 + exp(-(a + b * r.z)))))) AS g1,
        list_sum(list_transform(l, lambda r: r.w / (1 + exp(-(a + b * r.z))) / (1 + exp(a + b * r.z)))) AS h0,
        list_sum(list_transform(l, lambda r: r.w * r.z / (1 + exp(-(a + b * r.z))) / (1 + exp(a + b * r.z)))) AS h1,
        list_sum(list_transform(l, lambda r: r.w * r.z * r.z / (1 + exp(-(a + b * r.z))) / (1 + exp(a + b * r.z)))) AS h2 FROM it, lz WHERE k < 15)),
    ln_ AS (SELECT a, b FROM it WHERE k = 15)"""


@query(_LINE + " SELECT round(a, 5) AS intercept, round(b, 5) AS slope FROM ln_")
def calibration_slope(spark, sf_dir):
    a, b = metrics.logistic_line(labelled(spark, sf_dir))
    return spark.createDataFrame([(round(a, 5), round(b, 5))], "intercept double, slope double")


@query(_LINE + """ SELECT CASE WHEN sum(w * pow(y - 1 / (1 + exp(-(a + b * z))), 2)) < sum(w * (y - p) * (y - p)) THEN 'logistic' ELSE 'identity' END AS choice FROM dz, ln_""")
def calibration_choice(spark, sf_dir):
    return spark.createDataFrame([(metrics.choose_calibration(labelled(spark, sf_dir))[0],)], "choice string")


@query(_LINE + " SELECT entity, t, round(1 / (1 + exp(-(a + b * ln(p / (1 - p))))), 5) AS calibrated FROM d, ln_")
def calibrated_scores(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.select("entity", "t", F.round(metrics.calibrated(F.col("p"), metrics.choose_calibration(rows)), 5).alias("calibrated"))


# --- comparison tables --------------------------------------------------------------------

LONGSCORES = LABELLED + ", both_ AS (SELECT source, 'C0' AS representation, y, p0 AS p, w FROM d UNION ALL SELECT source, 'C3', y, p1, w FROM d)"
_BY = lambda by: (pq.RANKED.format(by=by + ",", part="PARTITION BY " + by, group="GROUP BY " + by).replace("FROM d ", "FROM both_ ")
                  + f", ta AS (SELECT * FROM rk JOIN (SELECT {by}, round(sum(w * (y - p) * (y - p)) / sum(w), 6) AS brier FROM both_ GROUP BY {by}) USING ({by}))")


def long_scores(spark, sf_dir) -> DataFrame:
    d = labelled(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("C0").alias("representation"), F.col("p0").alias("p")), F.struct(F.lit("C3").alias("representation"), F.col("p1").alias("p")))).alias("x")
    return d.select("source", "y", "w", both).select("source", "y", "w", "x.*")


@query(LONGSCORES + _BY("representation") + ", b AS (SELECT * FROM ta WHERE representation = 'C0') SELECT ta.*, round(ta.ap - b.ap, 6) AS ap_vs_C0, round(ta.brier - b.brier, 6) AS brier_vs_C0 FROM ta, b")
def ablation_table(spark, sf_dir):
    return reports.against_base(metrics.performance(long_scores(spark, sf_dir), ["representation"]), "representation", "C0", ["ap", "brier"])


@query(LONGSCORES + _BY("source, representation") + " SELECT 'by_source' AS section, source, representation, ap, auroc, brier FROM ta UNION ALL SELECT 'all', NULL, representation, ap, auroc, brier FROM ("
       + "SELECT representation, ap, auroc, brier FROM (" + "SELECT * FROM ab))")
def master_results(spark, sf_dir):
    long = long_scores(spark, sf_dir)
    cols = ["section", "source", "representation", "ap", "auroc", "brier"]
    a = metrics.performance(long, ["source", "representation"]).withColumn("section", F.lit("by_source")).select(cols)
    b = metrics.performance(long, ["representation"]).withColumns({"section": F.lit("all"), "source": F.lit(None).cast("string")}).select(cols)
    return a.unionByName(b)


_AB = _BY("representation").replace("tied", "tied2").replace("run", "run2").replace(" pr ", " pr2 ").replace("FROM pr)", "FROM pr2)").replace(" tr ", " tr2 ").replace("rk", "rk2").replace("ta AS", "ab AS")
SQL["master_results"] = SQL["master_results"].replace(" SELECT 'by_source'", _AB + " SELECT 'by_source'", 1)


@query(LONGSCORES + _BY("source, representation") + """ SELECT source, round(max(CASE WHEN representation = 'C3' THEN ap END) - max(CASE WHEN representation = 'C0' THEN ap END), 6) AS ap_difference,
    round(max(CASE WHEN representation = 'C3' THEN brier END) - max(CASE WHEN representation = 'C0' THEN brier END), 6) AS brier_difference FROM ta GROUP BY source""")
def paired_difference(spark, sf_dir):
    t = metrics.performance(long_scores(spark, sf_dir), ["source", "representation"])
    return reports.paired_differences(t, ["source"], "representation", "C0", "C3", ["ap", "brier"])


@query(SQL["paired_difference"].replace(" SELECT source, round(max", ", df AS (SELECT source, round(max", 1) + """)
    SELECT count(*) AS gates, CAST(sum(CASE WHEN ap_difference > 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed,
    CASE WHEN sum(CASE WHEN ap_difference > 0 THEN 1 ELSE 0 END) = count(*) THEN 'CONFIRMED' WHEN sum(CASE WHEN ap_difference > 0 THEN 1 ELSE 0 END) > 0 THEN 'PARTIAL' ELSE 'NOT_CONFIRMED' END AS status FROM df""")
def gate_status(spark, sf_dir):
    return reports.gate(paired_difference(spark, sf_dir))


@query(LABELLED + """, k AS (SELECT unnest(range(5, 100, 5)) AS threshold_pct), c AS (SELECT CAST(threshold_pct AS INTEGER) AS threshold_pct,
      CAST(sum(CASE WHEN floor(round(p * 100, 9)) >= threshold_pct THEN y ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN floor(round(p * 100, 9)) >= threshold_pct THEN 1 - y ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN floor(round(p * 100, 9)) < threshold_pct THEN y ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN floor(round(p * 100, 9)) < threshold_pct THEN 1 - y ELSE 0 END) AS BIGINT) AS tn FROM d, k GROUP BY threshold_pct)
    SELECT *, round(tp * 1e0 / nullif(tp + fn, 0), 6) AS sensitivity, round(tn * 1e0 / nullif(tn + fp, 0), 6) AS specificity, round(tp * 1e0 / nullif(tp + fp, 0), 6) AS "precision", round(2e0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def threshold_confusion(spark, sf_dir):
    return reports.confusion(labelled(spark, sf_dir), list(range(5, 100, 5)))


_N = lambda test, name: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


@query(LABELLED + f", e2 AS (SELECT entity, max(y) AS y, max(p) AS p FROM d GROUP BY entity) SELECT {_N('y = 1 AND p >= 0.6', 'tp')}, {_N('y <> 1 AND p >= 0.6', 'fp')}, {_N('y = 1 AND p < 0.6', 'fn')}, {_N('y <> 1 AND p < 0.6', 'tn')} FROM e2")
def entity_confusion(spark, sf_dir):
    return reports.entity_confusion(labelled(spark, sf_dir), 0.6)


@query(LABELLED + f""", c AS (SELECT {_N('(p0 >= 0.5) = (y = 1) AND (p1 >= 0.5) <> (y = 1)', 'only_a')}, {_N('(p0 >= 0.5) <> (y = 1) AND (p1 >= 0.5) = (y = 1)', 'only_b')} FROM d)
    SELECT *, round((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) * 1e0 / nullif(only_a + only_b, 0), 6) AS statistic FROM c""")
def mcnemar_counts(spark, sf_dir):
    return reports.discordant(labelled(spark, sf_dir), "p0", "p1", 0.5)


@query("""WITH t AS (SELECT p_brand AS name, round(avg(p_retailprice) / 100000, 6) AS p_value FROM part GROUP BY p_brand), r AS (SELECT *, CAST(row_number() OVER (ORDER BY p_value, name) AS INTEGER) AS rank, count(*) OVER () AS n FROM t)
    SELECT name, p_value, rank, round(least(1.0e0, min(p_value * n / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM r""")
def bh_adjust(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice") / 100000, 6).alias("p_value"))
    return reports.false_discovery(t)


@query(pq.ALARMS + """ SELECT source, count(first_useful) AS detected, round(quantile_cont(CAST(onset - first_useful AS DOUBLE), CAST(0.5 AS DOUBLE)), 6) AS median_lead,
    round(quantile_cont(CAST(onset - first_useful AS DOUBLE), CAST(0.75 AS DOUBLE)) - quantile_cont(CAST(onset - first_useful AS DOUBLE), CAST(0.25 AS DOUBLE)), 6) AS iqr_lead FROM rows_ GROUP BY source""")
def lead_time_summary(spark, sf_dir):
    from tidewell.operators import alarms

    r = alarms.alarm_rows(pq.alarm_input(spark, sf_dir), F.col("p0") >= 0.6).withColumn("lead", F.col("lead").cast("double"))
    q = lambda x: F.percentile("lead", F.lit(x))
    return r.groupBy("source").agg(F.count("first_useful").alias("detected"), F.round(q(0.5), 6).alias("median_lead"), F.round(q(0.75) - q(0.25), 6).alias("iqr_lead"))


@query("""WITH j AS (SELECT lang, source, doc_id, CAST(quality AS DOUBLE) AS y, round(1 - 1 / (1 + n_chars / 1000e0), 6) AS p FROM documents JOIN labels USING (doc_id)),
    d AS (SELECT lang, y, p, 1e0 AS w FROM j)""" + pq.RANKED.format(by="lang,", part="PARTITION BY lang", group="GROUP BY lang")
       + ", s AS (SELECT lang, round(sum((y - p) * (y - p)) / count(*), 6) AS brier FROM d GROUP BY lang) SELECT lang, ap, auroc, pr_area, brier FROM rk JOIN s USING (lang)")
def subgroup_metrics(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = j.select("lang", F.col("quality").cast("double").alias("y"), F.round(1 - 1 / (1 + F.col("n_chars") / 1000), 6).alias("p"), F.lit(1.0).alias("w"))
    return metrics.performance(rows, ["lang"])


@query(LABELLED + pq._FOLDS.replace("en AS", "en_ AS").replace("FROM en)", "FROM en_)") + ", d2 AS (SELECT fold, y, p, w FROM d JOIN folds USING (entity))"
       + pq.RANKED.format(by="fold,", part="PARTITION BY fold", group="GROUP BY fold").replace("FROM d ", "FROM d2 ") + " SELECT fold, ap, auroc FROM rk")
def fold_comparison(spark, sf_dir):
    d = labelled(spark, sf_dir).join(pq.folds(spark, sf_dir).select("entity", "fold"), "entity")
    return metrics.ranking(d, ["fold"]).select("fold", "ap", "auroc")


# --- reshaping and provenance -------------------------------------------------------------


@query(PANEL + " SELECT entity, " + ", ".join(f"max({s}) AS {s}" for s in pq.SIGNALS) + " FROM panel GROUP BY entity")
def robustness_pivot(spark, sf_dir):
    long = selection.long_signals(panel(spark, sf_dir), pq.SIGNALS)
    return long.groupBy("entity").pivot("signal", pq.SIGNALS).agg(F.max("value"))


@query(SCORED + " SELECT entity, t, 'p0' AS configuration, p0 AS p FROM scored UNION ALL SELECT entity, t, 'p1', p1 FROM scored")
def robustness_unpivot(spark, sf_dir):
    return scored(targeted(spark, sf_dir)).unpivot(["entity", "t"], ["p0", "p1"], "configuration", "p")




@query("""WITH a AS (SELECT p_partkey AS artifact, sha256(p_brand) AS want FROM part WHERE p_partkey % 7 <> 0),
      b AS (SELECT p_partkey AS artifact, sha256(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END) AS got FROM part WHERE p_partkey % 11 <> 0)
    SELECT * FROM (SELECT artifact, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN want <> got THEN 'mismatch' END AS what FROM a FULL JOIN b USING (artifact)) WHERE what IS NOT NULL""")
def artifact_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("artifact"), F.sha2("p_brand", 256).alias("sha256"))
    b = p.filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("artifact"), F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")), 256).alias("sha256"))
    return lineage.artifact_differences(a, b)


@query("""SELECT l_orderkey AS node, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS input, sha256(l_returnflag) AS sha256 FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND sha256(CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'R' END) = sha256(l.l_returnflag))""")
def lineage_dangling(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("input"), F.sha2("l_returnflag", 256).alias("sha256"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("artifact"), F.sha2(F.when(F.col("p_size") % 2 == 0, "N").otherwise("R"), 256).alias("sha256"))
    return lineage.dangling_edges(edges, nodes)


# --- models -------------------------------------------------------------------------------



def plan(name: str) -> models.Plan:
    """The full grid: every default of models.Plan. The tables have fewer entities than 1,000 at small sizes, so a signal may be seen in any number of them."""
    return models.Plan(name, tuple(pq.SIGNALS), policy=ModelPolicy(least_entities=1))


def model_rows(spark, sf_dir) -> DataFrame:
    return feats.features(targeted(spark, sf_dir), pq.SIGNALS)


def _shown(out: DataFrame, *more: str) -> DataFrame:
    return out.select("entity", "t", "depth", "lift", "rounds", "calibrator", "threshold_pct", F.round("p_raw", 6).alias("p_raw"), F.round("p", 6).alias("p"), *more)


@query()
def nested_oof(spark, sf_dir):
    """Nested cross-validation on the state representation; every row gets one out-of-fold prediction."""
    return _shown(models.nested_predictions(model_rows(spark, sf_dir), plan("C1"), 20), "outer")


@query()
def nested_innovations(spark, sf_dir):
    """The same with innovations: both lifts, the representation fitted inside each fold."""
    return _shown(models.nested_predictions(model_rows(spark, sf_dir), plan("C3"), 20), "outer")


@query()
def robustness_oof(spark, sf_dir):
    """Predictions of every seed and balance on the changes representation, and their figures; none is chosen."""
    grid = models.robustness_grid()
    out = models.nested_predictions(model_rows(spark, sf_dir), plan("C2"), 20, grid)
    y = target.decisions(out).withColumn("y", F.col("target").cast("double")).withColumn("w", scalars.equal_entity_weight())
    names = ["p_raw", *(f"p_{s}_{b}" for s, b in grid)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("configuration"), F.col(n).alias("p")) for n in names])).alias("x")
    return metrics.performance(y.select("y", "w", each).select("y", "w", "x.*"), ["configuration"])


@query()
def transport_ab(spark, sf_dir):
    """Every row predicted by the model of the other source, in both directions."""
    return _shown(models.transport_both(model_rows(spark, sf_dir), plan("C1"), ("A", "B"), 20), "direction")
