"""Closed-form checks of metrics, alarms, utility, bootstrap, innovations and streaming."""

import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import alarms, decision, innovations, lineage, metrics, reports, target
from tidewell.policy import AlarmPolicy


def scores(spark, y, p, entity=None):
    return spark.createDataFrame([(entity[i] if entity else i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(y, p))], "entity long, y double, p double, w double")


def test_ranking(spark):
    r = metrics.ranking(scores(spark, [1, 0, 1, 1, 0], [0.9, 0.7, 0.6, 0.3, 0.2])).first()
    assert r.ap == pytest.approx((1 + 2 / 3 + 3 / 4) / 3, abs=1e-6) and r.auroc == pytest.approx(4 / 6, abs=1e-6)
    tied = metrics.ranking(scores(spark, [0, 1, 0, 0, 1], [0.25] * 5)).first()
    assert tied.ap == 0.4 and tied.auroc == 0.5


def test_calibration(spark):
    assert metrics.ece(scores(spark, [1, 0, 0, 1, 1], [0.32, 0.35, 0.31, 0.84, 0.86])).first().ece == pytest.approx((0.02 + 0.30) / 5, abs=1e-6)
    assert metrics.calibration_offset(scores(spark, [1, 1, 0, 1], [0.5] * 4)) == pytest.approx(math.log(3), abs=1e-9)
    edge = scores(spark, [0, 1, 0], [0, 1, 0.5])
    assert metrics.ece(edge).first().ece == pytest.approx(1 / 6, abs=1e-6) and metrics.brier(edge).first().brier == pytest.approx(1 / 12, abs=1e-6)
    rel = metrics.reliability(edge).collect()
    assert len(rel) == 10 and sum(r.weight for r in rel) == 3 and sum(r.n == 0 for r in rel) == 7
    with pytest.raises(ValueError, match="constant"):
        metrics.logistic_line(scores(spark, [0, 1], [0.3, 0.3]))
    y, p = [0, 0, 1, 0, 1, 1, 0, 1], [0.1, 0.2, 0.3, 0.45, 0.5, 0.6, 0.7, 0.9]
    kind, a, b = metrics.choose_calibration(scores(spark, y, p))
    assert kind in ("identity", "logistic") and math.isfinite(a) and math.isfinite(b)


def test_calibration_intervals_by_hand(spark):
    import numpy as np

    r = np.random.default_rng(5)
    p = np.round(r.uniform(0.05, 0.95, 240), 6)
    y = (r.uniform(size=240) < 0.2 + 0.6 * p).astype(int)
    entity = (np.arange(240) % 40).tolist()
    rows = scores(spark, y.tolist(), p.tolist(), entity)
    got = {x.figure: x for x in metrics.calibration_intervals(rows, 60, 9).collect()}
    a, b = metrics.logistic_line(rows)
    assert got["intercept"].estimate == pytest.approx(a, abs=1e-5) and got["slope"].estimate == pytest.approx(b, abs=1e-5)
    assert got["offset"].estimate == pytest.approx(metrics.calibration_offset(rows), abs=1e-5)
    assert got["ece"].estimate == pytest.approx(metrics.ece(rows).first().ece, abs=1e-6)
    copies = {(x.entity, x.rep): x.copies for x in decision.replicated(rows.select("entity").distinct(), 60, 9).collect()}
    each = []
    for rep in range(1, 61):
        w = np.array([copies.get((e, rep), 0) for e in entity], float)
        each.append(metrics.calibration_of(p, w, w * y, 10))
    for k, f in enumerate(("ece", "offset", "intercept", "slope")):
        low, high = np.quantile([x[k] for x in each], [0.025, 0.975])
        assert (got[f].low, got[f].high) == (pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5))
    assert metrics.calibration_of(p, np.ones(240), np.zeros(240), 10) == (None,) * 4
    parted = metrics.calibration_of(np.array([0.1, 0.2, 0.8, 0.9]), np.ones(4), np.array([0.0, 0, 1, 1]), 10)
    assert parted[2] is None and parted[0] is not None


def test_gates(spark):
    def status(sensitivity=0.9, lead=4.0, false=0.2, low=0.1, transport=0.6):
        alarm = spark.createDataFrame([("C0", 0.8, 0.3, 3.0), ("C3", sensitivity, false, lead)], "representation string, sensitivity double, false_per_day double, median_lead double")
        curve = spark.createDataFrame([(-0.1, 0.2, 0.1), (low, 0.2, 0.1)], "difference_low double, net_low double, treat_all double")
        way = spark.createDataFrame([(d, r, p) for d in ("ab", "ba") for r, p in (("C0", 0.5), ("C3", transport))], "direction string, representation string, ap double")
        return reports.gates(alarm, spark.createDataFrame([(0.01, -0.01)], "ap_low double, brier_low double"), curve, way, "C0", "C3").first()

    assert status().status == "TRANSPORT_ROBUSTNESS_CONFIRMED"
    assert status(transport=0.4).status == "PROMISING_BUT_NOT_TRANSPORTABLE"
    assert status(lead=None).status == "NO_VERIFIED_IMPROVEMENT" and not status(lead=None).lead_not_shorter
    assert not status(false=0.26).false_alarms_in_budget and not status(low=0.0).decision_curve_favorable and not status(sensitivity=0.8).sensitivity_superior


def test_alarms_after_the_last_eligible_hour_are_right_censored(spark):
    rows = [(1, t, 0, 0.9 if t in (3, 18) else 0.1) for t in range(1, 21)]
    df = target.with_target(spark.createDataFrame(rows, "entity long, t long, label int, p double").withColumn("source", F.lit("A")))
    r = alarms.alarm_rows(df, F.col("p") >= 0.5).first()
    assert (r.n_episodes, r.n_false, r.n_right_censored, r.n_repeated, r.first_alert, r.eligible_hours) == (2, 1, 1, 1, 3, 14)


def panel(spark):
    """Onset at 12 for entities 1 and 2, who are warned at 7; entity 5 is warned for nothing at 2."""
    rows = [(e, t, int(e <= 2 and t >= 6), 0.7 if (e <= 2 and 7 <= t <= 9) or (e, t) == (5, 2) else 0.1) for e in (1, 2, 3, 4, 5) for t in range(1, 15)]
    return target.with_target(spark.createDataFrame(rows, "entity long, t long, label int, p double").withColumn("source", F.lit("A")))


def test_alarms(spark):
    s = alarms.alarm_summary(alarms.alarm_rows(panel(spark), F.col("p") >= 0.5)).first()
    assert (s.detected, s.missed, s.false_episodes, s.sensitivity, s.median_lead) == (2, 0, 1, 1.0, 5.0)
    always = alarms.alarm_summary(alarms.alarm_rows(panel(spark), F.col("p") >= 0)).first()
    assert (always.detected, always.missed, always.false_episodes) == (0, 2, 5)  # persistent alarms never arm again


def test_sweep_agrees_with_single_thresholds(spark):
    rows = [(e, t, int(e < 8 and t > 12), (e * 37 + t * t * 11) % 101 / 101) for e in range(20) for t in range(1, 25)]
    df = target.with_target(spark.createDataFrame(rows, "entity long, t long, label int, p double").withColumn("source", F.lit("A")))
    el = target.decisions(df)
    sweep = {r.threshold_pct: r for r in alarms.threshold_sweep(el, "p").collect()}
    for k in (1, 30, 77, 100):
        s = alarms.alarm_summary(alarms.alarm_rows(el, F.floor(F.round(F.col("p") * 100, 9)) >= k)).first()
        assert (sweep[k].detected, sweep[k].false_episodes) == (s.detected, s.false_episodes)


def test_refractory_counts_from_the_last_accepted(spark):
    rows = [(1, t, float(t in (1, 5, 8, 14)), 0.0) for t in range(1, 16)]
    df = spark.createDataFrame(rows, "entity long, t long, p double, x double")
    e = alarms.episodes(alarms.edges(df, F.col("p") >= 0.5), ["entity"], AlarmPolicy())
    assert e.first().times == [1, 8, 14]


def test_utility(spark):
    rows = [(1, t, int(t >= 4), float(t >= 5)) for t in range(1, 9)]  # the onset's row would be the tenth: alarms come 5 to 2 rows before it
    df = spark.createDataFrame(rows, "entity long, t long, label int, p double").withColumn("source", F.lit("A"))
    assert decision.utility_by_entity(df, "p", 0.5).first().observed == pytest.approx((8 + 7 + 6 + 5) / 9, abs=1e-6)
    best = df.withColumn("p", F.lit(1.0))
    u = lambda d: decision.normalised_utility(decision.utility_by_entity(d, "p", 0.5)).first().utility
    assert u(best) == 1.0 and u(df.withColumn("p", F.lit(0.0))) == 0.0


def test_decision_curve_and_bootstrap(spark):
    rows = scores(spark, [0, 1, 0, 1] * 10, [0.1, 0.35, 0.4, 0.8] * 10, list(range(40))).withColumns({"p0": F.col("p"), "p1": 1 - F.col("p")})
    c = {r.pct: r for r in decision.decision_curve(rows, (10, 50), ["p0"]).collect()}
    assert c[50].net_p0 == pytest.approx(0.25) and c[50].treat_all == pytest.approx(0.0)
    b = decision.bootstrap_scores(rows, ["p0", "p1"], 50, 3).first()
    assert b.ap_p0_low <= metrics.ranking(rows).first().ap <= b.ap_p0_high and b.ap_difference_high < 0
    assert decision.bootstrap_curve(rows, (10, 50), ["p0"], 20, 3).count() == 2


def test_poisson_copies_average_one(spark):
    d = decision.replicated(spark.range(200).withColumnRenamed("id", "entity"), 50, 1)
    assert d.agg(F.sum("copies")).first()[0] / 10_000 == pytest.approx(1, abs=0.05)


def test_ridge_matches_normal_equations(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, noise = r.normal(size=(200, 3)), r.normal(size=200)
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * noise
    rows = spark.createDataFrame([("s", [float(v) for v in a], float(b)) for a, b in zip(x, y)], "signal string, x array<double>, y double").repartition(5)
    got = innovations.ridge(rows, 1.0).first().beta
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))
    assert np.allclose(got[1:], want) and got[0] == pytest.approx(y.mean() - x.mean(0) @ want)


def test_innovations_see_an_anomaly(spark):
    rows = [(e, t, float(10 + (t + e) % 3), 0) for e in range(6) for t in range(1, 40)] + [(99, t, 50.0 if t == 20 else 10.0 + t % 3, 0) for t in range(1, 30)]
    df = target.with_target(spark.createDataFrame(rows, "entity long, t long, x double, label int").withColumn("source", F.lit("A")))
    m = innovations.fit(df, ["x"])
    out = innovations.transform(innovations.with_states(df, ["x"]), m)
    worst = out.orderBy(F.desc("energy")).first()
    assert (worst.entity, worst.t) == (99, 20)
    assert out.filter("t = 1").agg(F.count("x_innovation")).first()[0] == 0


def test_reports_and_lineage(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p_value double")
    assert {r.name: r.adjusted for r in reports.false_discovery(t).collect()} == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 0.5}
    g = spark.createDataFrame([(0.1,), (None,)], "ap_difference double")
    assert reports.gate(g).first().status == "PARTIAL"
    n = spark.createDataFrame([("x", "0" * 64, "a" * 40), ("y", "zz", "a" * 40)], "artifact string, sha256 string, commit string")
    assert [r.artifact for r in lineage.malformed_nodes(n).collect()] == ["y"]
    e = spark.createDataFrame([("m", "x", "0" * 64), ("m", "x", "1" * 64)], "node string, input string, sha256 string")
    assert lineage.dangling_edges(e, n).count() == 1
    other = spark.createDataFrame([("x", "1" * 64), ("w", "0")], "artifact string, sha256 string")
    assert {(r.artifact, r.what) for r in lineage.artifact_differences(n, other).collect()} == {("x", "mismatch"), ("y", "missing"), ("w", "unexpected")}


def test_streaming_alarms_match_batch(spark, tmp_path):
    from tidewell.streaming.alarms import accepted_alarms, hourly_counts

    rows = [(e, t, float((e * 7 + t * t) % 5 > 2)) for e in range(3) for t in range(1, 25)]
    df = spark.createDataFrame(rows, "entity long, t long, p double")
    for k, part in enumerate((df.filter("t <= 12"), df.filter("t > 12"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = accepted_alarms(s, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.entity, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = alarms.episodes(alarms.edges(df, F.col("p") >= 0.5), ["entity"]).select("entity", F.explode("times").alias("t"))
    assert got == sorted((r.entity, r.t) for r in want.collect())
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 00:50:00", 4.0)], "user_id long, ts string, value double")
    assert hourly_counts(ev).first().mean == 3.0
