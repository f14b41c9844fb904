"""Closed-form checks of windows, targets, validators and sources."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import features, selection, target, validate, windows
from tidewell.policy import AlarmPolicy, PanelPolicy, digest
from tidewell.sources import panel as src


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("entity", "t").collect()]


def frame(spark, rows, cols="entity long, t long, x double, label int"):
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="module")
def three(spark):
    rows = [(1, t, float(t), int(t >= 4)) for t in range(1, 11)] + [(2, t, float(t), 0) for t in range(1, 11)] + [(3, t, float(t), 1) for t in range(1, 5)]
    return frame(spark, rows).withColumn("source", F.lit("A"))


def test_last_observation_expires_after_24_hours(spark):
    df = frame(spark, [(1, 1, 1.0, 0), (1, 2, None, 0), (1, 25, None, 0), (1, 30, None, 0)])
    assert rows_of(df.withColumn("v", windows.last_observation("x")), "v") == [(1.0,), (1.0,), (1.0,), (None,)]


def test_carried_values_and_ages(spark):
    df = frame(spark, [(1, 1, 80.0, 0), (1, 2, None, 0), (1, 3, None, 0), (1, 4, 83.0, 0)])
    got = rows_of(df.withColumns({"v": windows.carried("x"), "a": windows.observation_age("x")}), "v", "a")
    assert got == [(80.0, 0), (80.0, 1), (80.0, 2), (83.0, 0)]


def test_previous_state_and_deltas(spark):
    df = frame(spark, [(1, 1, 10.0, 0), (1, 2, None, 0), (1, 4, 16.0, 0), (1, 5, 19.0, 0)])
    v, a = windows.previous_state("x")
    d, s = windows.delta_and_slope("x")
    got = rows_of(df.withColumns({"v": v, "a": a, "d": d, "s": s}), "v", "a", "d", "s")
    assert got == [(None, None, None, None), (10.0, 1, None, None), (10.0, 3, 6.0, 2.0), (16.0, 1, 3.0, 3.0)]


def test_previous_state_clips_age_and_drops_old_values(spark):
    df = frame(spark, [(1, 1, 10.0, 0), (1, 26, None, 0), (1, 27, 5.0, 0)])
    v, a = windows.previous_state("x")
    assert rows_of(df.withColumns({"v": v, "a": a}), "v", "a") == [(None, None), (None, 24), (None, 24)]


def test_rolling_frame_is_open_on_the_left(spark):
    df = frame(spark, [(1, 1, 1.0, 0), (1, 8, 2.0, 0), (1, 9, 3.0, 0)])
    got = rows_of(df.withColumns({"m": windows.rolling("x", 8, "mean", 1), "top": windows.rolling("x", 8, "max", 1)}), "m", "top")
    assert got == [(1.0, 1.0), (1.5, 2.0), (2.5, 3.0)]
    fine = df.withColumn("t", F.col("t") + 0.5).withColumn("m", F.avg("x").over(windows.fine_hours(8)))
    assert [r.m for r in fine.orderBy("t").collect()] == [1.0, 1.5, 2.5]


def test_joins_fail_closed(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    ok, two, none = (spark.createDataFrame(r, "k int, p double") for r in ([(1, 0.5), (2, 1.0)], [(1, 0.5), (1, 0.4), (2, 0.1)], [(1, 0.5)]))
    assert validate.many_to_one(left, ok, ["k"]).count() == 2 and validate.with_predictions(left, ok, ["k"], ["p"]).count() == 2
    for right in (two, none):
        for join in (validate.many_to_one, validate.paired):
            with pytest.raises(validate.Violation):
                join(left, right, ["k"])
    with pytest.raises(validate.Violation, match="no probability"):
        validate.with_predictions(left, ok.withColumn("p", F.col("p") + 0.6), ["k"], ["p"])
    with pytest.raises(validate.Violation, match="columns of both"):
        validate.paired(left, ok.withColumn("x", F.lit(1)), ["k"])
    assert validate.without_rows(left, none, "k").collect()[0].k == 2


def test_folds_and_class_sums_use_no_window_by_class_alone(spark, capsys):
    df = spark.range(50).select(F.col("id").alias("entity"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("w"))
    selection.stratified_folds(df, 5, 7).explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"row_number\(\) windowspecdefinition\(label#\d+, _part", plan) and not re.search(r"row_number\(\) windowspecdefinition\(label#\d+, (?!_part)", plan)
    scalars.class_balanced(df, "w", "label").explain("formatted")
    assert "Window" not in capsys.readouterr().out
    sizes = {r["fold"]: r["count"] for r in selection.stratified_folds(df, 5, 7).groupBy("fold").count().collect()}
    assert sizes == dict.fromkeys(range(5), 10)


def test_canonical_json_and_rounds(spark):
    df = spark.createDataFrame([(1, float("inf"), "é\"x"), (2, 2.5, None)], "k int, v double, s string")
    got = [r.j for r in df.orderBy("k").select(scalars.canonical_json({"v": F.col("v"), "s": F.col("s")}).alias("j")).collect()]
    assert got == ['{"s":"é\\"x","v":null}', '{"s":null,"v":2.5}']
    rounds = spark.createDataFrame([("a", 2), ("a", 3), ("b", 3), ("b", 4), ("c", 0)], "g string, n int")
    assert {r.g: r.rounds for r in selection.round_count(rounds, ["g"], "n").collect()} == {"a": 2, "b": 4, "c": 1}


def test_windows_do_not_see_the_future(spark):
    rows = [(1, t, float(t * t % 7) if t % 3 else None, 0) for t in range(1, 30)]
    build = lambda r: features.features(frame(spark, r).withColumn("source", F.lit("A")), ["x"]).drop("x").orderBy("t").collect()
    assert build(rows)[:-1] == build(rows[:-1] + [(1, 29, 99.0, 0)])[:-1]


def test_onset_and_target(three):
    t = target.with_target(three)
    by = {e: [(r.eligible, r.target) for r in t.filter(F.col("entity") == e).orderBy("t").collect()] for e in (1, 2, 3)}
    assert by[1] == [(1, 0)] * 3 + [(1, 1)] * 6 + [(0, None)]
    assert by[2] == [(1, 0)] * 4 + [(0, None)] * 6
    assert by[3] == [(0, None)] * 4
    on = {r.entity: (r.status, r.onset) for r in target.onsets(three).collect()}
    assert on == {1: ("exact", 10), 2: ("negative", None), 3: ("left_censored", None)}
    assert target.target_violations(t).isEmpty()
    assert not target.target_violations(t.withColumn("target", F.lit(None).cast("int"))).isEmpty()


def test_validators(spark):
    df = frame(spark, [(1, 1, 1.0, 0), (1, 1, 2.0, 1), (1, 2, 2.0, 0)])
    assert validate.duplicates(df, ["entity", "t"]).count() == 1
    assert validate.label_drops(df.filter("x = 2.0")).count() == 1
    assert validate.not_constant(df, "x").count() == 1
    assert validate.not_in(df, "label", [0]).count() == 1
    text = spark.createDataFrame([("1", "2"), ("x", None), ("inf", "NaN"), ("", "3")], "a string, b string")
    assert sorted(r.value for r in validate.not_numeric(text, ["a", "b"]).collect()) == ["", "NaN", "inf", "x"]
    assert [r.b for r in validate.numbers(text.filter("a = 'inf'"), ["b"]).collect()] == [None]
    with pytest.raises(validate.Violation):
        validate.enforce(validate.duplicates(df, ["entity", "t"]), "duplicate keys")
    folds = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0)], "entity long, label int, fold int")
    assert {(r.entity, r.what) for r in validate.fold_violations(df, folds, 2).collect()} == {(1, "several folds"), (2, "unknown entity")}
    other = df.withColumn("x", F.col("x") * (1 + 1e-13))
    uniq, uniq2 = df.filter("x = 1.0 OR t = 2"), other.filter("x < 1.5 OR t = 2")
    assert validate.frame_differences(uniq, uniq2, ["entity", "t"], 1e-12).isEmpty()
    assert validate.frame_differences(uniq, uniq2, ["entity", "t"]).count() == 2


def test_entropies(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v array<double>")
    h = lambda v, b: one(v).select(scalars.shannon_entropy(F.col("v"), b)).first()[0]
    assert h([0.0, 0.0, 1.0, 1.0], 2) == pytest.approx(math.log(2))
    assert h([3.0, 3.0], 10) == 0.0 and h([], 10) is None
    s = lambda v: one(v).select(scalars.sample_entropy(F.col("v"))).first()[0]
    assert s([0.0, 0.0, 0.0, 0.0, 1.0]) == pytest.approx(-math.log(1 / 3))
    assert s([0.0, 0.0, 0.0, 10.0]) == float("inf")
    assert s([0.0, 1.0, 2.0, 3.0]) is None


def test_lift_and_hash(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(scalars.lifted(F.col("x"))).first()[0] == [1, 2, 3, 1, 2, 3, 4, 6, 9]
    ids = spark.createDataFrame([(["b", "a"],)], "x array<string>")
    import hashlib

    assert ids.select(scalars.sorted_ids_hash(F.col("x"))).first()[0] == hashlib.sha256(b"a\nb").hexdigest()


def test_folds_keep_entities_and_classes_even(spark):
    e = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)], "entity long, label boolean")
    f = selection.stratified_folds(e, 5)
    assert sorted(r["count"] for r in f.groupBy("label", "fold").count().collect()) == [4] * 5 + [8] * 5
    assert f.collect() == selection.stratified_folds(e, 5).collect()
    s = e.withColumn("source", F.when(F.col("entity") < 10, "A").otherwise("B"))
    assert {r["count"] for r in selection.top_of_strata(s, ["source", "label"], 3).groupBy("source", "label").count().collect()} == {3}


def test_files_and_logs(spark, tmp_path):
    d = tmp_path / "files" / "setA"
    d.mkdir(parents=True)
    (d / "p1.psv").write_text("t|x\n1|5\n2|NaN\n")
    got = src.read_psv(spark, str(tmp_path / "files"), ["t", "x"]).orderBy("t").collect()
    assert [(r.entity, r.x) for r in got] == [("setA:p1", "5"), ("setA:p1", None)]
    (tmp_path / "log").write_text("noise\nelapsed=12.5\nexit_code=0\n")
    assert {r.key: r.value for r in src.key_value_log(spark, str(tmp_path / "log")).collect()} == {"elapsed": "12.5", "exit_code": "0"}
    (tmp_path / "gpu.csv").write_text("utilization\n0 %\n50 %\n100 %\n")
    u = src.utilisation_log(spark, str(tmp_path / "gpu.csv")).first()
    assert (u.samples, u.active_samples, u.mean, u.active_mean, u.largest) == (3, 2, 50.0, 75.0, 100.0)
    with pytest.raises(ValueError, match="duplicate"):
        src.canonical_names(["Hct", "HCT"], ["Hct"], {"HCT": "Hct"})
    with pytest.raises(ValueError, match="missing"):
        src.canonical_names(["a"], ["a", "b"])


def test_harmonised_panels_fail_closed(spark, capsys):
    schema = "source string, entity string, row int, t string, x string, label string, age string"
    frame_of = lambda text, entity="s:e": spark.createDataFrame([("s", entity, k, *line.split("|")) for k, line in enumerate(text.split("\n"))], schema)
    good = frame_of("1|5|0|40\n2| NaN |0|\n9||1|40").union(frame_of("3|7|1|50", "s:f"))
    got = src.harmonised(good, ["x"], ["age"]).orderBy("entity", "t").collect()
    assert [(r.entity, r.t, r.x, r.age, r.label, r.status, r.onset) for r in got] == [
        ("s:e", 1.0, 5.0, 40.0, 0, "exact", 15.0), ("s:e", 2.0, None, None, 0, "exact", 15.0), ("s:e", 9.0, None, 40.0, 1, "exact", 15.0), ("s:f", 3.0, 7.0, 50.0, 1, "left_censored", None),
    ]
    for bad, what in (
        ("1|x|0|1", "numbers"), ("1|inf|0|1", "numbers"), ("1|5|0|1\n1|5|0|1", "increase"), ("1|5|1|1\n2|5|0|1", "fall back"), ("1|5|2|1", "0 and 1"), ("1|5||1", "0 and 1"),
        ("|5|0|1", "without a time"), ("1|5|0|1\n2|5|0|2", "static"),
    ):
        with pytest.raises(validate.Violation, match=what):
            src.harmonised(frame_of(bad), ["x"], ["age"])
    with pytest.raises(validate.Violation, match="twice"):
        src.harmonised(frame_of("1|5|0|1").union(frame_of("2|5|0|1")), ["x"], ["age"])
    cohort = lambda n: spark.createDataFrame([("s", 2, n)], "source string, entities long, rows long")
    assert src.harmonised(good, ["x"], ["age"], cohort=cohort(4)).count() == 4
    with pytest.raises(validate.Violation, match="another cohort"):
        src.harmonised(good, ["x"], ["age"], cohort=cohort(5))
    with pytest.raises(Exception, match="no source and entity"):
        spark.createDataFrame([("p1.psv",)], "name string").select(*src.source_and_entity(F.col("name"))).collect()


def test_runs_manifests_and_ledger(spark, tmp_path):
    from tidewell.sources import files, runs

    root = tmp_path / "run"
    root.mkdir()
    (root / "panel.csv").write_text("entity,x\n4,1.5\n,2\n")
    (root / "oof.csv").write_text("p\n0.5\n")
    now = files.file_hashes(spark, str(root))
    one, two = (runs.stage_manifest(now.filter(F.col("artifact").endswith(n)), s, str(root)) for n, s in (("panel.csv", "prepare"), ("oof.csv", "model")))
    stages = one.union(two)
    assert {(r.stage, r.artifact) for r in stages.collect()} == {("prepare", "panel.csv"), ("model", "oof.csv")}
    with pytest.raises(validate.Violation, match="outside"):
        runs.stage_manifest(now, "x", str(root / "deeper"))
    uses = spark.createDataFrame([("model", "prepare")], "stage string, uses string")
    nodes, edges = runs.lineage_of(stages, uses)
    assert [(r.node, r.input) for r in edges.collect()] == [("oof.csv", "panel.csv")]
    as_now = stages.select("artifact", "sha256")
    assert runs.promote(stages, as_now, uses, str(tmp_path / "final")).count() == 2
    with pytest.raises(Exception, match="(?i)already exists"):
        runs.promote(stages, as_now, uses, str(tmp_path / "final"))
    with pytest.raises(validate.Violation, match="use each other"):
        runs.promote(stages, as_now, uses.union(spark.createDataFrame([("prepare", "model")], "stage string, uses string")), str(tmp_path / "other"))
    with pytest.raises(validate.Violation, match="differ"):
        runs.promote(stages, as_now.withColumn("sha256", F.lit("0")), uses, str(tmp_path / "other"))
    got = runs.read_projection(spark, str(root / "panel.csv"), ["entity", "x"], ["entity"]).orderBy("x").collect()
    assert [(r.entity, r.x) for r in got] == [("4", 1.5), ("", 2.0)]
    with pytest.raises(ValueError, match="missing"):
        runs.read_projection(spark, str(root / "panel.csv"), ["y"])
    said = {r.name: r.value for r in runs.runtime_manifest(spark, "r1", AlarmPolicy()).collect()}
    assert said["policy.digest"] == digest(AlarmPolicy()) and "spark.version" in said
    for rows in ([("1", "submitted", ""), ("2", "submitted", "")], [("1", "done", "")]):
        runs.append_ledger(spark, str(tmp_path / "ledger"), rows)
    assert [r.job for r in runs.open_jobs(spark.read.parquet(str(tmp_path / "ledger"))).collect()] == ["2"]
    (tmp_path / "log").write_text("a=1\nb=2\n")
    assert src.key_value_log(spark, str(tmp_path / "log"), ["a", "b"]).count() == 2
    with pytest.raises(ValueError, match="keys differ"):
        src.key_value_log(spark, str(tmp_path / "log"), ["a"])


def test_policy_digest():
    assert digest(PanelPolicy()) == digest(PanelPolicy()) != digest(AlarmPolicy())


def test_feature_plan_has_one_exchange(three):
    plan = features.features(three, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
