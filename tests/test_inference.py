"""DeLong, isotonic calibration, the multinomial bootstrap and importances against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import inference as inf


def made(spark, n=300, seed=0, digits=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.3)
        a, b = (float(np.round(np.clip(r.normal(0.4 + s * y, 0.2), 0, 1), digits)) for s in (0.1, 0.2))
        rows.append((i // 3, i, float(y), float(r.choice([0.5, 1.0])), a, b))
    return rows, spark.createDataFrame(rows, "entity long, t long, y double, w double, a double, b double")


def test_delong_matches_all_pairs(spark):
    rows, df = made(spark)
    got = inf.delong(df.repartition(4), "a", "b").first()
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    wins = {s: np.array([[1.0 if p[s] > q[s] else 0.5 if p[s] == q[s] else 0.0 for q in neg] for p in pos]) for s in (4, 5)}
    d = wins[5] - wins[4]
    variance = d.mean(axis=1).var(ddof=1) / len(pos) + d.mean(axis=0).var(ddof=1) / len(neg)
    z = d.mean() / math.sqrt(variance)
    assert (got.positives, got.negatives) == (len(pos), len(neg))
    assert (got.auc_a, got.auc_b) == pytest.approx((wins[4].mean(), wins[5].mean()), abs=1e-6)
    assert got.variance == pytest.approx(variance, rel=1e-6) and got.z == pytest.approx(z, abs=1e-4) and got.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-5)
    same = inf.delong(df.withColumn("b", F.col("a")), "a", "b").first()
    assert same.auc_a == same.auc_b and same.z is None and same.p_value is None


def sequential(points):
    blocks = []
    for p, w, wy in points:
        blocks.append([p, p, w, wy])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            q = blocks.pop()
            blocks[-1] = [blocks[-1][0], q[1], blocks[-1][2] + q[2], blocks[-1][3] + q[3]]
    return [(a, b, pytest.approx(w), pytest.approx(wy / w)) for a, b, w, wy in blocks]


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_blocks_match_one_sequential_pass(spark, seed):
    rows, df = made(spark, 500, seed, 3)
    df = df.withColumn("p", F.col("b"))
    at = {}
    for r in rows:
        w, wy = at.get(r[5], (0.0, 0.0))
        at[r[5]] = (w + r[3], wy + r[3] * r[2])
    want = sequential([(p, *at[p]) for p in sorted(at)])
    blocks = inf.isotonic_blocks(df, parts=40 if seed else 1)
    assert [tuple(r) for r in blocks.orderBy("low").collect()] == want
    if seed == 1:
        lows, values = zip(*[(r.low, r.value) for r in blocks.orderBy("low").collect()])
        asked = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0.0, 1.0, *np.random.default_rng(5).random(200), *lows])], "i long, p double")
        for r in inf.isotonic(asked, blocks).collect():
            k = np.searchsorted(lows, r.p, side="right") - 1
            assert r.p_isotonic == pytest.approx(values[max(k, 0)])


def test_every_replicate_draws_as_many_entities_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(inf, "BUCKET", 40)
    e = spark.createDataFrame([(i, int(i < 3)) for i in range(200)], "entity long, label int")
    got = inf.multinomial_copies(e.repartition(5), 200, 7).collect()
    per = {}
    for r in got:
        per.setdefault(r.rep, {})[r.entity] = r.copies
    assert set(per) == set(range(1, 201)) and all(sum(c.values()) == 200 for c in per.values())
    assert all(any(i < 3 for i in c) for c in per.values())  # replicates without a positive were drawn again
    all_ = np.array([[per[r].get(i, 0) for i in range(200)] for r in per])
    assert abs(all_[:, 3:].mean() - 1) < 0.02 and abs(all_[:, 3:].var() - 1) < 0.05
    assert abs(np.corrcoef(all_[:, 50], all_[:, 51])[0, 1]) < 0.25
    again = inf.multinomial_copies(e.coalesce(1), 200, 7)
    assert {(r.entity, r.rep, r.copies) for r in again.collect()} == {(r.entity, r.rep, r.copies) for r in got}


def test_a_replicate_that_never_has_both_labels_is_left_out(spark):
    e = spark.createDataFrame([(i, 0) for i in range(9)], "entity long, label int")
    assert inf.multinomial_copies(e, 3, 1).isEmpty()


def test_paired_bootstrap_matches_its_draws(spark):
    rows, df = made(spark, 150)
    got = {r.figure: r for r in inf.paired_bootstrap(df, ("a", "b"), 20, 3).collect()}
    copies = {}
    for r in inf.multinomial_copies(df.groupBy("entity").agg(F.max("y").cast("int").alias("label")), 20, 3).collect():
        copies.setdefault(r.rep, {})[r.entity] = r.copies

    def figures(c):
        out = {}
        for name, s in (("a", 4), ("b", 5)):
            w = np.array([r[3] * c.get(r[0], 0) for r in rows])
            y, p = np.array([r[2] for r in rows]), np.array([r[s] for r in rows])
            tp = np.array([(w * y)[p >= x].sum() for x in p])
            fp = np.array([(w * (1 - y))[p >= x].sum() for x in p])
            with np.errstate(invalid="ignore"):
                out[f"ap_{name}"] = np.nansum(w * y * tp / (tp + fp)) / (w * y).sum()
            out[f"brier_{name}"] = (w * (y - p) ** 2).sum() / w.sum()
        return out | {f"{f}_difference": out[f"{f}_b"] - out[f"{f}_a"] for f in ("ap", "brier")}

    one = figures({i: 1 for i in range(50)})
    each = [figures(c) for c in copies.values()]
    for f, r in got.items():
        x = [e[f] for e in each]
        assert r.reps == 20 and r.estimate == pytest.approx(one[f], abs=2e-6)
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(x, [0.025, 0.975])), abs=2e-6)


def test_permuted_columns_and_importances(spark):
    df = spark.range(400).select(F.col("id").alias("entity"), F.lit(1).alias("t"), (F.col("id") % 4).alias("g"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("w"))
    out = inf.shuffled(df.withColumn("x", F.col("id") if "id" in df.columns else F.col("entity").cast("double")), "x", 5, "g").collect()
    assert sorted(r.x for r in out) == list(range(400)) and all(r.x % 4 == r.g for r in out) and sum(r.x == r.entity for r in out) < 20
    got = inf.importances(df, ["x", "z"], lambda rows: 0.1 + 0.8 * F.col("x") + 0.0 * F.col("z"), inf.log_loss, 3).collect()
    assert [r.input for r in got] == ["x", "z"] and got[0].rise > 0.5 and got[1].rise == 0
