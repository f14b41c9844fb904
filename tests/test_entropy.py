"""Sample entropy by the sweep against all pairs of templates."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars
from tidewell.operators import entropy


def by_pairs(x, m=2, share=0.2):
    if len(x) < m + 2:
        return None
    r, t = share * np.std(x), [x[i : i + m + 1] for i in range(len(x) - m)]
    pairs = [np.abs(np.array(a) - b) <= r for i, a in enumerate(t) for b in t[i + 1 :]]
    b, a = sum(p[:-1].all() for p in pairs), sum(p.all() for p in pairs)
    return None if not b else math.inf if not a else -math.log(a / b)


@pytest.mark.parametrize("block", [7, 4096])
def test_sweep_matches_all_pairs(spark, block):
    r = np.random.default_rng(3)
    series = {1: r.normal(size=120), 2: r.integers(0, 3, 90).astype(float), 3: np.full(20, 4.0), 4: np.array([1.0, 2.0, 3.0]), 5: np.array([1.0, 5.0, 9.0, 40.0, 2.0, 7.0]), None: r.normal(size=40) * 1e6}
    rows = [(e, t, float(v)) for e, x in series.items() for t, v in enumerate(x)] + [(1, 500, None), (1, 501, float("nan"))]
    df = spark.createDataFrame(rows, "entity long, t long, v double").repartition(4)
    got = {x.entity: (x.n, x.sample_entropy) for x in entropy.sample_entropies(df, block=block).collect()}
    assert set(got) == set(series)
    for e, x in series.items():
        want = by_pairs(x.tolist())
        assert got[e] == (len(x), want if want is None or math.isinf(want) else pytest.approx(want, rel=1e-12))
    assert entropy.sample_entropies(df.limit(0)).count() == 0


def test_a_long_series(spark):
    """30,000 points: some 70 million comparisons in blocks, against plain counting of the first coordinate's window."""
    x = np.random.default_rng(4).normal(size=30_000)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "entity long, t long, v double")
    got = entropy.sample_entropies(df).first()
    assert got.n == 30_000 and 2.0 < got.sample_entropy < 2.4  # white noise of this tolerance: -ln(erf(0.1)) = 2.18


def test_equal_templates_fold(spark):
    """Copies of few values: 100,000 points are 64 templates, where pairs would be five thousand million."""
    x = np.random.default_rng(5).integers(0, 4, 100_000).astype(float)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "entity long, t long, v double")
    began = time.monotonic()
    got = entropy.sample_entropies(df).first()
    pairs = [sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.lib.stride_tricks.sliding_window_view(x, 3)[:, :k], axis=0, return_counts=True)[1]) for k in (2, 3)]
    assert (got.n, got.sample_entropy) == (100_000, pytest.approx(-math.log(pairs[1] / pairs[0]), rel=1e-12))
    assert time.monotonic() - began < 60


def test_chunks_of_a_cell_meet_once(spark):
    x = np.round(np.random.default_rng(7).exponential(size=500), 2)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "entity long, t long, v double")
    assert entropy.sample_entropies(df, block=1).first().sample_entropy == pytest.approx(by_pairs(x.tolist()), rel=1e-12)


def test_one_row_series_work_out_their_tolerance_once(spark):
    x = np.random.default_rng(6).normal(size=200)
    began = time.monotonic()
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(scalars.sample_entropy(F.col("v"))).first()[0]
    assert got == pytest.approx(by_pairs(x.tolist()), rel=1e-12) and time.monotonic() - began < 20


@pytest.mark.parametrize("columns", [2, 3, 4])
def test_counted_pairs_are_the_compared_ones(monkeypatch, columns):
    r = np.random.default_rng(columns)
    made = {0.5: lambda n: r.normal(size=(n, columns)), 3.0: lambda n: r.integers(0, 30, (n, columns)).astype(float), 0.3: lambda n: np.round(r.exponential(size=(n, columns)), 1)}
    for near, rows in made.items():
        for n, m in ((1, 500), (300, 7), (400, 600)):
            a, b, x, y = rows(n), rows(m), r.integers(1, 4, n), r.integers(1, 4, m)
            want = entropy.compared(a, x, b, y, near)
            with monkeypatch.context() as some:
                some.setattr(entropy, "PAIRS", 16)
                some.setattr(entropy, "LEAF", 8)
                assert entropy.met(a, x, b, y, near) == want


def test_long_cells_are_counted_in_less_than_their_pairs():
    """Two corners of 60,000 templates: 3.6 thousand million pairs."""
    r = np.random.default_rng(8)
    a, b, one = r.uniform(0, 1, (60_000, 3)), r.uniform(0, 1, (60_000, 3)) + [1, 1, 0], np.ones(60_000, np.int64)
    began = time.monotonic()
    short, long = entropy.met(a, one, b, one, 1.0)
    assert time.monotonic() - began < 10
    ordered = np.sort(b[:, 0] - 1)
    alone = entropy.met(np.c_[a[:, :1], a[:, :1]], one, np.c_[b[:, :1], b[:, :1]], one, 1.0)
    assert alone == (np.searchsorted(ordered, a[:, 0], side="right").sum(),) * 2 and long == short < alone[0]  # the third column always matches
