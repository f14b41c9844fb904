"""Weighted ranking, calibration and reliability metrics over (y, p, w) rows, with optional groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import TINY, bin_of, logit, sigmoid
from tidewell.operators import replicates

DIGITS = 6


def score_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positive and negative weight at each distinct score, with running sums from the highest down.

    Rows fold into distinct scores before any ordering; per group of `by` the running sums go
    over distinct scores alone.
    """
    by = by or []
    tied = rows.groupBy(*by, "p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    down = W.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by)
    return tied.withColumns({
        "tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "all_pos": F.sum("pos").over(every), "all_neg": F.sum("neg").over(every),
    })


def ranking(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision, AUROC (ties count half) and trapezoidal PR area; ties are one step."""
    by = by or []
    g = score_groups(rows, by)
    down = W.partitionBy(*by).orderBy(F.desc("p"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    g = g.withColumn("precision", precision).withColumn("recall", F.try_divide("tp", "all_pos"))
    g = g.withColumns({"p0": F.coalesce(F.lag("precision").over(down), F.lit(1.0)), "r0": F.coalesce(F.lag("recall").over(down), F.lit(0.0))})
    ap = F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("all_pos"))
    auc = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max("all_pos") * F.max("all_neg"))
    area = F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2)
    aggs = [F.round(ap, DIGITS).alias("ap"), F.round(auc, DIGITS).alias("auroc"), F.round(area, DIGITS).alias("pr_area")]
    return g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)


def brier(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    err = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))
    agg = F.round(F.sum(F.col("w") * err) / F.sum("w"), DIGITS).alias("brier")
    return rows.groupBy(*by).agg(agg) if by else rows.agg(agg)


def performance(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    r, b = ranking(rows, by), brier(rows, by)
    return r.join(b, by) if by else r.crossJoin(b)  # one row each


def roc_points(rows: DataFrame) -> DataFrame:
    g = score_groups(rows)
    return g.select(F.col("p").alias("threshold"), F.round(F.try_divide("tp", "all_pos"), DIGITS).alias("tpr"), F.round(F.try_divide("fp", "all_neg"), DIGITS).alias("fpr"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row for each bin, empty ones too: weight, mean p and mean y."""
    w = rows.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("p")).alias("wp"), F.sum(F.col("w") * F.col("y")).alias("wy"),
    )
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    j = spine.join(w, "bin", "left")
    return j.select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("weight", F.lit(0.0)), DIGITS).alias("weight"),
        F.round(F.try_divide("wp", "weight"), DIGITS).alias("mean_p"), F.round(F.try_divide("wy", "weight"), DIGITS).alias("mean_y"),
    )


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = rows.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * (F.col("p") - F.col("y"))).alias("gap"))
    return b.agg(F.round(F.sum(F.abs("gap")) / F.sum("weight"), DIGITS).alias("ece"))


def calibration_offset(rows: DataFrame, steps: int = 30, tol: float = 1e-10) -> float:
    """Calibration in the large: the offset on the logit at which mean prediction meets the mean outcome (Newton)."""
    z, a = rows.select(logit(F.col("p")).alias("z"), "y", "w").persist(), 0.0
    try:
        for _ in range(steps):
            q = sigmoid(F.col("z") + F.lit(a))
            g, h = z.agg(F.sum(F.col("w") * (F.col("y") - q)), F.sum(F.col("w") * q * (1 - q))).first()
            step = g / h if h else 0.0
            a += step
            if abs(step) < tol:
                break
    finally:
        z.unpersist()
    return a


def logistic_line(rows: DataFrame, steps: int = 30, tol: float = 1e-10) -> tuple[float, float]:
    """(intercept, slope) of the weighted logistic regression of y on logit(p), unpenalised (Newton on sums; a step that raises the loss is halved)."""
    z = rows.select(logit(F.col("p")).alias("z"), "y", "w").persist()
    a, b, da, db, least = 0.0, 1.0, 0.0, 0.0, float("inf")
    try:
        for _ in range(steps):
            q = sigmoid(F.lit(a) + F.lit(b) * F.col("z"))
            v, e = F.col("w") * q * (1 - q), F.col("w") * (F.col("y") - q)
            own = F.col("w") * -F.log(F.greatest(F.when(F.col("y") > 0, q).otherwise(1 - q), F.lit(1e-300)))
            g0, g1, h0, h1, h2, loss = z.agg(F.sum(e), F.sum(e * F.col("z")), F.sum(v), F.sum(v * F.col("z")), F.sum(v * F.col("z") * F.col("z")), F.sum(own)).first()
            if loss > least * (1 + 1e-9):
                da, db = da / 2, db / 2
                a, b = a - da, b - db
                continue
            least = loss
            det = h0 * h2 - h1 * h1
            if det <= 1e-12 * h0 * max(h2, 1e-300):
                raise ValueError("the logits are constant: no slope can be fitted")
            da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
            a, b = a + da, b + db
            if max(abs(da), abs(db)) < tol:
                break
    finally:
        z.unpersist()
    return a, b


def calibration_intervals(rows: DataFrame, reps: int, seed: int, bins: int = 10, digits: int = 6) -> DataFrame:
    """ECE, offset, intercept and slope with percentile intervals by entity-cluster bootstrap: figure, estimate, low, high.

    Rows (entity, y, p, w) fold to (entity, rounded p); each replicate then sums entities to its distinct
    scores, at most 10**digits rows, and one Arrow call fits it by Newton steps. Replicate 0 is the estimate.
    A replicate that lacks a class has no figures, one whose scores part the classes no line; both are left out.
    """
    folded = rows.groupBy("entity", F.round("p", digits).alias("p")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    copies = folded.select("entity").distinct().withColumn("copies", F.concat(F.array(F.lit(1).cast("smallint")), replicates.poisson_copies(reps, seed)))
    per = replicates.by_replicate(replicates.sums_by_key(folded, copies, ["p"], ["w", "wy"]), "p", ["w", "wy"])
    figures = ("ece", "offset", "intercept", "slope")

    def fit(t: pa.Table) -> pa.Table:
        got = calibration_of(*(t.column(c).to_numpy() for c in ("p", "w", "wy")), bins)
        return pa.table({"rep": t.column("rep").slice(0, 1), **{f: pa.array([v], pa.float64()) for f, v in zip(figures, got)}})

    each = per.groupBy("rep").applyInArrow(fit, "rep int, " + ", ".join(f"{f} double" for f in figures)).unpivot("rep", list(figures), "figure", "value")
    ends = [F.round(F.percentile(F.when(F.col("rep") > 0, F.col("value")), F.lit(q)), DIGITS).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]
    return each.groupBy("figure").agg(F.round(F.max(F.when(F.col("rep") == 0, F.col("value"))), DIGITS).alias("estimate"), *ends)


def calibration_of(p: np.ndarray, w: np.ndarray, wy: np.ndarray, bins: int) -> tuple[float | None, ...]:
    """(ECE, offset, intercept, slope) of scores p with weight w, of which wy is positive; Nones where a class is missing."""
    if not 0 < wy.sum() < w.sum():
        return (None,) * 4
    at = np.minimum((p * bins).astype(int), bins - 1)
    ece = np.abs(np.bincount(at, w * p - wy, bins)).sum() / w.sum()
    q = np.clip(p, TINY, 1 - TINY)
    z = np.log(q / (1 - q))
    mean = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    offset = 0.0
    for _ in range(50):
        m = mean(z + offset)
        step = (wy - w * m).sum() / (w * m * (1 - m)).sum()
        offset += step
        if abs(step) < 1e-10:
            break
    x, beta = np.c_[np.ones(len(z)), z], np.array([0.0, 1.0])
    for _ in range(50):
        m = mean(x @ beta)
        h = (x * (w * m * (1 - m))[:, None]).T @ x
        if np.linalg.det(h) <= 1e-12 * h[0, 0] * max(h[1, 1], 1e-300):
            return float(ece), float(offset), None, None
        step = np.linalg.solve(h, x.T @ (wy - w * m))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return float(ece), float(offset), float(beta[0]), float(beta[1])
        if np.abs(beta).max() > 1e4:  # scores that part the classes have no finite line
            break
    return float(ece), float(offset), None, None


def choose_calibration(rows: DataFrame) -> tuple[str, float, float]:
    """('logistic', a, b) if it lowers the weighted Brier score, else ('identity', 0, 1). Scores that are all alike have no line: they stay."""
    p = F.col("p")
    low, high = rows.agg(F.min(logit(p)), F.max(logit(p))).first()
    if low is not None and low == high:
        return "identity", 0.0, 1.0
    a, b = logistic_line(rows)
    mapped = sigmoid(F.lit(a) + F.lit(b) * logit(p))
    err = lambda q: F.sum(F.col("w") * (F.col("y") - q) * (F.col("y") - q)) / F.sum("w")
    before, after = rows.agg(err(p), err(mapped)).first()
    return ("logistic", a, b) if after < before else ("identity", 0.0, 1.0)


def calibrated(p: Column, choice: tuple[str, float, float]) -> Column:
    kind, a, b = choice
    return p if kind == "identity" else sigmoid(F.lit(a) + F.lit(b) * logit(p))
