"""Checks that return the rows in violation; `enforce` fails on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.shared import delete, new_path, stored


class Violation(ValueError):
    pass


def enforce(violations: DataFrame, what: str) -> None:
    rows = violations.limit(3).collect()  # a report, not the data
    if rows:
        raise Violation(f"{what}: {[r.asDict() for r in rows]}")


def checks(rules: dict[str, Column], show: list[str]) -> list[Column]:
    """Aggregates for `report`: how many rows break each rule, and the least of them."""
    out = []
    for i, broken in enumerate(rules.values()):
        out += [F.count(F.when(broken, 1)).alias(f"n{i}"), F.min(F.when(broken, F.struct(*show))).alias(f"x{i}")]
    return out


def report(found: dict, rules: dict[str, Column]) -> None:
    said = [f"{name}: {found[f'n{i}']} rows, such as {found[f'x{i}'].asDict()}" for i, name in enumerate(rules) if found[f"n{i}"]]
    if said:
        raise Violation("; ".join(said))


def stored_if(df: DataFrame, rules: dict[str, Column], show: list[str], name: str) -> DataFrame:
    """df, stored, unless a row breaks a rule: all rules are counted in the job that writes df. A broken table is deleted."""
    seen, path = Observation(name), new_path(df.sparkSession, name)
    out = stored(df.observe(seen, *checks(rules, show)), name, path)
    try:
        report(seen.get, rules)
    except Violation:
        delete(df.sparkSession, path)
        raise
    return out


def not_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of observed cells that are no finite numbers."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    number = F.expr("try_cast(value AS double)")
    return cells.filter(F.col("value").isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns as doubles; NaN becomes null, other bad cells must have been ruled out."""
    return df.withColumns({c: F.expr(f"nullif(try_cast({c} AS double), double('NaN'))") for c in columns})


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def out_of_order(df: DataFrame, by: str, key: str = "entity", time: str = "t") -> DataFrame:
    """Rows whose time does not exceed the one before them in `by` order."""
    w = W.partitionBy(key).orderBy(by)
    return df.withColumn("previous", F.lag(time).over(w)).filter(F.col(time) <= F.col("previous"))


def label_drops(df: DataFrame, key: str = "entity", time: str = "t", label: str = "label") -> DataFrame:
    w = W.partitionBy(key).orderBy(time)
    return df.withColumn("previous", F.lag(label).over(w)).filter(F.col("previous") > F.col(label))


def not_in(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def not_constant(df: DataFrame, column: str, key: str = "entity") -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(column).alias("values")).filter("values > 1")


def not_probability(df: DataFrame, column: str) -> DataFrame:
    p = F.col(column)
    return df.filter(p.isNull() | F.isnan(p) | ~p.between(0, 1))


def cohort_identity(panel: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources whose entities or rows differ from expected (source, entities, rows)."""
    got = panel.groupBy("source").agg(F.countDistinct("entity").alias("got_entities"), F.count("*").alias("got_rows"))
    return expected.join(got, "source", "full_outer").filter(~(F.col("entities").eqNullSafe(F.col("got_entities")) & F.col("rows").eqNullSafe(F.col("got_rows"))))


def fold_violations(panel: DataFrame, folds: DataFrame, n: int) -> DataFrame:
    """(entity, what): entities without a fold, folds without an entity, several folds, folds that are no whole number below n, other labels.

    panel: entity and label by row; folds: entity, label and fold. What is found first is named.
    """
    ids = panel.groupBy("entity").agg(F.max("label").alias("want"))
    fold = F.col("fold").cast("double")
    per = folds.groupBy("entity").agg(
        F.count("*").alias("n"), F.min("label").alias("label"), F.max(F.when((fold == F.floor(fold)) & fold.between(0, n - 1), 0).otherwise(1)).alias("bad"),
    )
    what = (
        F.when(F.col("n").isNull(), "no fold").when(F.col("want").isNull(), "unknown entity").when(F.col("n") > 1, "several folds")
        .when(F.col("bad") == 1, "no such fold").when(~F.col("want").eqNullSafe(F.col("label")), "other label")
    )
    return ids.join(per, "entity", "full_outer").select("entity", what.alias("what")).filter("what IS NOT NULL")


def without_rows(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of expected that have no row at all."""
    return expected.select(key).distinct().join(rows.select(F.col(key)).distinct(), key, "left_anti")


def longitudinal_violations(df: DataFrame, key: str = "entity", time: str = "t", label: str = "label", by: str | None = None) -> DataFrame:
    """(entity, t, what): rows whose time does not exceed the one before in `by` order (default: time), and labels that fall back."""
    late = out_of_order(df, by or time, key, time).select(key, time, F.lit("order").alias("what"))
    return late.unionByName(label_drops(df, key, time, label).select(key, time, F.lit("label").alias("what")))


def thin_classes(rows: DataFrame, by: list[str], label: str, least: int = 2) -> DataFrame:
    """Groups that hold fewer than `least` rows of label 0 or of label 1."""
    n = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0))
    return rows.groupBy(*by).agg(n(0).alias("zeros"), n(1).alias("ones")).filter((F.col("zeros") < least) | (F.col("ones") < least))


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule a row breaks; a rule that is neither true nor false is broken. One pass for all rules."""
    broken = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left join, after one job that checks that right has each key once and every row of left finds one."""
    times = right.groupBy(*keys).agg(F.count("*").alias("_n"))
    met = left.select(*keys, F.lit(True).alias("_left")).join(times, keys, "full_outer")
    rules = {f"keys {keys} are not unique": F.col("_n") > 1, f"rows without a match on {keys}": F.col("_n").isNull()}
    report(met.agg(*checks(rules, keys)).first().asDict(), rules)
    return left.join(right, keys, "left")


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a and b side by side, after one job that checks that both have the same keys, each once."""
    if clash := (set(a.columns) & set(b.columns)) - set(keys):
        raise Violation(f"columns of both sides: {sorted(clash)}")
    n = [x.groupBy(*keys).agg(F.count("*").alias(c)) for x, c in ((a, "_a"), (b, "_b"))]
    rules = {f"keys {keys} are not unique": (F.col("_a") > 1) | (F.col("_b") > 1), "the two sides hold other keys": F.col("_a").isNull() | F.col("_b").isNull()}
    report(n[0].join(n[1], keys, "full_outer").agg(*checks(rules, keys)).first().asDict(), rules)
    return a.join(b, keys)


def with_predictions(rows: DataFrame, predictions: DataFrame, keys: list[str], probabilities: list[str]) -> DataFrame:
    """rows with prediction columns: new names only, the same keys, probabilities in [0, 1]."""
    bad = {f"{p} is no probability": F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1) for p in probabilities}
    report(predictions.agg(*checks(bad, [*keys, *probabilities])).first().asDict(), bad)
    return paired(rows, predictions, keys)


def frame_differences(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 0.0) -> DataFrame:
    """Rows of either frame without an equal one in the other; numbers may differ by rtol of b's."""
    values = [c for c in a.columns if c not in keys]
    kinds = dict(a.dtypes)
    y = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_in_b"))
    both = a.withColumn("_in_a", F.lit(True)).join(y, keys, "full_outer")
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for c in values:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        if rtol and kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= rtol * F.abs(F.col(f"_{c}")), F.lit(False))
        differs = differs | ~same
    return both.filter(differs)
