"""Column expressions: logit, bins, entropies, weights, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-6


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def logit(p: Column) -> Column:
    q = clip(p, TINY, 1 - TINY)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -50.0, 50.0)))


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin of a probability; 1 falls in the last bin."""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def equal_entity_weight(key: str = "entity") -> Column:
    return 1 / F.count("*").over(W.partitionBy(key))


def class_balanced(rows: DataFrame, weight: str, target: str, out: str = "w", mass: float = 1.0) -> DataFrame:
    """rows with `out`: weight scaled so that each class of target has half of `mass`. The classes' sums (0, 1 or null: three rows) are broadcast; rows stay."""
    sums = rows.groupBy(F.col(target).alias("_class")).agg(F.sum(weight).alias("_mass"))
    joined = rows.join(F.broadcast(sums), rows[target].eqNullSafe(sums["_class"]), "left")
    return joined.withColumn(out, F.lit(mass) * F.col(weight) / (2 * F.col("_mass"))).drop("_class", "_mass")


def millionths(x: Column) -> Column:
    """x as a whole number of millionths; exact for numbers given with six digits."""
    return F.round(x * 1_000_000).cast("long")


def whole_ratio(a: Column, b: Column) -> Column:
    """a / b of whole numbers, b above 0, to the nearest whole, halves away from 0, in whole arithmetic: the same in every engine."""
    return (F.signum(a).cast("long") * F.call_function("div", 2 * F.abs(a) + b, 2 * b)).cast("long")


def text_hash(*cols: Column) -> Column:
    """A 60-bit integer from md5, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) from text_hash."""
    return text_hash(*cols) / F.lit(float(1 << 60))


def poisson_count(u: Column, most: int = 8) -> Column:
    """How many copies a unit gets in one Poisson(1) bootstrap draw, from a uniform number."""
    import math

    cumulative, out = 0.0, F.lit(0)
    for k in range(most):
        cumulative += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= cumulative, 1).otherwise(0)
    return out


def lifted(x: Column) -> Column:
    """[x, products x_a * x_b for a <= b] of an array column."""
    pairs = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda b: a * b)))
    return F.concat(x, pairs)


def sorted_ids_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


def shannon_entropy(values: Column, bins: int = 10) -> Column:
    """Natural-log entropy of an array's equal-width histogram; constant: 0, empty: null."""
    lo, hi = F.array_min(values), F.array_max(values)
    at = F.transform(values, lambda v: F.least(F.floor((v - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1)))
    share = lambda k: F.size(F.filter(at, lambda b: b == k)) / F.size(values)
    terms = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.when(share(k) > 0, -share(k) * F.log(share(k))).otherwise(0.0))
    return F.when(F.size(values) == 0, None).when(lo == hi, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def sample_entropy(values: Column, m: int = 2, share: float = 0.2) -> Column:
    """-ln(A/B) of matching (m+1)- and m-templates over common starts; no m-match: null, no longer match: infinity.

    The tolerance is `share` of the population standard deviation; templates match within it in
    every place.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  # works x out once, not at each use
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    tolerance = let(mean, lambda u: share * F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - u) * (x - u)) / n))
    starts = F.sequence(F.lit(0), n - m - 1)

    def matches(length: int, r: Column) -> Column:
        def close(i: Column, j: Column) -> Column:
            out = F.lit(True)
            for k in range(length):
                out = out & (F.abs(F.get(values, i + k) - F.get(values, j + k)) <= r)
            return out

        return F.aggregate(starts, F.lit(0), lambda a, i: a + F.size(F.filter(starts, lambda j: (j > i) & close(i, j))))

    counts = let(tolerance, lambda r: F.struct(matches(m, r).alias("b"), matches(m + 1, r).alias("a")))
    b, a = (lambda c: c["b"]), (lambda c: c["a"])
    figure = let(counts, lambda c: F.when(b(c) == 0, None).when(a(c) == 0, F.lit(float("inf"))).otherwise(-F.log(a(c) / b(c))))
    return F.when(n < m + 2, None).otherwise(figure)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with sorted names; a number that is not finite is null, and nulls are written."""
    finite = lambda c: F.when(~c.cast("string").isin("NaN", "Infinity", "-Infinity"), c)
    return F.to_json(F.struct(*[finite(c).alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
