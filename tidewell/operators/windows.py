"""Causal windows over (entity, t): no frame reaches past the current row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.scalars import shannon_entropy

KEY, TIME = "entity", "t"


def order():
    return W.partitionBy(KEY).orderBy(TIME)


def so_far():
    return order().rowsBetween(W.unboundedPreceding, 0)


def strictly_before():
    return order().rowsBetween(W.unboundedPreceding, -1)


def hours(n: int):
    """The half-open frame (t - n, t] on whole hours."""
    return order().rangeBetween(-(n - 1), 0)


def fine_hours(n: int, scale: int = 1_000_000):
    """(t - n, t] for fractional hours, on a key of t * scale."""
    key = F.round(F.col(TIME) * scale).cast("long")
    return W.partitionBy(KEY).orderBy(key).rangeBetween(-(n * scale - 1), 0)


def carried(x: str, frame=None) -> Column:
    return F.last(x, ignorenulls=True).over(frame or so_far())


def observed_at(x: str, frame=None) -> Column:
    return F.last(F.when(F.col(x).isNotNull(), F.col(TIME)), ignorenulls=True).over(frame or so_far())


def observation_age(x: str) -> Column:
    return F.col(TIME) - observed_at(x)


def last_observation(x: str, max_age: int = 24) -> Column:
    return F.when(observation_age(x) <= max_age, carried(x))


def previous_state(x: str, max_age: int = 24) -> tuple[Column, Column]:
    """(last value strictly before, null beyond max_age; its age, clipped at max_age)."""
    age = F.col(TIME) - observed_at(x, strictly_before())
    return F.when(age <= max_age, carried(x, strictly_before())), F.when(age > max_age, max_age).otherwise(age)


def previous_exists() -> Column:
    return F.lag(TIME).over(order()).isNotNull()


def delta_and_slope(x: str) -> tuple[Column, Column]:
    """Change since the last observed value, and by the hour; null where x is not observed."""
    change, since = change_and_hours(x)
    return change, change / since


def change_and_hours(x: str) -> tuple[Column, Column]:
    """Change since the last observed value, and the hours since then."""
    return F.col(x) - carried(x, strictly_before()), F.col(TIME) - observed_at(x, strictly_before())


def rolling(x: str, n: int, what: str, least: int = 2) -> Column:
    """mean, std (sample), iqr (linear quantiles), max, entropy (natural log, ten equal bins) over (t - n, t]; null below `least` observations."""
    w = hours(n)
    stat = {
        "mean": lambda: F.avg(x).over(w),
        "std": lambda: F.stddev_samp(x).over(w),
        "iqr": lambda: F.expr(f"percentile({x}, 0.75)").over(w) - F.expr(f"percentile({x}, 0.25)").over(w),
        "max": lambda: F.max(x).over(w),
        "entropy": lambda: shannon_entropy(F.collect_list(x).over(w)),  # a frame's values, never a timeline's
    }[what]()
    return F.when(F.count(x).over(w) >= least, stat)


def coefficient_of_variation(x: str, n: int) -> Column:
    return F.try_divide(rolling(x, n, "std"), F.abs(rolling(x, n, "mean")))


def rising_edge(positive: Column) -> Column:
    return positive & ~F.coalesce(F.lag(positive).over(order()), F.lit(False))


def refractory(times: Column, gap: int) -> Column:
    """Of an array of times in order, those accepted: the first, then each at least gap after the last accepted."""
    kind = "array<bigint>"
    return F.aggregate(
        times, F.array().cast(kind),
        lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= gap), F.concat(a, F.array(x.cast("bigint")))).otherwise(a),
    )
