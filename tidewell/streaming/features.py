"""Causal features over a stream of hourly rows that come late and out of order, equal to the batch ones.

A row waits until the watermark has passed its time; no earlier row of its entity can come then, and
its features are final. State for an entity is what waits, the last 8 hours and the last value of each
signal; a timer clears it when a day without rows has made all of it useless. Needs the RocksDB
state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators import windows
from tidewell.policy import TargetPolicy
from tidewell.sources.panel import EPOCH, hours_since

HOUR = 3_600_000
STATE = "waiting_t array<long>, waiting array<array<double>>, recent_t array<long>, recent array<array<double>>, last_t array<long>, last array<double>"
FIGURES = ("last", "age", "mean_8h", "std_8h", "max_8h")


def figure_names(signals: list[str]) -> list[str]:
    return [f"{f}__{s}" for s in signals for f in FIGURES]


def millis(t: int) -> int:
    """Milliseconds since 1970 at the start of the t-th hour since the epoch of hours_since."""
    return int(datetime.fromisoformat(EPOCH).replace(tzinfo=UTC).timestamp() * 1000) + (t - 1) * HOUR


class CausalFeatures(StatefulProcessor):
    def __init__(self, signals: list[str], policy: TargetPolicy):
        self.signals, self.most, self.frame = signals, policy.last_observation_age, policy.rolling_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("features", STATE)

    def held(self) -> tuple[dict, dict, list, list]:
        """(rows that wait by hour, rows of the frame by hour, last hours, last values)."""
        if not self.state.exists():
            return {}, {}, [None] * len(self.signals), [None] * len(self.signals)
        waiting_t, waiting, recent_t, recent, last_t, last = self.state.get()
        return dict(zip(waiting_t, waiting)), dict(zip(recent_t, recent)), list(last_t), list(last)

    def keep(self, waiting: dict, recent: dict, last_t: list, last: list) -> None:
        lists = lambda d: [None if v is None else [None if x is None else float(x) for x in v] for v in d.values()]
        self.state.update((list(waiting), lists(waiting), list(recent), lists(recent), last_t, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting, recent, last_t, last = self.held()
        new = set()
        for frame in rows:
            for t, *values in frame[["t", *self.signals]].itertuples(index=False):
                waiting[int(t)] = [None if pd.isna(v) else float(v) for v in values]  # the last of rows for one hour counts
                new.add(int(t))
        self.keep(waiting, recent, last_t, last)
        for t in new:
            self.handle.registerTimer(millis(t))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, recent, last_t, last = self.held()
        out = []
        for t in sorted(t for t in waiting if millis(t) <= passed):
            values = waiting.pop(t)
            recent[t] = values
            recent = {h: v for h, v in recent.items() if h > t - self.frame}
            last_t = [t if v is not None else h for v, h in zip(values, last_t)]
            last = [x if v is None else v for v, x in zip(values, last)]
            out.append((key[0], t, *self.figures(t, recent, last_t, last)))
        newest = max([*waiting, *recent], default=None)
        if not waiting and (newest is None or millis(newest + self.most) < passed):
            self.state.clear()
        else:
            self.keep(waiting, recent, last_t, last)
            if not waiting:
                self.handle.registerTimer(millis(newest + self.most) + HOUR)
        if out:
            yield pd.DataFrame(out, columns=["entity", "t", *figure_names(self.signals)]).astype({"entity": "int64", "t": "int64"} | dict.fromkeys(figure_names(self.signals), "float64"))

    def figures(self, t: int, recent: dict, last_t: list, last: list) -> list[float | None]:
        out: list[float | None] = []
        for i in range(len(self.signals)):
            age = None if last_t[i] is None or t - last_t[i] > self.most else t - last_t[i]
            seen = [v[i] for v in recent.values() if v[i] is not None]
            many = len(seen) >= 2
            out += [None if age is None else last[i], age, float(np.mean(seen)) if many else None, float(np.std(seen, ddof=1)) if many else None, max(seen) if many else None]
        return out

    def close(self) -> None:
        pass


def causal_features(rows: DataFrame, signals: list[str], delay: str = "6 hours", policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """entity, t and the figures of each signal from a stream of (entity, ts, signals), in append mode; rows later than the watermark are left out."""
    shaped = rows.select("entity", F.col("ts").cast("timestamp").alias("ts"), *[F.col(s).cast("double").alias(s) for s in signals]).withWatermark("ts", delay).withColumn("t", hours_since(F.col("ts")))
    schema = "entity long, t long, " + ", ".join(f"{n} double" for n in figure_names(signals))
    return shaped.groupBy("entity").transformWithStateInPandas(CausalFeatures(signals, policy), schema, "append", "EventTime")


def batch_features(panel: DataFrame, signals: list[str], policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """The same figures of a whole panel (entity, t, signals) by windows."""
    cols = {}
    for s in signals:
        age = windows.observation_age(s)
        cols[f"last__{s}"] = windows.last_observation(s, policy.last_observation_age)
        cols[f"age__{s}"] = F.when(age <= policy.last_observation_age, age).cast("double")
        for what in ("mean", "std", "max"):
            cols[f"{what}_8h__{s}"] = windows.rolling(s, policy.rolling_hours, what)
    return panel.withColumns(cols).select("entity", "t", *figure_names(signals))
