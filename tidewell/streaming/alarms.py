"""Streaming analogues: hourly panels with late data, and alarm episodes as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewell.policy import AlarmPolicy

OUT = "entity long, t long"
STATE = "last_t long, last_positive boolean, accepted long"


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events by entity and hour; rows later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", "1 hour"), F.col("user_id").alias("entity")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("entity", F.col("window.start").alias("hour"), "n", "mean")


def accepted_alarms(scored: DataFrame, threshold: float, policy: AlarmPolicy = AlarmPolicy(), idle_hours: int | None = None) -> DataFrame:
    """Accepted alarm times from a stream of (entity, t, p); rows not after an entity's last time are left out.

    State is three values an entity: its last time, whether that was positive, and the last
    accepted time; the refractory period counts from accepted alarms alone. With idle_hours (rows then
    have a watermarked ts) an entity's state goes when the watermark is so far past its last row; a row after
    that starts it anew.
    """
    quiet = None if idle_hours is None else idle_hours * 3_600_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_t, positive, accepted = state.get if state.exists else (None, False, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("t")
        for t, p in rows[["t", "p"]].itertuples(index=False):
            if last_t is not None and t <= last_t:
                continue
            now = bool(p >= threshold)
            if now and not positive and (accepted is None or t - accepted >= policy.refractory):
                out.append(t)
                accepted = int(t)
            last_t, positive = int(t), now
        state.update((last_t, positive, accepted))
        if quiet is not None:
            last = int(pd.Timestamp(rows["ts"].max()).tz_localize("UTC").timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + quiet, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"entity": [key[0]] * len(out), "t": out}).astype({"entity": "int64", "t": "int64"})

    return scored.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if quiet is None else GroupStateTimeout.EventTimeTimeout)
