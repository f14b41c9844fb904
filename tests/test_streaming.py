"""Streamed features on late, unordered input against the batch windows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.policy import AlarmPolicy
from tidewell.streaming import features
from tidewell.streaming.alarms import accepted_alarms


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def run(spark, parts, tmp_path, schema, make):
    """Each part is a micro-batch of its own: written, then read until there is no more."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        w = make(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        assert w.trigger(availableNow=True).start().awaitTermination(60)
    return spark.read.parquet(str(tmp_path / "out"))


def test_late_and_unordered_rows_give_the_batch_features(rocks, tmp_path):
    r = random.Random(3)
    rows = [(e, t, None if r.random() < 0.4 else float(r.randint(0, 90)), None if r.random() < 0.8 else float(t)) for e in range(4) for t in range(1, 90) if r.random() < 0.7 and not (e == 2 and 20 < t < 60)]
    rows.sort(key=lambda x: x[1] + r.random() * 5)  # up to five hours out of order
    parts = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    late = (0, 2, 999.0, 999.0)  # comes when the watermark is far past it
    parts[-1].append(late)
    parts.append([(99, 1000, None, None)])  # moves the watermark on, so that nothing waits any longer
    stamped = [[(e, f"2024-01-{1 + (t - 1) // 24:02d} {(t - 1) % 24:02d}:00:00" if t < 700 else "2024-03-01 00:00:00", a, b) for e, t, a, b in p] for p in parts]
    out = run(rocks, stamped, tmp_path, "entity long, ts string, a double, b double", lambda s: features.causal_features(s, ["a", "b"]))
    panel = rocks.createDataFrame([x for x in rows if x != late], "entity long, t long, a double, b double")
    key = lambda df: {(x.entity, x.t): [None if v is None or v != v else round(v, 9) for v in x[2:]] for x in df.filter("entity < 99").select("entity", "t", *features.figure_names(["a", "b"])).collect()}
    got, want = key(out), key(features.batch_features(panel, ["a", "b"]))
    assert len(out.filter("entity < 99").collect()) == len(got) == len(rows) and got == want


def test_idle_alarm_state_goes(spark, tmp_path):
    """An alarm at hour 3, then a day of other entities: with its state gone, the next rise is accepted inside the refractory period."""
    hour = lambda e, t, p: (e, t, p, f"2024-01-{1 + t // 24:02d} {t % 24:02d}:00:00")
    parts = [[hour(1, 3, 1.0)], [hour(2, 40, 0.0)], [hour(2, 41, 0.0)], [hour(1, 42, 1.0)]]
    make = lambda s: accepted_alarms(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds"), 0.5, AlarmPolicy(refractory=1000), idle_hours=24)
    out = run(spark, parts, tmp_path, "entity long, t long, p double, ts string", make)
    assert sorted((r.entity, r.t) for r in out.collect()) == [(1, 3), (1, 42)]
