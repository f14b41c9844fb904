"""Panels from event tables and pipe-separated files; logs and hashes of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.target import with_onset
from tidewell.operators.validate import cohort_identity, duplicates, enforce, stored_if
from tidewell.policy import PanelPolicy

EPOCH = "2024-01-01"


def hours_since(ts: Column, epoch: str = EPOCH) -> Column:
    """Whole hours since the epoch, from 1; the session's time zone plays no part."""
    return (F.datediff(ts, F.lit(epoch)) * 24 + F.hour(ts) + 1).cast("long")


def panel_from_events(events: DataFrame, policy: PanelPolicy = PanelPolicy()) -> DataFrame:
    """One row for each entity and hour with an event: mean value by event type, and the running label.

    One shuffle by (entity, hour) with partial aggregation, one by entity for the label.
    """
    value = lambda s: F.round(F.avg(F.when(F.col("event_type") == s, F.col("value"))), 6).alias(s)
    trigger = F.max(F.when((F.col("event_type") == policy.trigger_signal) & (F.col("value") >= policy.trigger_value), 1).otherwise(0))
    hourly = (
        events.select(F.col("user_id").alias("entity"), hours_since(F.col("ts")).alias("t"), "event_type", "value")
        .groupBy("entity", "t").agg(*map(value, policy.signals), trigger.alias("trigger"))
    )
    so_far = W.partitionBy("entity").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    source = F.when(F.col("entity") % 2 == 0, "A").otherwise("B").alias("source")
    return hourly.select("entity", source, "t", *policy.signals, F.max("trigger").over(so_far).cast("int").alias("label"))


def densify(panel: DataFrame) -> DataFrame:
    """A row for every hour between an entity's first and last; hours without one have null signals, the label runs on."""
    spine = panel.groupBy("entity", "source").agg(F.min("t").alias("a"), F.max("t").alias("z")).select("entity", "source", F.explode(F.sequence("a", "z")).alias("t"))
    so_far = W.partitionBy("entity").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(panel, ["entity", "source", "t"], "left").withColumn("label", F.max("label").over(so_far))


def source_and_entity(path: Column) -> list[Column]:
    """The two last parts of .../<source>/<entity>.psv; a job fails on any other path."""
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)\.psv$", k)
    return [F.when(part(k) != "", part(k)).otherwise(F.raise_error(F.concat(F.lit("no source and entity in the path "), path))) for k in (1, 2)]


def identity_of(name: str) -> tuple[str, str]:
    """(source, source:entity) of a member's name, .../<source>/<entity>.psv."""
    if not (m := re.search(r"([^/]+)/([^/]+)\.psv$", name, re.I)):
        raise ValueError(f"no source and entity in the path {name}")
    return m[1], f"{m[1]}:{m[2]}"


def read_psv(spark: SparkSession, path: str, columns: list[str], policy: PanelPolicy = PanelPolicy()) -> DataFrame:
    """Pipe-separated files of one entity each as text columns; missing tokens are null.

    The path's last parts give source and entity: .../<source>/<entity>.psv; another path fails the job.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, sep="|", header=True, enforceSchema=False, pathGlobFilter="*.psv", recursiveFileLookup=True)
    parts = source_and_entity(F.col("_metadata.file_path"))
    known = [F.when(~F.trim(c).isin(*policy.missing_tokens), F.trim(c)).alias(c) for c in columns]
    return raw.select(parts[0].alias("source"), F.concat_ws(":", *parts).alias("entity"), *known)


def harmonised(
    raw: DataFrame, signals: list[str], static: list[str] = (), time: str = "t", label: str = "label", ordinal: str = "row", cohort: DataFrame | None = None, policy: PanelPolicy = PanelPolicy()
) -> DataFrame:
    """From text columns of many entities' files (source, entity, ordinal in the file) to a checked panel with status and onset.

    Refused are cells that are no finite numbers, rows without a time, times that do not increase in file
    order, labels other than 0 and 1 or falling back, static columns that change, rows numbered twice
    and, if cohort (source, entities, rows) is given, other numbers of entities or rows. All row
    checks share one shuffle by entity, and their counts are taken while the panel is written.
    """
    columns = [time, label, *signals, *static]
    text = raw.withColumns({c: F.when(~F.trim(c).isin(*policy.missing_tokens), F.trim(c)) for c in columns})
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))) for c in columns])
    rows = text.select("source", "entity", F.col(ordinal).alias("_row"), bad.alias("_bad"), *[number(c).alias(c) for c in columns])
    filed = W.partitionBy("entity").orderBy("_row", time)
    every = W.partitionBy("entity")
    changes = [F.min(c).over(every) != F.max(c).over(every) for c in static]
    rows = rows.withColumns({"_t": F.lag(time).over(filed), "_label": F.lag(label).over(filed), "_before": F.lag("_row").over(filed), "_changes": reduce(lambda a, b: a | b, changes, F.lit(False))})
    rules = {
        "cells that are no finite numbers": F.col("_bad"),
        "rows without a time": F.col(time).isNull(),
        "times that do not increase": F.col(time) <= F.col("_t"),
        "labels other than 0 and 1": ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)),
        "labels that fall back": F.col(label) < F.col("_label"),
        "static columns that change": F.coalesce(F.col("_changes"), F.lit(False)),
        "rows numbered twice": F.col("_row") == F.col("_before"),
    }
    panel = stored_if(rows, rules, ["entity", "_row", time], "harmonised").select("source", "entity", F.col(time).alias("t"), *signals, *static, F.col(label).cast("int").alias("label"))
    if cohort is not None:
        enforce(cohort_identity(panel, cohort), "another cohort")
    return with_onset(panel).drop("last_t")


def canonical_names(columns: list[str], allowed: list[str], aliases: dict[str, str] | None = None) -> dict[str, str]:
    """{given: canonical}; raises on duplicate, unknown or missing names."""
    named = {c: (aliases or {}).get(c.strip(), c.strip()) for c in columns}
    got = list(named.values())
    for what, wrong in (("duplicate", {c for c in got if got.count(c) > 1}), ("unknown", set(got) - set(allowed)), ("missing", set(allowed) - set(got))):
        if wrong:
            raise ValueError(f"{what} columns: {sorted(wrong)}")
    return named


def key_value_log(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """key and value of the key=value lines of text files; other lines are skipped. expected: the exact keys, each once."""
    line = F.regexp_extract("value", r"^\s*([A-Za-z_][A-Za-z0-9_]*)=(.*?)\s*$", 1)
    found = spark.read.text(path).select(line.alias("key"), F.regexp_extract("value", r"=(.*?)\s*$", 1).alias("said")).filter("key <> ''").withColumnRenamed("said", "value")
    if expected is not None:
        enforce(duplicates(found, ["key"]), "repeated keys")
        got = {r["key"] for r in found.select("key").limit(len(expected) + 1).collect()}
        if got != set(expected):
            raise ValueError(f"keys differ: {sorted(got ^ set(expected))}")
    return found


def utilisation_log(spark: SparkSession, path: str) -> DataFrame:
    """samples, active samples, mean, active mean and largest of a one-column utilisation log."""
    used = spark.read.csv(path, header=True).select(F.regexp_extract(F.concat_ws(",", "*"), r"([0-9.]+)", 1).cast("double").alias("u")).filter("u IS NOT NULL")
    active = F.when(F.col("u") > 0, F.col("u"))
    return used.agg(F.count("*").alias("samples"), F.count(active).alias("active_samples"), F.avg("u").alias("mean"), F.avg(active).alias("active_mean"), F.max("u").alias("largest"))


def inventory_hash(members: DataFrame) -> DataFrame:
    """sha256 over the members' names, sizes and checksums in name order; an archive without members is an error."""
    if members.isEmpty():
        raise ValueError("the archive holds no such members")
    said = F.to_json(F.array_sort(F.collect_list(F.struct(*members.columns))))
    return members.agg(F.count("*").alias("members"), F.sha2(said, 256).alias("sha256"))
