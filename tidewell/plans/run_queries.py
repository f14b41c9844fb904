"""Queries over archives, lineage and recomputed artifacts that the tables make, each with the same query in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lineage
from tidewell.plans import panel_queries as pq
from tidewell.plans.panel_queries import PANEL, SIGNALS, TARGET, panel, table, targeted
from tidewell.sources import archives, runs
from tidewell.sources.panel import harmonised
from tidewell.sources.shared import new_path

QUERIES: dict[str, pq.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: pq.Query) -> pq.Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def with_static(spark, sf_dir) -> DataFrame:
    """The panel with what does not change of an entity: balance and nation of the customer it belongs to."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return panel(spark, sf_dir).join(c, "entity", "left")


@query(TARGET + f" SELECT entity, source, t, {', '.join(SIGNALS)}, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation, label, status, CAST(onset AS DOUBLE) AS onset FROM targeted LEFT JOIN customer ON entity = c_custkey")
def archived_panel(spark, sf_dir):
    """The panel written as archives of one file for each entity, headers renamed and in another order, read by member ranges and checked."""
    path = new_path(spark, "panel-archive")
    rows = with_static(spark, sf_dir).withColumn("entity", F.concat_ws(":", "source", F.col("entity").cast("string")))
    archives.write_archive(rows.select("source", "entity", "balance", *[F.col(s).alias(f"{s}_value") for s in reversed(SIGNALS)], "label", "nation", "t"), path)
    raw = archives.read_archive(spark, path, ["t", *SIGNALS, "balance", "nation", "label"], {f"{s}_value": s for s in SIGNALS}, partition_bytes=1 << 20)
    want = rows.groupBy("source").agg(F.countDistinct("entity").alias("entities"), F.count("*").alias("rows"))
    out = harmonised(raw, SIGNALS, ["balance", "nation"], cohort=want)
    return out.withColumns({"entity": F.split("entity", ":")[1].cast("long"), "t": F.col("t").cast("long")}).select("entity", "source", "t", *SIGNALS, "balance", "nation", "label", "status", "onset")


def made_of(spark, sf_dir) -> DataFrame:
    """Edges (node, input): what each row of the order tables was made of, four steps deep."""
    name = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in cols])
    t = lambda n: table(spark, sf_dir, n)
    return reduce(DataFrame.union, [
        t("nation").select(name("nation", "n_nationkey").alias("node"), name("region", "n_regionkey").alias("input")),
        t("customer").select(name("customer", "c_custkey").alias("node"), name("nation", "c_nationkey").alias("input")),
        t("orders").select(name("order", "o_orderkey").alias("node"), name("customer", "o_custkey").alias("input")),
        t("lineitem").select(name("line", "l_orderkey", "l_linenumber").alias("node"), name("order", "l_orderkey").alias("input")),
        t("lineitem").select(name("line", "l_orderkey", "l_linenumber").alias("node"), name("supplier", "l_suppkey").alias("input")),
        t("supplier").select(name("supplier", "s_suppkey").alias("node"), name("nation", "s_nationkey").alias("input")),
    ])


EDGES = """edges AS (SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS input FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'order:' || l_orderkey FROM lineitem
    UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""


@query(f"""WITH RECURSIVE {EDGES}, r(artifact, steps) AS (SELECT 'region:' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA' UNION SELECT node, steps + 1 FROM r JOIN edges ON input = artifact)
    SELECT artifact, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY artifact""")
def lineage_behind_change(spark, sf_dir):
    """Everything that was made, over any number of steps, of the region that changed."""
    changed = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("artifact"))
    return lineage.behind(made_of(spark, sf_dir), changed)


def _cohort(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("source", "entity").agg(F.count("*").alias("rows"), F.max("label").alias("label"))


def _targets(spark, sf_dir):
    return targeted(spark, sf_dir).select("entity", "t", "eligible", "target")


@query(PANEL + """, n AS (SELECT count(*) AS targets, count(*) FILTER (WHERE entity % 10 = 3) AS changed, count(DISTINCT entity) AS entities FROM panel)
    SELECT 'cohort' AS artifact, entities AS rows, 0 AS differences FROM n UNION ALL SELECT 'targets', targets, changed FROM n""")
def recomputed_artifacts(spark, sf_dir):
    """Artifacts made again and held against what was written; one was tampered with after it was made."""
    targets = _targets(spark, sf_dir).withColumn("eligible", F.when(F.col("entity") % 10 == 3, 1 - F.col("eligible")).otherwise(F.col("eligible")))
    written = {n: runs.write_once(df, new_path(spark, n)) for n, df in (("cohort", _cohort(spark, sf_dir)), ("targets", targets))}
    again = {"cohort": (_cohort(spark, sf_dir), ["source", "entity"]), "targets": (_targets(spark, sf_dir), ["entity", "t"])}
    return runs.recomputed(written, again)


_STAGES = {"panel": ["entity", "t", "label"], "targets": ["entity", "t", "eligible", "target"], "decisions": ["entity", "t", "target"]}


def _digest_sql(name: str, table_: str, where: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _STAGES[name])
    return f"SELECT '{name}' AS artifact, sha256(count(*) || ':' || CAST(coalesce(sum(CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)), 0) AS VARCHAR)) AS sha256, count(*) AS size FROM {table_} WHERE {where}"


@query(TARGET + f""", m AS ({_digest_sql('panel', 'panel', 'true')} UNION ALL {_digest_sql('targets', 'targeted', 'true')} UNION ALL {_digest_sql('decisions', 'targeted', 'eligible = 1')})
    SELECT artifact, sha256, size, CASE artifact WHEN 'panel' THEN 'mismatch' ELSE 'behind a change' END AS what, CAST(CASE artifact WHEN 'panel' THEN 0 WHEN 'targets' THEN 1 ELSE 2 END AS INTEGER) AS steps FROM m""")
def stale_stages(spark, sf_dir):
    """Manifests of three stages made of each other, by content, and what a change of the first one leaves behind."""
    t = targeted(spark, sf_dir)
    tables = {"panel": panel(spark, sf_dir), "targets": t, "decisions": t.filter("eligible = 1")}
    parts = [lineage.table_digest(df, _STAGES[n]).select(F.lit(n).alias("stage"), F.lit(n).alias("artifact"), "sha256", "size") for n, df in tables.items()]
    stages = runs.write_once(reduce(DataFrame.unionByName, parts), new_path(spark, "stage-manifests"))
    uses = spark.createDataFrame([("targets", "panel"), ("decisions", "targets")], "stage string, uses string")
    nodes, edges = runs.lineage_of(stages, uses)
    changed = tables["panel"].withColumn("label", F.when(F.col("entity") % 50 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    now = lineage.table_digest(changed, _STAGES["panel"]).select(F.lit("panel").alias("artifact"), "sha256").unionByName(stages.filter("artifact <> 'panel'").select("artifact", "sha256"))
    return stages.select("artifact", "sha256", "size").join(lineage.stale(nodes, edges, now), "artifact")
