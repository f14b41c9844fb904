"""Artifact hashes and lineage as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import text_hash
from tidewell.sources.shared import Bucketed, stored

BUCKET_EDGES = 500_000


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """sha256 and size (rows) of a table's content, whatever the order of its rows: of the number of rows and the sum of their 60-bit hashes.

    Rows are hashed as text, null as an empty field between bars; columns should be whole numbers or text. One row.
    """
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    total = F.coalesce(F.sum(text_hash(said).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), total), 256).alias("sha256"), F.count("*").alias("size"))


def artifact_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(artifact, what) for artifacts missing, unexpected or with another hash."""
    a, b = expected.select("artifact", F.col("sha256").alias("want")), actual.select("artifact", F.col("sha256").alias("got"))
    what = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "mismatch")
    return a.join(b, "artifact", "full_outer").select("artifact", what.alias("what")).filter("what IS NOT NULL")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (node, input, sha256) whose input no node makes with that hash."""
    return edges.join(nodes.select(F.col("artifact").alias("input"), "sha256"), ["input", "sha256"], "left_anti")


def behind(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """artifact and steps: changed ones (0) and all that was made of them, with the fewest steps.

    edges: node, input. Each round joins the last round's new artifacts alone with the edges, so
    a cycle ends it too; rounds are as many as the longest chain behind a change. Edges are shuffled
    once, into buckets of their input, and artifacts once, in the round that finds them: no round moves
    what an earlier one did. The edges of one input are one task's in rounds of too many new artifacts to broadcast.
    """
    spark, steps, edges = edges.sparkSession, 0, edges.select("node", "input")
    n = 1 + edges.count() // BUCKET_EDGES
    made, known = Bucketed(spark, "lineage-edges", "input", n), Bucketed(spark, "lineage-known", "artifact", n)
    try:
        edges = made.add(edges.hint("rebalance", n, "input"))
        found = known.add(changed.select("artifact").repartition(n, "artifact").distinct().withColumn("steps", F.lit(steps)))
        while not (new := found.filter(F.col("steps") == steps)).isEmpty():
            steps += 1
            next_ = edges.join(new, F.col("input") == F.col("artifact")).select(F.col("node").alias("artifact")).repartition(n, "artifact").distinct()
            found = known.add(next_.join(found.select("artifact"), "artifact", "left_anti").withColumn("steps", F.lit(steps)))
        return spark.read.schema(found.schema).parquet(known.path)
    finally:
        made.forget()
        known.forget()


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges that are part of a cycle, or lie between two: what is left when edges into or out of an end are taken away round by round."""
    left = stored(edges.select("node", "input").distinct(), "lineage-edges")
    n = left.count()
    while True:
        left = stored(left.join(left.select(F.col("node").alias("input")).distinct(), "input", "left_semi").select("node", "input"), "lineage-edges")
        left = stored(left.join(left.select(F.col("input").alias("node")).distinct(), "node", "left_semi").select("node", "input"), "lineage-edges")
        m = left.count()
        if m == n:
            return left
        n = m


def stale(nodes: DataFrame, edges: DataFrame, now: DataFrame) -> DataFrame:
    """(artifact, what, steps): artifacts that differ now from their node, those whose inputs had another hash than the input's node, and all behind them.

    nodes: artifact, sha256. edges: node, input, sha256 of the input as it was used. now: artifact, sha256.
    """
    differ = artifact_differences(nodes, now)
    outdated = dangling_edges(edges, nodes).select(F.col("node").alias("artifact"), F.lit("made of other input").alias("what"))
    first = stored(differ.union(outdated).groupBy("artifact").agg(F.min("what").alias("what")), "lineage-changed")
    return behind(edges, first).join(first, "artifact", "left").select("artifact", F.coalesce("what", F.lit("behind a change")).alias("what"), "steps")


def malformed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without a 64-digit hash or a 40-digit commit."""
    return nodes.filter(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | ~F.coalesce(F.col("commit").rlike("^[0-9a-f]{40}$"), F.lit(False)))
