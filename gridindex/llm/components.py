"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm.ranges import checkpointed, removed


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """For each node, its neighbours (the larger ones, or the smaller ones and itself) linked to its least neighbour."""
    if larger_only:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("to")).union(edges.select("b", "a"))
        least = both.groupBy("n").agg(F.least(F.min("to"), F.col("n")).alias("least"))
        linked = both.filter(F.col("to") > F.col("n")).join(least, "n")
        return linked.select(F.col("least").alias("a"), F.col("to").alias("b")).filter("a <> b").distinct()
    least = edges.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("least"))
    linked = edges.select(F.col("b").alias("n"), F.col("a").alias("to")).join(least, "n")
    return linked.select(F.col("least").alias("a"), F.col("to").alias("b")).filter("a <> b").union(least.select(F.col("least").alias("a"), F.col("n").alias("b"))).distinct()


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (its least member) for every node of the edges (a, b: long). No edges: no rows.

    Each round is written to the shared folder, and the round before it removed there; when a round changes nothing, every
    node hangs on its least member.
    """
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = checkpointed(spark, now, "components")
    mark = None
    while True:
        before, now = now, checkpointed(spark, _toward_least(_toward_least(now, True), False), "components")
        removed(spark, before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).head()
        if new == mark:
            break
        mark = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
