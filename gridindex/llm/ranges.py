"""Ranges of doc_id with fixed bounds, so that every job that deals rows by them deals alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.shared import removed, scratch, written

__all__ = ["bounds", "checkpointed", "free", "range_of", "removed", "scratch"]


def bounds(spark: SparkSession, docs: DataFrame) -> list[int]:
    """At most spark.sql.shuffle.partitions - 1 ascending cuts of doc_id, about as many rows between any two. Reads doc_id alone."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*(F.lit(k / n) for k in range(1, n))), 20 * n)).head()[0]
    return sorted(set(found or []))


def range_of(cuts: list[int], key: Column) -> Column:
    """The number of cuts at or below the key: 0 .. len(cuts); 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= key)), F.lit(0)) if cuts else F.lit(0)


def checkpointed(spark: SparkSession, frame: DataFrame, what: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: its lineage is cut, and losing an executor loses nothing."""
    return written(spark, frame, what)


def free(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs does not have, in any case."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name
