"""Ranks, running totals and quantiles by ranges of the values: what is ordered is never one task's, nor looked up by value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.shared import written


#: About as many rows as a task orders or holds at most, beyond what tables of MANY rows in all are dealt to.
ROWS, MANY = 1 << 19, 1 << 22


def tasks(rows: int) -> int | None:
    """How many tasks so many rows are dealt to: their number follows the rows. None: few rows, left to Spark."""
    return -(-rows // ROWS) if rows > MANY else None


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the hash of the keys to tasks(rows) tasks, which Spark does not put together again."""
    n = tasks(rows)
    return df.repartition(n, *keys) if n else df


def _ranges(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    return (df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)).withColumn("__part", F.spark_partition_id())


def dealt(df: DataFrame, *order: Column) -> DataFrame:
    """df by ascending ranges of the order, with the number of each row's range (__part), in the shared folder.

    df is read once: the cuts come from a table that is written first, and the ranges are kept, since sampled cuts may differ
    from one job to the next. A range holds about ROWS rows at most, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    rows = written(spark, df)
    return written(spark, _ranges(rows, tasks(rows.count()), *order))


def cumulative(counts: DataFrame, value: str, n: str) -> DataFrame:
    """counts (one row a value) with before (the sum of n of all lesser values) and total."""
    parts = dealt(counts, F.col(value))
    sums = parts.groupBy("__part").agg(F.sum(n).alias("__sum"))  # a row a range
    before = F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")
    starts = sums.select("__part", before.alias("__start"), F.sum("__sum").over(Window.partitionBy()).alias("total"))
    lesser = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(starts), "__part")
    return placed.withColumn("before", F.col("__start") + F.coalesce(F.sum(n).over(lesser), F.lit(0))).drop("__part", "__start")


def ranked(df: DataFrame, by: Sequence[str], value: str, rank: str = "rank", total: str = "total", rows: int | None = None) -> DataFrame:
    """df with the average rank of each value in its group (ties share theirs, from 1) and the group's number of values.

    Rows lie in ranges of group, value and a hash of the row, so a value that fills most of a column is many ranges. A range
    ranks its own rows, in a task of its own; only its first and its last value can go on elsewhere, and their counts are added
    up over ranges, of which there is a row each. No row is joined by its value. A missing value has no rank; rows equal in
    every column stay together. rows: about how many there are, for a df that can be read twice; else it is written and counted.
    """
    spark, names = df.sparkSession, df.columns
    if rows is None:
        df = written(spark, df)
        rows = df.count()
    v, ascending, key = F.col(value), F.col(value).asc_nulls_last(), ["__part", *by]
    n = tasks(rows)
    parts = _ranges(df, n, *(F.col(c) for c in by), ascending, F.xxhash64(*names))
    parts = parts.repartitionById(n, F.col("__part")) if n else parts
    own = Window.partitionBy(*key).orderBy(ascending)
    upto = own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = written(spark, parts.withColumns({"__low": F.rank().over(own), "__high": F.count(v).over(upto)}))  # sampled cuts may differ from one job to the next
    # what each range holds, and its two ends
    ks = [f"__k{i}" for i in range(len(key))]
    held = local.groupBy(*(F.col(c).alias(k) for c, k in zip(key, ks, strict=True))).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(F.when(v.isNotNull(), F.col("__high"))).alias("lo_c"), F.max(F.when(v.isNotNull(), F.col("__low"))).alias("hi_low"))
    start = F.sum("n").over(Window.partitionBy(*ks[1:]).orderBy(ks[0])) - F.col("n")
    held = held.withColumns({"__start": start, "__total": F.sum("n").over(Window.partitionBy(*ks[1:]))})
    low = F.struct(F.lit("lo").alias("side"), F.col("lo").alias("v"), F.col("lo_c").alias("c"), F.col("__start").alias("before"))
    high = F.struct(F.lit("hi").alias("side"), F.col("hi").alias("v"), F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.col("n") - F.col("hi_low") + 1).alias("c"), (F.col("__start") + F.col("hi_low") - 1).alias("before"))
    ends = held.select(*ks, "__start", "__total", F.explode(F.array(low, high)).alias("e")).select(*ks, "__start", "__total", "e.*")
    whole = Window.partitionBy(*ks[1:], "v")  # the ranges that one value goes over
    ends = ends.withColumn("mean", F.min("before").over(whole) + (F.sum("c").over(whole) + 1) / 2)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"__{side}_{c}")
    ends = written(spark, ends.groupBy(*ks, "__start", "__total").agg(*(pick(s, c) for s in ("lo", "hi") for c in ("v", "mean"))))  # its size tells Spark how to join it
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(key, ks, strict=True)))
    placed = local.join(F.broadcast(ends) if not by else ends, same)
    inside = F.col("__start") + (F.col("__low") + F.col("__high")) / 2
    mean = F.when(v.isNull(), None).when(v == F.col("__lo_v"), F.col("__lo_mean")).when(v == F.col("__hi_v"), F.col("__hi_mean")).otherwise(inside)
    return placed.withColumn(rank, mean.cast("double")).select(*names, rank, F.col("__total").alias(total))


def group_quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float], others: DataFrame | None = None) -> DataFrame:
    """by, q (linear-interpolated quantiles) and n (values) of each group that has a value, by selection.

    Values are counted by group; the counts lie in ranges, whose sums tell in which range each wanted rank falls; only those
    ranges are sorted. The input is read once, and neither a large group nor a column of many values is held by one task.
    others: by, less and total (a few groups) where df is a stretch of each group's values: how many values are less than
    those, and how many there are in all; quantiles outside the stretch are null.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(by).alias("by"), v.alias("v")).filter("v IS NOT NULL")
    counts = rows.groupBy("by", "v").agg(F.count("*").alias("n"))
    parts = dealt(counts, F.col("by"), F.col("v")).withColumn("g", F.struct("by"))
    sums = parts.groupBy("g", "__part").agg(F.sum("n").alias("s"))
    starts = sums.select("g", "__part", "s", (F.sum("s").over(Window.partitionBy("g").orderBy("__part")) - F.col("s")).alias("start"), F.sum("s").over(Window.partitionBy("g")).alias("total"))
    if others is not None:
        starts = starts.drop("total").join(F.broadcast(others.select(F.struct(F.col(by).alias("by")).alias("g"), "less", "total")), "g").withColumn("start", F.col("start") + F.col("less"))
    at = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    ranks = [(f"{name}{i}", rank) for i, p in enumerate(at) for name, rank in (("lo", F.floor(p)), ("hi", F.ceil(p)))]
    falls = [(F.col("start") <= k) & (k < F.col("start") + F.col("s")) for _, k in ranks]
    wanted = starts.filter(F.exists(F.array(*falls), lambda x: x))
    lesser = Window.partitionBy("g", "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(wanted, ["g", "__part"]).withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(lesser), F.lit(0)))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    found = placed.groupBy("g").agg(F.max("total").alias("total"), *(F.max(F.when(holds(k), F.col("v"))).alias(name) for name, k in ranks))
    between = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"lo{i}") + (p - F.floor(p)) * F.col(f"hi{i}")) for i, p in enumerate(at)]
    return found.select(F.col("g.by").alias(by), F.array(*between).alias("q"), F.col("total").alias("n"))
