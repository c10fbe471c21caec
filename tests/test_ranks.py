"""Ranks and selection over ranges, against plain ones, where one value fills most of a column."""

import random

import pytest
from pyspark.sql import functions as F

from gridindex.operators import ranks, stats, tables


def average_ranks(values):
    order = sorted(v for v in values if v is not None)
    return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(order)}


@pytest.mark.parametrize("share", [0.0, 0.95])
def test_ranked(spark, share):
    rng = random.Random(int(share * 100))
    rows = [(i, rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else 0.0 if rng.random() < share else float(rng.randint(-40, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r.id: (r["rank"], r.total) for r in ranks.ranked(df, ["g"], "v").collect()}
    assert len(got) == 3000
    for g in ("a", "b", None):
        own = [v for _, h, v in rows if h == g]
        want, n = average_ranks(own), sum(v is not None for v in own)
        assert all(got[i] == ((want[v], n) if v is not None else (None, n)) for i, h, v in rows if h == g)


def test_a_hot_value_lies_in_many_ranges_and_is_never_a_key(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 20 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"))
    out = tables.percentile_rank(df, "v")
    rows = {r.v: r["rank"] for r in out.collect()}
    assert rows[0.0] == pytest.approx((1 + 19_001) / 2 / 20_000) and rows[19_980.0] == 1.0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any(" v#" in line for line in joins)
    # the hot value's rows are spread over the ranges they were dealt to
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # few rows would be put together again
    parts = ranks.dealt(df, F.col("v"), F.xxhash64("id", "v")).filter("v = 0").groupBy("__part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 12_000


def test_spearman_of_mostly_zeros(spark):
    rng = random.Random(5)
    rows = [(*(0.0 if rng.random() < 0.95 else rng.random() for _ in range(3)), None if rng.random() < 0.3 else float(rng.randint(0, 3))) for _ in range(2000)]
    out = {(r.a, r.b): (r.n, r.rho) for r in stats.spearman_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    import numpy as np

    for i in range(4):
        for j in range(i + 1, 4):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x, y = ([average_ranks(c)[v] for v in c] for c in zip(*both))
            n, rho = out["abcd"[i], "abcd"[j]]
            assert n == len(both) and rho == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_a_rank_has_a_task_for_so_many_rows(spark, monkeypatch):
    """Tasks follow the rows, not the shuffle partitions (4 here); ranks and totals stay those of the whole group."""
    monkeypatch.setattr(ranks, "ROWS", 500)
    monkeypatch.setattr(ranks, "MANY", 1000)
    rows = [(i, float(i) if i % 20 == 0 else 0.0 if i % 3 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v double")
    parts = ranks.dealt(df, F.col("v"), F.xxhash64("id", "v")).groupBy("__part").count().collect()
    assert len(parts) >= 9 and max(r["count"] for r in parts) <= 1000
    values = [v for _, v in rows if v is not None]
    want = average_ranks(values)
    for by in ([], ["g"]):
        got = {r.id: (r["rank"], r.total) for r in ranks.ranked(df.withColumn("g", F.lit("a")), by, "v").collect()}
        assert all(got[i] == (want[v] if v is not None else None, len(values)) for i, v in rows)


def test_quantiles_read_their_input_once(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    seen = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (seen.add(1), r)[1]).toDF("v double")
    assert tables.quantiles(counted, "v", [0.0, 0.25, 0.5, 1.0]) == pytest.approx([0.0, 12_499.75, 24_999.5, 49_999.0])
    assert seen.value == 50_000


def test_cumulative_of_one_value(spark):
    got = ranks.cumulative(spark.createDataFrame([(2.0, 5)], "v double, n long"), "v", "n").collect()
    assert [(r.before, r.total) for r in got] == [(0, 5)]
    assert ranks.cumulative(spark.createDataFrame([], "v double, n long"), "v", "n").count() == 0
    assert tables.percentile_rank(spark.createDataFrame([], "v double"), "v").count() == 0
