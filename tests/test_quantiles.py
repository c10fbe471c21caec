"""Quantiles without one task that holds every value, against Spark's percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridindex.operators import stats, tables


def test_group_quantiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.0, 1.0, rng.random(), rng.random() * 100])) for _ in range(3000)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.03, 0.25, 0.5, 0.99, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() if r.q}
    got = {r.g: r.q for r in tables.group_quantiles(df, "g", "v", shares).collect()}
    assert want.keys() == got.keys() and all(abs(x - y) < 1e-12 * max(1, abs(x)) for g in want for x, y in zip(want[g], got[g], strict=True))
    assert tables.quantiles(df.limit(0), "v", [0.5]) == []


def test_plans_hold_no_value_map(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 0.37).alias("v"))
    for out in (stats.normalize_minmax(df, ["v"], (0.01, 0.99)), stats.group_quintiles(df, "g", "v"), stats.box_summary(df, "g", "v"), tables.column_profile(df, ["v"]), tables.at_least_group_quantile(df, "g", "v", 0.5)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
    import inspect

    assert inspect.signature(stats.normalize_minmax).parameters["mode"].default == inspect.signature(tables.quantiles).parameters["mode"].default == "sorted"


@pytest.mark.parametrize("wrong", [False, True])
def test_columns_of_a_large_table_are_put_in_order_around_their_quantiles_alone(spark, monkeypatch, wrong):
    """Exact, also where the sample is wrong, one value fills most of a column, or a column has gaps or no value."""
    monkeypatch.setattr(tables, "SAMPLE", 2000)
    around, seen = tables._around, []
    monkeypatch.setattr(tables, "_around", lambda ordered, share: (0.123, 0.124) if wrong else around(ordered, share))
    select = tables.group_quantiles
    monkeypatch.setattr(tables, "group_quantiles", lambda df, *a: (seen.append(df.count()), select(df, *a))[1])
    rng = np.random.default_rng(1)
    a, b = rng.random(30_000), np.where(rng.random(30_000) < 0.9, 0.0, rng.random(30_000))
    rows = [(float(x), float(y), None if k % 3 else float(k), None) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = [0.0, 0.01, 0.99, 1.0]
    got = tables.column_quantiles(df, {c: F.col(c) for c in "abcd"}, shares)
    want = {"a": a, "b": b, "c": np.arange(0, 30_000, 3.0)}
    assert set(got) == set(want) and all(got[c] == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-12) for c, v in want.items())
    assert wrong or seen[0] < 75_000  # of 280,000 values and shares; the 27,000 equal ones are counted
