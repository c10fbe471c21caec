"""Nearest points, overlaps and simplification against brute force and closed forms."""

import math
import random
import re

import pytest

from gridindex.functions import grid as G
from gridindex.operators import spatial


def test_knn(spark):
    rng = random.Random(1)
    clusters = [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(4)]
    points = [(k, x + rng.gauss(0, 5), y + rng.gauss(0, 5)) for k in range(60) for x, y in [clusters[k % 4]]]
    targets = [(k, rng.uniform(-500, 1500), rng.uniform(-500, 1500)) for k in range(120)]
    out = spatial.knn_join(spark.createDataFrame(targets, "target_id int, x double, y double"), spark.createDataFrame(points, "point_id int, x double, y double"), 3)
    found = {}
    for r in out.collect():
        found.setdefault(r.target_id, {})[r["rank"]] = r.point_id
    for t, x, y in targets:
        near = sorted((math.hypot(x - px, y - py), p) for p, px, py in points)[:3]
        assert [found[t][k] for k in (1, 2, 3)] == [p for _, p in near]
    few = spatial.knn_join(spark.createDataFrame(targets[:5], "target_id int, x double, y double"), spark.createDataFrame(points[:2], "point_id int, x double, y double"), 3)
    assert few.count() == 10
    none = spark.createDataFrame([], "point_id int, x double, y double, capacity double")
    assert [r.score for r in spatial.gravity(spark.createDataFrame(targets[:2], "target_id int, x double, y double"), none).collect()] == [0, 0]
    near = spatial.near_flagged(spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "target_id int, x double, y double"), spark.createDataFrame([(1, 3.0, 4.0, True), (2, 501.0, 0.0, False)], "point_id int, x double, y double, flag boolean"), 50.0)
    assert {r.target_id: r.distance for r in near.collect()} == {1: 5.0, 2: None}


@pytest.mark.parametrize("far", [None, 40.0])
def test_the_descent_is_spread_and_binds_its_bound_once(spark, far):
    """Few bytes and much work: targets keep as many tasks as shuffle partitions, and no square works the bound out anew."""
    rng = random.Random(2)
    rows = [(k, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(200)]
    met = spatial.met_points(spark.createDataFrame(rows, "target_id int, x double, y double"), spark.createDataFrame(rows, "point_id int, x double, y double"), 1, far)
    plan = met._jdf.queryExecution()
    assert not re.search(r"near <= (least\()?aggregate", plan.optimizedPlan().toString())
    assert re.search(r"hashpartitioning\(target_id#\d+, 4\), REPARTITION_BY_NUM", plan.executedPlan().toString())


@pytest.mark.parametrize("crowd,far", [(1, None), (4, None), (1, 40.0)])
def test_knn_in_a_crowd(spark, monkeypatch, crowd, far):
    """Most points in one place, many at one spot: crowded squares are cut, and nothing is lost."""
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = random.Random(3)
    points = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(300)] + [(1000 + k, 5.0, 5.0) for k in range(40)] + [(2000 + k, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for k in range(40)]
    targets = [(k, *(rng.gauss(0, 2) if k % 2 else rng.uniform(-1500, 1500) for _ in range(2))) for k in range(60)] + [(99, 5.0, 5.0)]
    out = spatial.knn_join(spark.createDataFrame(targets, "target_id int, x double, y double"), spark.createDataFrame(points, "point_id int, x double, y double"), 3, far).collect()
    found = {(r.target_id, r["rank"]): r.point_id for r in out}
    assert len(found) == len(out)
    for t, x, y in targets:
        near = sorted((d, p) for p, px, py in points if (d := math.hypot(x - px, y - py)) <= (far or math.inf))[:3]
        assert [found.get((t, k)) for k in (1, 2, 3)] == [p for _, p in near] + [None] * (3 - len(near))


def test_knn_meets_few_points(spark, tmp_path):
    """100,000 points at one address, a city of 20,000 places and uniform land around: a target meets at most 64 points for each neighbour."""
    import numpy as np
    from pyspark.sql import functions as F

    address = spark.range(100_000).select("id", F.lit(500.0).alias("x"), F.lit(500.0).alias("y"))
    city = spark.range(100_000, 120_000).select("id", (F.randn(1) * 3 + 200).alias("x"), (F.randn(2) * 3 + 200).alias("y"))
    land = spark.range(200_000, 201_000).select("id", (F.rand(3) * 1000).alias("x"), (F.rand(4) * 1000).alias("y"))
    address.unionAll(city).unionAll(land).withColumnRenamed("id", "point_id").write.parquet(f"{tmp_path}/points")
    near, city = (F.col("id") % 4 == 0), (F.col("id") % 4 == 1)
    place = lambda seed, at: F.when(near, 498 + F.rand(seed) * 4).when(city, at + F.randn(seed) * 10).otherwise(F.rand(seed) * 1000)
    spark.range(400).select(F.col("id").alias("target_id"), place(5, 200).alias("x"), place(6, 200).alias("y")).write.parquet(f"{tmp_path}/targets")
    points, targets = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("points", "targets"))
    met = spatial.met_points(targets, points, 3).groupBy("target_id").count().collect()
    assert len(met) == 400 and max(r["count"] for r in met) <= 64 * 3
    got = {}
    for r in spatial.knn_join(targets, points, 3).collect():
        got.setdefault(r.target_id, []).append(r.distance)
    p = points.toPandas()
    for i, x, y in targets.toPandas().itertuples(index=False):
        assert np.allclose(sorted(got[i]), np.sort(np.hypot(p["x"] - x, p["y"] - y))[:3])


def square(x0, y0, x1, y1):
    return [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


SCHEMA = "feature_id int, state string, class int, rings array<array<struct<x:double,y:double>>>"


def test_overlap(spark):
    size = 10.0
    whole = spark.createDataFrame([(1, "SP", 5, [square(-200.0, -200.0, 200.0, 200.0)])], SCHEMA)
    out = {r.cell_id: r.area for r in spatial.overlap_area(whole, size).collect()}
    assert out["0:0"] == pytest.approx(G.cell_area(size)) and sum(out.values()) <= 400 * 400 + 1e-6
    halves = spark.createDataFrame([(1, "SP", 5, [square(-200.0, -200.0, 0.0, 200.0)]), (2, "RJ", 1, [square(0.0, -200.0, 200.0, 200.0)])], SCHEMA)
    total = {}
    for r in spatial.overlap_area(halves, size).collect():
        total[r.cell_id] = total.get(r.cell_id, 0) + r.area
    assert total == pytest.approx(out)
    hole = spark.createDataFrame([(1, "SP", 5, [square(-200.0, -200.0, 200.0, 200.0), square(-5.0, -5.0, 5.0, 5.0)])], SCHEMA)
    got = {r.cell_id: r.area for r in spatial.overlap_area(hole, size).collect()}
    assert "0:0" not in got  # its centre is in the hole
    frac = {r.cell_id: r for r in spatial.reference_fractions(whole, size).collect()}
    assert frac["0:0"].high_fraction == pytest.approx(1) and frac["0:0"].state == "SP"
    concave = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (15.0, 8.0), (0.0, 30.0))]
    cut = spatial.overlap_area(spark.createDataFrame([(1, "SP", 5, [concave])], SCHEMA), 12.0).collect()
    rng = random.Random(2)
    inside = lambda x, y: y <= (30 - (22 / 15) * x if x < 15 else 8 + (22 / 15) * (x - 15))
    for r in cut[:3]:
        q, k = map(int, r.cell_id.split(":"))
        cx, cy = (q + k / 2) * math.sqrt(3) * 12, k * 18.0
        hits, n = 0, 40_000
        for _ in range(n):
            x, y = cx + rng.uniform(-12, 12), cy + rng.uniform(-12, 12)
            dx, dy = abs(x - cx), abs(y - cy)
            if dx <= 12 * math.sqrt(3) / 2 and dy <= 12 - dx / math.sqrt(3) and 0 <= x <= 30 and y >= 0 and inside(x, y):
                hits += 1
        assert r.area == pytest.approx(hits / n * 576, abs=12)


def test_rings(spark):
    line = [{"x": float(k), "y": 0.01 * (k % 2)} for k in range(50)] + [{"x": 49.0, "y": 20.0}, {"x": 0.0, "y": 20.0}]
    df = spark.createDataFrame([(1, "SP", 1, [line]), (2, "SP", 1, [square(0.0, 0.0, 0.0, 0.0)]), (3, "SP", 1, None), (4, "SP", 1, [])], SCHEMA)
    assert [r.feature_id for r in spatial.valid_polygons(df).collect()] == [1]
    thin = spatial.simplify_rings(df.filter("feature_id = 1"), 0.5).head()
    assert 4 <= len(thin.rings[0]) <= 6
    box = spatial.extent(spark.createDataFrame([(0.0, 0.0), (10.0, 20.0)], "x double, y double"), 0.1).head()
    assert box[:] == (-1.0, 11.0, -2.0, 22.0)
