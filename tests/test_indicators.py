"""Indicators by key over small inputs, and the plan of an index."""

import pytest
from pyspark.sql import functions as F

from gridindex.operators import tables
from gridindex.plans import index, indicators
from gridindex.sources.registry import Registry

SOURCES = {
    "p4": {"num_cols": ["v1_ren"], "den_cols": ["v2"]}, "v1": {"num_cols": ["v06004_v2"], "den_cols": ["v2"], "cap_abs": 2424, "invert_norm": True},
    "v4": {"k_nearest": 3}, "e1": {"value": "v"}, "e2": {"sgb_coverage_min": 0.5}, "e3": {"coastal": True}, "e4": {"anomaly": True, "value": "v"}, "e5": {"k_ring": 1, "year_start": 2016, "year_end": 2019, "min_years": 2},
    "g1": {"filter_column": "L", "filter_account": "18 - Gest"}, "g4": {"cols": ["a", "b"], "type": "binary"}, "g7": {"col": "v7", "type": "binary"}, "g8": {"cols": ["a", "b"], "type": "count"},
}
REGISTRY = Registry.from_dict({"dimensions": {"d": {"abbr": "D", "indicators": {k: {"abbr": "x", "source": s} for k, s in SOURCES.items()}}}})


def get(spark, key, **inputs):
    return {r.cell_id: (r.abs_value, r.norm_value) for r in indicators.indicator(spark, REGISTRY, key, inputs).collect()}


def test_census(spark):
    pairs = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u"), ("z", "u")], "cell_id string, tract_id string")
    households = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("z", 0.0)], "cell_id string, households double")
    base = index.dasymetric_base(pairs, households)
    weights = {(r.cell_id, r.tract_id): r.weight for r in base.collect()}
    assert weights == {("a", "t"): 0.75, ("b", "t"): 0.25, ("b", "u"): 1.0}
    tracts = spark.createDataFrame([("t", "10", "20", "2424,0"), ("u", "x", "40", "606,0")], "tract_id string, v1 string, v2 string, v06004 string")
    p4 = get(spark, "p4", base=base, tracts=tracts)
    assert p4["a"][0] == pytest.approx(0.25) and p4["b"][0] == pytest.approx(0.25 * 5 / (5 + 40))
    v1 = get(spark, "v1", base=base, tracts=tracts)
    assert v1["a"][0] == pytest.approx(2424) and v1["a"][1] == pytest.approx(0) and v1["b"][1] == pytest.approx(1)


def test_exposure(spark):
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string")
    zonal = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "cell_id string, v double")
    assert get(spark, "e1", zonal=zonal, grid=grid) == {"a": (1, 1), "b": (0, 0), "c": (None, None)}
    heat = spark.createDataFrame([("a", -1.0), ("b", 3.0), ("c", None)], "cell_id string, v double")
    assert get(spark, "e4", zonal=heat, grid=grid)["a"][0] == 0 and get(spark, "e4", zonal=heat, grid=grid)["c"] == (None, None)
    flood = zonal.withColumnRenamed("v", "flood_score")
    reference = spark.createDataFrame([("b", 0.4, 0.9)], "cell_id string, high_fraction double, coverage double")
    assert get(spark, "e2", zonal=flood, reference=reference, grid=grid)["b"][0] == 1
    sea = spark.createDataFrame([("a", 0.0, 0.7), ("b", 5.0, 0.7)], "cell_id string, households double, risk double")
    assert get(spark, "e3", zonal=sea, grid=grid) == {"a": (0, 0), "b": (0.7, 1), "c": (None, None)}
    events = spark.createDataFrame([(2016, 0.0, 0.0), (2017, 1.0, 1.0), (2016, 500.0, 0.0)], "year int, x double, y double")
    base = spark.createDataFrame([("0:0",), ("1:0",), ("12:0",)], "cell_id string")
    fire = get(spark, "e5", events=events, base=base, found_years=2, cell_size=25.0)
    assert fire["0:0"][0] == 1 and fire["1:0"][0] == 1 and fire["12:0"][0] == 0.5


def test_municipal(spark):
    cells = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "9")], "cell_id string, cd_mun string")
    survey = spark.createDataFrame([("1", "Sim", "Não"), ("2", "Não", "?")], "cd_mun string, a string, b string")
    assert get(spark, "g4", cells=cells, survey=survey) == {"a": (1, 1), "b": (1, 1), "c": (0, 0), "d": (None, None)}
    assert get(spark, "g8", cells=cells, survey=survey)["a"] == (1, 1)
    lists = [spark.createDataFrame([("1", "0"), ("1", "1")], "cod_mun string, v7 string"), spark.createDataFrame([("2", "0")], "cod_mun string, v7 string")]
    assert get(spark, "g7", cells=cells, lists=lists)["a"] == (1, 1)
    ledger = spark.createDataFrame([("L", "18 - Gestão", "10,5", "2", "1"), ("L", "18 - Gestão", "0", "0", "1"), ("X", "18 - Gestão", "9", "1", "1")], "coluna string, conta string, valor string, populacao string, cod_ibge string")
    g1 = get(spark, "g1", cells=cells, ledger=ledger)
    assert g1["d"][0] == 0 and g1["a"][1] == 1
    points = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 900.0, 0.0, 1.0)], "point_id int, x double, y double, capacity double")
    targets = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5000.0, 0.0)], "target_id string, x double, y double")
    v4 = get(spark, "v4", cells=targets, facilities=points)
    assert v4["a"][0] == pytest.approx(2 / 100 + 1 / 1000) and v4["a"][1] < v4["b"][1]


def test_partitions_and_plan(spark, tmp_path):
    long = spark.createDataFrame([("p1", "a", 1.0), ("p2", "a", 2.0)], "indicator string, cell_id string, abs_value double")
    indicators.save_indicators(long, f"{tmp_path}/i")
    indicators.save_indicators(long.filter("indicator = 'p2'").withColumn("abs_value", F.lit(9.0)), f"{tmp_path}/i")
    assert {(r.indicator, r.abs_value) for r in spark.read.parquet(f"{tmp_path}/i").collect()} == {("p1", 1.0), ("p2", 9.0)}
    files = {f"k{n}": spark.range(100).select(F.col("id").alias("cell_id"), F.rand(n).alias("value")) for n in range(6)}
    merged = tables.merge_indicators(spark.range(100).select(F.col("id").alias("cell_id")), files)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # six tables, one aggregate and one join
    assert indicators.reviewable(spark.createDataFrame([("massa", False), ("massa", True), ("outros", None)], "kind string, error boolean")).count() == 1


def test_gravity_is_worked_out_once(spark):
    """The limits and the scaled values read one table of scores, not the nearest facilities twice."""
    cells = spark.createDataFrame([(k, float(k), 0.0) for k in range(40)], "target_id int, x double, y double")
    out = index.health_indicator(cells, cells.selectExpr("target_id AS point_id", "x", "y", "1 AS capacity"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    norm = {r.cell_id: r.norm_value for r in out.collect()}
    assert len(norm) == 40 and norm[0] == norm[39] == 1.0 and norm[20] < 0.01


def test_equal_scores_are_not_below_their_mean(spark):
    """Three times 0.1 has a mean a little above 0.1."""
    cells = spark.createDataFrame([(k, "a" if k < 3 else "b", 0.1 if k < 3 else 0.9) for k in range(6)], "cell_id int, muni string, score double")
    out = index.report(cells.withColumn("size", F.lit("s")), [(), ("muni",)], "score", "size", [])
    assert {(r.level, r.muni): r.percent_below for r in out.filter("level <> 'size+class'").collect()} == {("all", None): 50.0, ("muni", "a"): 0.0, ("muni", "b"): 50.0}


def test_census_sums_are_worked_out_once(spark):
    """The limits and the scaled values read one table of sums, not the joins twice."""
    base = spark.createDataFrame([(k, k % 4, 0.25) for k in range(40)], "cell_id int, tract_id int, weight double")
    tracts = spark.createDataFrame([(k, 10.0 + k, 5.0, 900.0) for k in range(4)], "tract_id int, v1 double, v2 double, v06004 double")
    for out in (indicators.census_indicators(base, tracts, REGISTRY, 1000.0, ["p4", "v1"]), index.ratio_indicator(base.join(tracts, "tract_id"), ["v1"], ["v2"])):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.filter("abs_value IS NOT NULL").count() in (40, 80)
