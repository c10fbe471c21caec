"""Scalar rules, the grid and the fixtures that the survey restates."""

import math

import pytest
from pyspark.sql import functions as F

from gridindex.functions import grid as G
from gridindex.functions import scalars as S
from gridindex.operators import stats, tables
from gridindex.plans import index
from gridindex.sources.registry import Registry


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("out")).head()[0]


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_numbers(spark):
    assert rows(spark, [("1.5",), ("x",), (None,), ("NaN",)], "a string", S.to_num(F.col("a"))) == [(1.5,), (None,), (None,), (None,)]
    assert one(spark, S.to_num_comma(F.lit("1,5"))) == 1.5
    assert one(spark, S.safe_ratio(F.lit(1), F.lit(0))) == 0 and one(spark, S.safe_ratio(F.lit(None).cast("double"), F.lit(2))) == 0
    assert one(spark, S.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None and one(spark, S.clip(F.lit(3.0), 0.0, 1.0)) == 1
    assert [one(spark, S.canon_code(F.lit(x))) for x in ("1234567.0", " 42 ", "x")] == ["1234567", "0000042", None]
    assert [one(spark, S.income_weight(F.lit(x).cast("double"), 1212)) for x in (2424, 100, 0, None)] == [0.5, 1, 1, 1]


def test_rows(spark):
    data = [(1.0, 3.0), (None, 4.0), (None, None)]
    assert rows(spark, data, "a double, b double", S.row_mean(F.col("a"), F.col("b"))) == [(2.0,), (4.0,), (None,)]
    assert rows(spark, data, "a double, b double", S.row_count(F.col("a"), F.col("b"))) == [(4.0,), (4.0,), (None,)]
    assert rows(spark, data, "a double, b double", S.row_or(F.col("a"), F.col("b"))) == [(3.0,), (4.0,), (None,)]
    assert rows(spark, [("Sim",), ("Não",), ("?",)], "a string", S.yes_no(F.col("a"))) == [(1,), (0,), (None,)]


def test_texts(spark):
    assert S.standard_name("Município Área") == "município_área" and S.standard_name("População") == "populacao"
    assert one(spark, S.slug(F.lit("São João del-Rei"))) == "sao_joao_del_rei"
    assert [one(spark, S.classify_kind(F.lit(p))) for p in ("Deslizamento/Suscetibilidade_A.shp", "Inundacao/Apt_A.shp", "base.gpkg/HID_Massa_Dagua_A", "x/y")] == ["massa", "inundacao", "outros", "outros"]
    assert [one(spark, S.infer_class(F.lit(p))) for p in ("Corrida_massa", "suscet_x", "rios")] == [5, 4, None]
    assert [one(spark, S.class_ordinal(F.lit(x))) for x in ("Muito Alta", "MEDIA", "muito alta", "?")] == [5, 3, -1, -1]
    assert [one(spark, S.raster_class(F.lit("?"), F.lit(p))) for p in (3, 9)] == [3, -1]
    assert S.class_column(["x", "Suscet", "classe"]) == "classe" and S.class_column(["x"]) is None
    assert [one(spark, S.macro_region(F.lit(x))) for x in ("SP", "XX")] == ["SE", "?"]
    assert one(spark, S.municipality_of_stem(F.lit("sp_santos_massa"))) == "sp_santos"
    assert one(spark, S.with_precedence(F.lit(""), F.lit("b"))) == "b"
    assert [one(spark, S.truth_text(F.lit(x))) for x in ("Sim", "1", "no")] == [True, True, False]


def test_rules(spark):
    assert [one(spark, S.terrain_score(F.lit(h), F.lit(True))) for h in (-1.0, 1.0, 2.0, 5.0, 9.0)] == [None, 1, 0.66, 0.33, 0]
    assert [one(spark, S.clear_pixel(F.lit(q))) for q in (0, 8, 16, 4)] == [True, False, False, True]
    assert [one(spark, S.quality_status(F.lit(p), F.lit(z))) for p, z in ((0.0, 0.5), (0.0, 50.0), (1.0, 0.5), (1.0, 3.0), (1.0, 9.0))] == ["SPARSE", "COLLAPSE", "RISK", "SPARSE", "OK"]
    assert [one(spark, S.score_band(F.lit(x))) for x in (0.0, 0.33, 0.66, 0.9)] == ["zero", "low", "middle", "high"]
    score, flag = S.override(F.lit(0.2), F.lit(0.4), F.lit(0.5))
    assert one(spark, score) == 1 and one(spark, flag) is True
    assert one(spark, S.override(F.lit(0.2), F.lit(None).cast("double"), F.lit(0.5))[1]) is False
    bounds = F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))
    assert [one(spark, S.class_of(F.lit(v).cast("double"), bounds)) for v in (-1, 0.2, 0.5, 1, 7, None)] == [1, 2, 3, 5, 5, None]
    assert one(spark, S.number_text(F.lit(None).cast("double"))) == "-" and one(spark, S.class_label(bounds, F.lit(2))) == "0.200-0.400"


def test_grid(spark):
    assert len(G.offsets(3)) == 37
    x, y = G.center(F.lit("4:-7"), 25.0)
    assert one(spark, G.cell_of(x, y, 25.0)) == "4:-7"
    assert len(one(spark, G.grid_disk(F.lit("0:0"), 2))) == 19
    corners = one(spark, G.boundary(F.lit("0:0"), 2.0))
    area = sum(a.x * b.y - b.x * a.y for a, b in zip(corners, corners[1:] + corners[:1])) / 2
    assert math.isclose(area, G.cell_area(2.0))
    assert one(spark, G.boundary_wkt(F.lit("0:0"), 1.0)).startswith("POLYGON((0.866025 0.500000, ")
    G.register(spark, 25.0)
    p = spark.range(500).select((F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000 - 500).alias("y"))
    assert p.filter(F.expr("cell_of(x, y)") != G.cell_of(F.col("x"), F.col("y"), 25.0)).count() == 0
    assert spark.sql("SELECT row_mean(array(1, NULL, 4, 4)) a, row_mean(array(CAST(NULL AS DOUBLE))) b, size(grid_disk('1:2', 1)) c, size(grid_disk('1:2', 3)) d, cell_of(NULL, 1) e").head()[:] == (3.0, None, 7, 37, None)
    assert set(spark.sql("SELECT grid_disk('1:-2', 2)").head()[0]) == set(one(spark, G.grid_disk(F.lit("1:-2"), 2)))


MINMAX = [([0, 5, 10], [0, 0.5, 1]), ([3, 3, 3], [0, 0, 0]), ([0, None, 10], [0, None, 1]), ([3, None, 3], [0, 0, 0]), ([None, None], [None, None])]


@pytest.mark.parametrize("values,want", MINMAX)
def test_minmax(spark, values, want):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    assert [r.v_norm for r in stats.normalize_minmax(df, ["v"]).orderBy("i").collect()] == want


def test_minmax_winsor(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(100), 9999])], "i int, v double")
    plain, cut = ([r.v_norm for r in stats.normalize_minmax(df, ["v"], w).orderBy("i").collect()] for w in (None, (0.01, 0.99)))
    assert plain[-1] == cut[-1] == 1 and cut[50] > plain[50]
    text = spark.createDataFrame([("0",), ("invalid",), ("10",)], "v string")
    assert sorted(r.v_norm is None for r in stats.normalize_minmax(text, ["v"]).collect()) == [False, False, True]
    exact, ranged = (tables.quantiles(df, "v", [0.01, 0.5, 0.99], m) for m in ("exact", "sorted"))
    assert exact == pytest.approx(ranged)


REGISTRY = Registry.from_dict({"dimensions": {d: {"abbr": a, "invert": a == "IG", "indicators": {f"{k}{n}": {"abbr": "x", "source": {}} for n in (1, 2)}} for d, a, k in (("p", "IP", "p"), ("v", "IV", "v"), ("g", "IG", "g"))}})


def test_scores(spark):
    names = [i.normalised for i in REGISTRY.indicators]
    data = [("a", 0.0, 0.0, 0.2, 0.2, 0.0, 0.0), ("b", 0.5, 0.5, 0.4, 0.4, 0.5, 0.5), ("c", 1.0, 1.0, 0.6, 0.6, 1.0, 1.0)]
    df = spark.createDataFrame(data, "h string, " + ", ".join(f"{n} double" for n in names))
    out = {r.h: (r.ip, r.iv, r.ig, r.final_index) for r in index.dimension_scores(df, REGISTRY).collect()}
    assert out["a"] == pytest.approx((0, 0.2, 1, 0.4)) and out["b"] == pytest.approx((0.5, 0.4, 0.5, 0.466667), abs=1e-6) and out["c"] == pytest.approx((1, 0.6, 0, 0.533333), abs=1e-6)
    gone = index.dimension_scores(df.drop(*names[4:]), REGISTRY)
    assert "ig" not in gone.columns and "final_index" in gone.columns
    part = index.dimension_scores(df.withColumn(names[0], F.when(F.col("h") != "a", F.col(names[0]))), REGISTRY)
    assert part.filter("h = 'a'").head().ip == 0
    assert REGISTRY.effective_weights()["p1"] == pytest.approx(100 / 6)
    with pytest.raises(ValueError, match="abbr"):
        Registry.from_dict({"dimensions": {"x": {"indicators": {"k": {"source": {}}}}}})


def test_tables(spark):
    a, b = (spark.createDataFrame([(x,) for x in c], "k string") for c in (["1234567", "7654321"], ["123456"]))
    assert [r.k for r in tables.harmonise_code_length(a, b, "k")[0].orderBy("k").collect()] == ["123456", "765432"]
    cells = spark.createDataFrame([("a", "SP", 4, 2.0), ("a", "RJ", 1, 3.0), ("a", "RJ", -1, 9.0)], "cell_id string, state string, class int, area double")
    r = tables.with_fractions(tables.area_by_cell(cells), 10.0).head()
    assert (r.state, r.area, r.high_area, r.max_class, r.n_records, r.coverage) == ("RJ", 5.0, 2.0, 4, 2, 0.5)
    funnel = tables.stage_funnel(spark.createDataFrame([(True, True), (True, False), (False, None)], "a boolean, b boolean"), ["a", "b"]).orderBy("step").collect()
    assert [(x.ok, x.failed, x.n_a, x.dropout) for x in funnel] == [(2, 1, 0, 0), (1, 1, 1, 1)]
    assert tables.column_frequency(spark.createDataFrame([("a|b",), ("b",)], "c string"), "c").head()[:] == ("b", 2)
    manifest = spark.createDataFrame([("1", "m", "ok"), ("1", "m", "error"), ("2", "m", "ok"), ("3", "m", "sem_dado"), ("4", "m", "ok"), ("5", "m", "ok")], "cd_mun string, tipo string, status string")
    coverage = spark.createDataFrame([("2", "m", True, "ok"), ("4", "m", False, "ok"), ("5", "m", True, "ok")], "cd_mun string, tipo string, has_tipo boolean, status_zip string")
    done = spark.createDataFrame([("2", "m")], "cd_mun string, tipo string")
    failures = spark.createDataFrame([("5", "m", 1, "x"), ("5", "m", 2, "y")], "cd_mun string, tipo string, timestamp int, reason string")
    status = index.pipeline_status(manifest, coverage, done, failures, done, failures.limit(0))
    out = {r.cd_mun: (r.download, r.explore, r.extract, r.harmonise, r.in_pipeline, r.last_failure_stage, r.last_failure_reason) for r in status.collect()}
    assert out == {
        "1": ("error", "not_processed", "not_processed", "not_processed", False, "download", "download failed"), "2": ("ok", "ok", "ok", "ok", True, "", ""), "3": ("sem_dado", "n_a", "n_a", "n_a", False, "", ""),
        "4": ("ok", "n_a", "n_a", "n_a", False, "", ""), "5": ("ok", "ok", "failed", "not_processed", False, "extract", "y"),
    }
    assert [(r.stage, r.ok, r.failed, r.n_a, r.dropout) for r in index.status_summary(status).collect()] == [("download", 3, 1, 0, 0), ("explore", 2, 0, 2, 1), ("extract", 1, 1, 2, 1), ("harmonise", 1, 0, 2, 0)]
    assert tables.both_or_neither(status, "cd_mun", "tipo", F.col("in_pipeline")).head()[:] == (1, 4)
