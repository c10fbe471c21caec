"""Whole runs: quality while writing, report tables."""

from pyspark.sql import functions as F

from gridindex.operators import stats
from gridindex.plans import index
from gridindex.sources.registry import Registry
from gridindex.sources.sinks import save_table

REGISTRY = Registry.from_dict({"file_prefix": "t", "dimensions": {
    "a": {"abbr": "IA", "indicators": {"a1": {"abbr": "x", "source": {}}, "a2": {"abbr": "y", "source": {}}}},
    "b": {"abbr": "IB", "invert": True, "indicators": {"b1": {"abbr": "z", "source": {}}}},
}})


def test_quality_is_taken_while_writing(spark, tmp_path):
    rows = spark.range(1000).withColumnRenamed("id", "cell_id")
    values = {"a1": F.col("cell_id") / 999, "a2": F.when(F.col("cell_id") < 3, 0.5).otherwise(0.0), "b1": F.when(F.col("cell_id") % 10 > 0, (F.col("cell_id") % 7) / 5)}
    for i in REGISTRY.indicators:
        save_table(rows.select("cell_id", values[i.key].cast("double").alias(i.normalised)), f"{tmp_path}/{REGISTRY.file_name(i)}")
    read = spark.sparkContext.accumulator(0)
    base = rows.rdd.map(lambda r: (read.add(1), r)[1]).toDF("cell_id long")
    path, _ = index.run_index(spark, REGISTRY, str(tmp_path), base, f"{tmp_path}/out", "1")
    assert read.value == 1000  # neither the quality table nor the extracts read the inputs again
    q = {r.name: r for r in spark.read.parquet(f"{tmp_path}/out/quality_1").collect()}
    saved = spark.read.parquet(path)
    for name, r in q.items():
        v = saved.agg(F.count(name), F.count_if(F.col(name) > 0), F.min(name), F.max(name), F.avg(name)).head()
        assert (r.n, r.positive, r.low, r.high) == v[:4] and abs(r["mean"] - v[4]) < 1e-12
    assert [q[i.normalised].status for i in REGISTRY.indicators] == ["OK", "SPARSE", "RANGE"]
    whole = saved.dropna(subset=["ia", "ib"])
    sd = whole.agg(F.stddev("ia").alias("ia"), F.stddev("ib").alias("ib")).head()
    assert abs(q["ia"].weight - (1 / sd.ia) / (1 / sd.ia + 1 / sd.ib)) < 1e-12 and abs(q["ia"].weight + q["ib"].weight - 1) < 1e-12
    r = whole.withColumn("e", F.col("ia") * q["ia"].weight + F.col("ib") * q["ib"].weight).agg(F.corr("final_index", "e")).head()[0]
    assert abs(q["final_index"].equalised_r - r) < 1e-9


def test_all_report_tables_are_one_exchange(spark):
    cells = spark.range(500).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("region"), (F.col("id") % 2).cast("string").alias("size_class"), (F.col("id") / 499).alias("score"), F.when(F.col("id") % 5 > 0, F.col("id")).cast("double").alias("v"))
    bounds = spark.createDataFrame([("0", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])], "size_class string, bounds array<double>")
    out = index.report_tables(cells, F.broadcast(bounds), [(), ("region",)], "score", "size_class", ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1
    rows = {(r.level, r.region, r.size_class, r["class"]): r for r in out.collect()}
    assert rows["all", None, None, None].n == 500 and rows["region", "1", None, None].n == 167
    assert sum(r.n for k, r in rows.items() if k[0] == "size_class+class") == 500
    assert abs(rows["all", None, None, None].v_mean - cells.agg(F.avg("v")).head()[0]) < 1e-9


def test_candidates_without_region_only_fill_up(spark):
    rows = [(i, 0, None if i == 9 else "N", "S", float(i)) for i in range(10)]
    got = index.candidates(spark.createDataFrame(rows, "id int, cluster int, region string, size_class string, score double"), most=3).collect()
    assert [(r.id, r["pass"]) for r in sorted(got, key=lambda r: r.candidate_rank)] == [(8, 1), (9, 2), (7, 2)]
    assert stats.kmeans(spark.createDataFrame([(1, None)], "id int, a double"), ["a"], "a", "id").count() == 0
