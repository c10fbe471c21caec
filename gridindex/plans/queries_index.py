"""Registered queries of the composed plans: indicators by registry key, the index run, validation, calibration and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.functions import scalars as S
from gridindex.operators import spatial, stats, tables
from gridindex.plans import index, indicators
from gridindex.plans.catalog import query
from gridindex.plans.queries import _F1, _MERGED, _POINTS, _SCORED, REGISTRY, _merged, _points, _r, _scaled_sql, _scored, _t
from gridindex.shared import scratch
from gridindex.sources import readers, sinks
from gridindex.sources.registry import Registry

RUN = Registry.from_dict({"file_prefix": "br", "dimensions": {
    "priority": {"abbr": "IP", "indicators": {"p1": {"abbr": "disc", "source": {}}, "p2": {"abbr": "tax", "source": {}}}},
    "exposure": {"abbr": "IE", "indicators": {"e1": {"abbr": "ret", "source": {}}, "e9": {"abbr": "none", "source": {}}}},
    "governance": {"abbr": "IG", "invert": True, "indicators": {"g1": {"abbr": "qty", "source": {}}, "g8": {"abbr": "other", "source": {}}}},
    "absent": {"abbr": "IX", "indicators": {"x1": {"abbr": "none", "source": {}}}},
}})
_RUN_VALUES = {"p1": "l_discount * 10", "p2": "l_tax * 12", "e1": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", "g1": "l_quantity / 50"}
_RUN_SQL = f"""WITH m AS (SELECT l_orderkey AS k, {', '.join(f"avg({v}) FILTER (l_returnflag <> '{f}') AS {i}" for (i, v), f in zip(_RUN_VALUES.items(), 'ANXX'))} FROM lineitem GROUP BY 1),
 d AS (SELECT o_orderkey AS cell_id, o_orderstatus AS status, (coalesce(p1, 0) + coalesce(p2, 0)) / nullif((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT, 0) AS ip, e1 AS ie, 1 - g1 AS ig FROM orders LEFT JOIN m ON k = o_orderkey),
 f AS (SELECT *, (coalesce(ip, 0) + coalesce(ie, 0) + coalesce(ig, 0)) / nullif((ip IS NOT NULL)::INT + (ie IS NOT NULL)::INT + (ig IS NOT NULL)::INT, 0) AS final_index FROM d)"""


def _run(spark: SparkSession, sf: str) -> str:
    """Indicator files (with repeated cells; one file is missing, one lacks its column) and a run over them; returns where it wrote."""
    path, line = scratch(spark, "index"), _t(spark, sf, "lineitem")
    for (key, value), flag in zip(_RUN_VALUES.items(), "ANXX", strict=True):
        i = next(i for i in RUN.indicators if i.key == key)
        sinks.save_table(line.filter(F.col("l_returnflag") != flag).select(F.col("l_orderkey").alias("cell_id"), F.expr(value).cast("double").alias(i.normalised)), f"{path}/{RUN.file_name(i)}")
    wrong = next(i for i in RUN.indicators if i.key == "g8")
    sinks.save_table(line.select(F.col("l_orderkey").alias("cell_id"), F.col("l_tax").alias("unnamed")), f"{path}/{RUN.file_name(wrong)}")
    base = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("status"))
    _, missing = index.run_index(spark, RUN, path, base.unionAll(base), f"{path}/out", "2024", ids=["status"])
    if sorted(missing) != ["e9", "g8", "x1"]:
        raise AssertionError(missing)
    return f"{path}/out"


@query("index_run", f"{_RUN_SQL} SELECT cell_id, status, round(ip, 6) AS ip, round(ie, 6) AS ie, round(ig, 6) AS ig, round(final_index, 6) AS final_index FROM f")
def index_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run, from files by registry to the newest saved result."""
    saved = readers.read_table(spark, readers.latest_run(spark, _run(spark, sf), "run_id="))
    return _r(readers.select_existing(saved, ["cell_id", "status", "ip", "ie", "ig", "ix", "final_index"]))


@query("index_extracts", f"{_RUN_SQL} SELECT round(sum(final_index::FLOAT::DOUBLE), 3) AS slim, count(*) AS n, (SELECT round(sum(avg_p1::FLOAT::DOUBLE), 3) FROM (SELECT avg(l_discount * 10) AS avg_p1 FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey)) AS slice FROM f")
def index_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """The slim extract and a dimension's slice, in single precision, added up."""
    out = _run(spark, sf)
    slim = readers.read_table(spark, f"{out}/dashboard_2024", ["cell_id", "final_index"])
    part = readers.read_table(spark, f"{out}/slices_2024/dim_ip_01", ["cell_id", "p1_disc_norm"]).agg(F.round(F.sum(F.col("p1_disc_norm").cast("double")), 3).alias("slice"))  # one row
    return slim.agg(F.round(F.sum(F.col("final_index").cast("double")), 3).alias("slim"), F.count("*").alias("n")).crossJoin(F.broadcast(part))


@query("index_contributions", f"WITH {_MERGED} SELECT * FROM (SELECT 'e1' AS indicator, round(100 / 3.0 / 2, 6) AS weight, round(avg(qty), 6) AS mean FROM merged UNION ALL SELECT 'e2', round(100 / 3.0 / 2, 6), round(avg(disc), 6) FROM merged UNION ALL SELECT 'g1', round(100 / 3.0 / 2, 6), round(avg(tax), 6) FROM merged)")
def index_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """What share of the final score each indicator carries, beside its mean."""
    weights, columns = REGISTRY.effective_weights(), {"e1": "qty", "e2": "disc", "g1": "tax"}
    one = _merged(spark, sf).agg(*(F.avg(c).alias(k) for k, c in columns.items()))
    return _r(one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("indicator"), F.lit(weights[k]).alias("weight"), F.col(k).alias("mean")) for k in columns))).alias("r")).select("r.*"))


# indicators


_GRAVITY = f"""{_POINTS}, d AS (SELECT t.vec_id, p.vec_id AS pid, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) AS dist, p.vec_id % 6 + 1 AS capacity FROM points t, points p WHERE p.label = 0),
 k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, pid) <= 3), v AS (SELECT vec_id AS cell_id, sum(capacity / (dist + 100)) AS x FROM k GROUP BY 1)"""


def _health(spark: SparkSession, sf: str, by_rank: bool) -> DataFrame:
    points = _points(spark, sf)
    facilities = points.filter("label = 0").select(F.col("vec_id").alias("point_id"), "x", "y", (F.col("vec_id") % 6 + 1).alias("capacity"))
    return _r(index.health_indicator(points.select(F.col("vec_id").alias("target_id"), "x", "y"), facilities, by_rank).withColumn("norm_value", F.col("norm_value").cast("double")))


@query("health_access", f"WITH {_GRAVITY}, {_scaled_sql('x', 0.03, 0.97)} SELECT cell_id, round(x, 6) AS abs_value, round(1 - norm, 6) AS norm_value FROM scaled")
def health_access(spark: SparkSession, sf: str) -> DataFrame:
    """Inaccessibility of facilities, winsorised."""
    return _health(spark, sf, False)


@query("health_access_rank", f"WITH {_GRAVITY} SELECT cell_id, round(x, 6) AS abs_value, round(1 - (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER (), 6)::DOUBLE AS norm_value FROM v")
def health_access_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The same by percentile rank."""
    return _health(spark, sf, True)


_REFERENCE = "f AS (SELECT l_orderkey AS cell_id, avg((l_returnflag = 'R')::INT) AS high, avg((l_linestatus = 'F')::INT) AS cov FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)"


@query("flood_override", f"""WITH o AS (SELECT l_orderkey AS cell_id, max(CASE WHEN l_tax > 0 THEN l_discount * 5 END) AS score FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), {_REFERENCE},
 z AS (SELECT cell_id, coalesce(high > 0.3 AND cov >= 0.5, false) AS flag, CASE WHEN coalesce(high > 0.3 AND cov >= 0.5, false) THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS x FROM o LEFT JOIN f USING (cell_id)), {_scaled_sql('x', 0, 1, 'z')}
 SELECT o_orderkey AS cell_id, round(x, 6) AS abs_value, flag AS overridden, round(norm, 6) AS norm_value FROM orders LEFT JOIN scaled ON cell_id = o_orderkey""")
def flood_override(spark: SparkSession, sf: str) -> DataFrame:
    """Flood scores with border duplicates, set to 1 where the reference map says so; uncovered cells stay missing."""
    line = _t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "cell_id")
    zonal = line.filter("l_linenumber <= 3").select("cell_id", F.when(F.col("l_tax") > 0, F.col("l_discount") * 5).alias("flood_score"))
    reference = line.filter("l_returnflag <> 'A'").groupBy("cell_id").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("high_fraction"), F.avg((F.col("l_linestatus") == "F").cast("int")).alias("coverage"))
    out = index.flood_indicator(zonal, reference, _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id")))
    return _r(out.select("cell_id", "abs_value", "overridden", "norm_value"))


@query("sea_level", f"""WITH z AS (SELECT o_orderkey AS cell_id, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 500000 ELSE 0 END AS x FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), {_scaled_sql('x', 0, 1, 'z')}
 SELECT o_orderkey AS cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM orders LEFT JOIN scaled ON cell_id = o_orderkey""")
def sea_level(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of the coastal municipalities' cells, 0 where nobody lives; inland the indicator does not apply."""
    cells = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("muni"), (F.col("o_totalprice") - 100_000).alias("households"), (F.col("o_totalprice") / 500_000).alias("risk"))
    coastal = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("muni"))
    return _r(index.sea_indicator(index.coastal_only(cells, coastal, "muni"), cells))


@query("heat_anomaly", f"""WITH z AS (SELECT l_partkey AS cell_id, CASE WHEN a IS NULL THEN NULL ELSE greatest(a, 0) END AS x FROM (SELECT l_partkey, avg(l_quantity) FILTER (year(l_shipdate) BETWEEN 1999 AND 2001) - avg(l_quantity) FILTER (year(l_shipdate) BETWEEN 1995 AND 1997) AS a FROM lineitem GROUP BY 1)), {_scaled_sql('x', 0.01, 0.99, 'z')}
 SELECT p_partkey AS cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM part LEFT JOIN scaled ON cell_id = p_partkey""")
def heat_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    """Warming between two periods, cooling as 0, winsorised; cells without one stay missing."""
    line = _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_shipdate").withColumnRenamed("l_partkey", "cell_id")
    zonal = spatial.two_period_anomaly(line, "cell_id", F.year("l_shipdate"), F.col("l_quantity"), (1995, 1997), (1999, 2001))
    return _r(index.exposure_indicator(zonal, "anomaly", _t(spark, sf, "part").select(F.col("p_partkey").alias("cell_id")), fill=None, floor=0.0, winsorize=index.WINSOR))


SURVEY = Registry.from_dict({"dimensions": {"g": {"abbr": "IG", "indicators": {
    "g2": {"abbr": "plan", "source": {"col": "a", "type": "binary"}}, "g3": {"abbr": "warn", "source": {"col": "b", "type": "binary"}}, "g5": {"abbr": "fund", "source": {"col": "c", "type": "binary"}}, "g6": {"abbr": "team", "source": {"cols": ["b", "c"], "type": "binary"}}, "g4": {"abbr": "cons", "source": {"cols": ["a", "b"], "type": "binary"}},
    "g7": {"abbr": "reg", "source": {"col": "v", "type": "binary"}}, "g8": {"abbr": "prog", "source": {"cols": ["a", "b", "c"], "type": "count"}},
}}}})
_ANSWERS = "s AS (SELECT c_custkey AS muni, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END AS a, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 END AS b, CASE WHEN c_nationkey < 5 THEN 1 WHEN c_nationkey < 20 THEN 0 END AS c FROM customer)"


def _binary_sql(key: str, value: str) -> str:
    return f"SELECT '{key}' AS indicator, o_orderkey AS cell_id, ({value})::DOUBLE AS abs_value, ({value})::DOUBLE AS norm_value FROM orders LEFT JOIN s ON muni = o_custkey"


@query("survey_indicators", f"""WITH {_ANSWERS} {_binary_sql('g2', 'a')} UNION ALL {_binary_sql('g3', 'b')} UNION ALL {_binary_sql('g5', 'c')} UNION ALL {_binary_sql('g6', 'greatest(b, c)')} UNION ALL {_binary_sql('g4', 'greatest(a, b)')}
 UNION ALL SELECT 'g8', o_orderkey, x, round(norm, 6) FROM orders LEFT JOIN (WITH v AS (SELECT muni, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::DOUBLE END AS x FROM s), {_scaled_sql('x', 0.01, 0.99)} SELECT * FROM scaled) ON muni = o_custkey""")
def survey_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """A survey's answers by municipality as binary and counted indicators of its cells; counts are scaled over municipalities."""
    c = _t(spark, sf, "customer")
    yes = lambda on, off: F.when(on, "Sim").when(off, "Não").otherwise("-")
    survey = c.select(F.col("c_custkey").alias("cd_mun"), yes(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "MACHINERY").alias("a"), yes(F.col("c_acctbal") > 5000, F.col("c_acctbal") > 0).alias("b"), yes(F.col("c_nationkey") < 5, F.col("c_nationkey") < 20).alias("c"))
    cells = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("cd_mun"))
    out = [indicators.indicator(spark, SURVEY, k, {"cells": cells, "survey": survey}).select(F.lit(k).alias("indicator"), "cell_id", F.col("abs_value").cast("double").alias("abs_value"), F.col("norm_value").cast("double").alias("norm_value")) for k in ("g2", "g3", "g4", "g5", "g6", "g8")]
    return _r(tables.union_all(out))


@query("family_register", "WITH l AS (SELECT o_custkey AS muni, max(CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o_orderkey AS cell_id, v AS abs_value, v AS norm_value FROM orders LEFT JOIN l ON muni = o_custkey")
def family_register(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists with repeated municipalities: the greatest value counts."""
    o = _t(spark, sf, "orders")
    part = lambda status: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("cod_mun"), F.when(F.col("o_totalprice") > 400_000, "1").otherwise("0").alias("v"))
    cells = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("cd_mun"))
    return indicators.indicator(spark, SURVEY, "g7", {"cells": cells, "lists": [part("F"), part("O")]})


# validation


def _sweep_sql(score: str, thresholds: str) -> str:
    return f"SELECT t AS threshold, tp, fp, fn, {_F1} FROM (SELECT t, count_if({score} > t AND reference) AS tp, count_if({score} > t AND NOT reference) AS fp, count_if(NOT {score} > t AND reference) AS fn FROM rows, ({thresholds}) GROUP BY 1)"


_ROWS = f"{_SCORED}, rows AS (SELECT *, 1 + 4 * score AS level FROM scored WHERE NOT used AND coverage >= 0.5)"
_FIFTHS, _QUARTERS = "SELECT i / 20.0::DOUBLE AS t FROM generate_series(0, 20) g(i)", "SELECT (1 + i / 4.0)::DOUBLE AS t FROM generate_series(0, 16) g(i)"


@query("top_thresholds", f"WITH {_ROWS}, w AS ({_sweep_sql('score', _FIFTHS)}) SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 12) DESC, threshold)::INT AS rank FROM w ORDER BY rank LIMIT 10")
def top_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the ten best thresholds."""
    rows = _scored(spark, sf).filter("coverage >= 0.5 AND NOT used")
    return _r(stats.top_thresholds(stats.threshold_sweep(rows, "score", "reference", [i / 20 for i in range(21)])).select("threshold", "f1", "rank"))


@query("calibration", f"""WITH {_ROWS}, w AS ({_sweep_sql('score', _FIFTHS)}), best AS (SELECT threshold, f1 FROM w ORDER BY round(f1, 12) DESC, threshold LIMIT 1),
 w2 AS ({_sweep_sql('level', _QUARTERS)}), best2 AS (SELECT threshold, f1 FROM w2 ORDER BY round(f1, 12) DESC, threshold LIMIT 1),
 c AS (SELECT region, count_if(score > threshold AND reference) AS tp, count_if(score > threshold AND NOT reference) AS fp, count_if(NOT score > threshold AND reference) AS fn, avg((score = 0)::INT) FILTER (reference AND NOT score > threshold) AS zero FROM rows, best GROUP BY 1), g AS (SELECT *, {_F1} FROM c)
 SELECT 'threshold' AS kind, (best.threshold)::VARCHAR AS subject, round(best.f1 - w.f1, 6) AS amount FROM best, w WHERE w.threshold = 0.5 AND best.f1 - w.f1 > 0.02
 UNION ALL SELECT 'weak region', region, round((SELECT max(f1) FROM g) - f1, 6) FROM g WHERE f1 < (SELECT max(f1) FROM g) - 0.15
 UNION ALL SELECT 'zero scores', region, round(zero, 6) FROM g WHERE zero > 0.7 UNION ALL SELECT 'secondary predictor', best2.threshold::VARCHAR, round(best2.f1 - best.f1, 6) FROM best, best2 WHERE best2.f1 - best.f1 > 0.02""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """What a validation of the score, and of a secondary predictor (a level of 1 to 5), suggests."""
    rows = _scored(spark, sf).withColumn("level", 1 + 4 * F.col("score"))
    return _r(index.calibration(rows, "score", "level", "reference", "coverage", "used", "region", 0.5))


# archives and their status


_STATUS = """WITH k AS (SELECT l_suppkey::VARCHAR AS cd_mun, CASE WHEN l_linenumber <= 3 THEN 'massa' ELSE 'inundacao' END AS tipo, * FROM lineitem),
 m AS (SELECT cd_mun, tipo, CASE WHEN bool_or(l_quantity > 49.5) THEN 'error' WHEN bool_or(l_quantity < 1.5) THEN 'sem_dado' ELSE 'ok' END AS download FROM k GROUP BY 1, 2),
 c AS (SELECT cd_mun, tipo, bool_or(l_discount > 0.095) AS has_tipo, bool_or(l_tax > 0.005) AS zip_ok FROM k WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1, 2),
 e AS (SELECT DISTINCT cd_mun, tipo FROM k WHERE l_returnflag = 'A' AND l_quantity > 45), h AS (SELECT DISTINCT cd_mun, tipo FROM k WHERE l_returnflag = 'N' AND l_quantity > 45),
 fe AS (SELECT cd_mun, tipo, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS r FROM k WHERE l_quantity BETWEEN 2 AND 4 GROUP BY 1, 2), fh AS (SELECT cd_mun, tipo, arg_max(l_linestatus, (l_shipdate, l_linestatus)) AS r FROM k WHERE l_quantity BETWEEN 5 AND 7 GROUP BY 1, 2),
 x AS (SELECT m.*, CASE WHEN zip_ok IS NULL THEN CASE WHEN download = 'sem_dado' THEN 'n_a' ELSE 'not_processed' END WHEN zip_ok AND has_tipo THEN 'ok' WHEN zip_ok THEN 'n_a' ELSE 'failed' END AS explore, e.tipo IS NOT NULL AS de, h.tipo IS NOT NULL AS dh, fe.r AS re, fh.r AS rh
  FROM m LEFT JOIN c USING (cd_mun, tipo) LEFT JOIN e USING (cd_mun, tipo) LEFT JOIN h USING (cd_mun, tipo) LEFT JOIN fe USING (cd_mun, tipo) LEFT JOIN fh USING (cd_mun, tipo)),
 y AS (SELECT *, CASE WHEN explore = 'n_a' THEN 'n_a' WHEN explore <> 'ok' THEN 'not_processed' WHEN de THEN 'ok' WHEN re IS NOT NULL THEN 'failed' ELSE 'not_processed' END AS extract FROM x),
 z AS (SELECT *, CASE WHEN extract = 'n_a' THEN 'n_a' WHEN extract <> 'ok' THEN 'not_processed' WHEN dh THEN 'ok' WHEN rh IS NOT NULL THEN 'failed' ELSE 'not_processed' END AS harmonise FROM y)"""


def _status(spark: SparkSession, sf: str) -> DataFrame:
    k = _t(spark, sf, "lineitem").withColumns({"cd_mun": F.col("l_suppkey").cast("string"), "tipo": F.when(F.col("l_linenumber") <= 3, "massa").otherwise("inundacao")})
    manifest = k.select("cd_mun", "tipo", F.when(F.col("l_quantity") > 49.5, "error").when(F.col("l_quantity") < 1.5, "sem_dado").otherwise("ok").alias("status"))
    coverage = k.filter("l_returnflag = 'R' AND l_quantity > 40").select("cd_mun", "tipo", (F.col("l_discount") > 0.095).alias("has_tipo"), F.when(F.col("l_tax") > 0.005, "ok").otherwise("failed").alias("status_zip"))
    done = lambda flag: k.filter((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 45)).select("cd_mun", "tipo")
    failed = lambda lo, hi, reason: k.filter(F.col("l_quantity").between(lo, hi)).select("cd_mun", "tipo", F.col(reason).alias("reason"), F.col("l_shipdate").alias("timestamp"))
    return index.pipeline_status(manifest, coverage, done("A"), failed(2, 4, "l_returnflag"), done("N"), failed(5, 7, "l_linestatus"))


@query("pipeline_status", f"""{_STATUS} SELECT cd_mun, tipo, download, explore, extract, harmonise, harmonise = 'ok' AS in_pipeline, CASE WHEN harmonise = 'failed' THEN 'harmonise' WHEN extract = 'failed' THEN 'extract' WHEN explore = 'failed' THEN 'explore' WHEN download = 'error' THEN 'download' ELSE '' END AS last_failure_stage,
 CASE WHEN harmonise = 'failed' THEN rh WHEN extract = 'failed' THEN re WHEN explore = 'failed' THEN 'unreadable or not covered' WHEN download = 'error' THEN 'download failed' ELSE '' END AS last_failure_reason FROM z""")
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    """Five ledgers reconciled by municipality and process."""
    return _status(spark, sf)


@query("status_summary", f"""{_STATUS}, s AS (SELECT tipo, unnest([0, 1, 2, 3]) AS k, unnest(['download', 'explore', 'extract', 'harmonise']) AS stage, unnest([CASE download WHEN 'error' THEN 'failed' ELSE download END, explore, extract, harmonise]) AS st FROM z),
 n AS (SELECT tipo, k, stage, count_if(st = 'ok') AS ok, count_if(st = 'failed') AS failed, count_if(st = 'n_a') AS n_a FROM s GROUP BY ALL) SELECT tipo, stage, ok, failed, n_a, coalesce(lag(ok) OVER (PARTITION BY tipo ORDER BY k) - ok, 0) AS dropout FROM n""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by stage, and how many are lost between stages."""
    return index.status_summary(_status(spark, sf))


@query("both_or_neither", f"{_STATUS}, b AS (SELECT cd_mun, count(DISTINCT tipo) FILTER (harmonise = 'ok') AS n FROM z GROUP BY 1) SELECT count_if(n = 2) AS both, count_if(n = 0) AS neither FROM b")
def both_or_neither(spark: SparkSession, sf: str) -> DataFrame:
    return tables.both_or_neither(_status(spark, sf), "cd_mun", "tipo", F.col("in_pipeline"))


@query("stage_funnel", "SELECT step, stage, ok, failed, n_a, dropout FROM (SELECT 0 AS step, 'returned' AS stage, count_if(l_returnflag = 'R') AS ok, count_if(l_returnflag = 'A') AS failed, count_if(l_returnflag = 'N') AS n_a, 0::BIGINT AS dropout FROM lineitem UNION ALL SELECT 1, 'taxed', count_if(l_tax > 0.02), count_if(NOT l_tax > 0.02), 0, (SELECT count_if(l_returnflag = 'R') FROM lineitem) - count_if(l_tax > 0.02) FROM lineitem)")
def stage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_returnflag", "l_tax").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("returned"), (F.col("l_tax") > 0.02).alias("taxed"))
    return tables.stage_funnel(line, ["returned", "taxed"])


@query("column_frequency", "SELECT c AS \"column\", count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS c FROM part) WHERE c <> '' GROUP BY 1 ORDER BY n DESC, c LIMIT 12")
def column_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the twelve names that most bar-separated lists have."""
    lists = _t(spark, sf, "part").select(F.translate(F.concat_ws(" ", "p_name", "p_type"), " ", "|").alias("columns"))
    return tables.column_frequency(lists, "columns")


@query("code_lengths", "WITH a AS (SELECT DISTINCT substring(lpad(c_custkey::VARCHAR, 7, '0'), 1, 6) AS code FROM customer), b AS (SELECT substring(lpad(o_custkey::VARCHAR, 7, '0'), 1, 6) AS code FROM orders) SELECT code, count(*) AS n FROM a JOIN b USING (code) GROUP BY 1")
def code_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of seven digits on one side and six on the other: both cut to six."""
    full = _t(spark, sf, "customer").select(S.canon_code(F.col("c_custkey")).alias("code"))
    short = _t(spark, sf, "orders").select(F.substring(S.canon_code(F.col("o_custkey")), 1, 6).alias("code"))
    a, b = tables.harmonise_code_length(full, short, "code")
    return b.join(a.distinct(), "code").groupBy("code").agg(F.count("*").alias("n"))


_CLASS_TEXT = "CASE WHEN p_size <= 10 THEN 'Muito Alta' WHEN p_size <= 20 THEN 'MEDIA' WHEN p_size <= 30 THEN 'muito alta' WHEN p_size <= 40 THEN 'Baixa' END"


@query("class_rules", f"""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 5 WHEN p_size <= 20 THEN 3 WHEN p_size BETWEEN 31 AND 40 THEN 2 ELSE -1 END AS class, CASE WHEN p_size <= 10 THEN 5 WHEN p_size <= 20 THEN 3 WHEN p_size BETWEEN 31 AND 40 THEN 2 WHEN p_size // 8 BETWEEN 0 AND 5 THEN p_size // 8 ELSE -1 END AS raster,
 CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END AS name, p_partkey || '_sp' AS muni, p_type IN ('SMALL', 'LARGE') AS flagged, lower(p_type) = 'economy' AS same, CASE WHEN p_size > 25 THEN p_brand END AS process FROM part""")
def class_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Class columns and texts, raster fallback, names by precedence, file stems, truth texts and places."""
    part = _t(spark, sf, "part").withColumns({"Classe": F.expr(_CLASS_TEXT), "processo": F.when(F.col("p_size") > 25, F.col("p_brand"))})
    text = F.col(S.class_column(part.columns))
    truth = F.when(F.col("p_type") == "SMALL", " Sim").when(F.col("p_type") == "LARGE", "TRUE").otherwise("no")
    return part.select(
        "p_partkey", S.class_ordinal(text).alias("class"), S.raster_class(text, F.floor(F.col("p_size") / 8).cast("int")).alias("raster"), S.with_precedence(F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")), F.col("p_brand")).alias("name"),
        S.municipality_of_stem(F.concat(F.col("p_partkey").cast("string"), F.lit("_sp_massa"))).alias("muni"), S.truth_text(truth).alias("flagged"), S.same_place(F.concat(F.lit(" "), "p_type"), F.lit("economy ")).alias("same"), S.first_existing(part, "PROCESSO", "processo").alias("process"),
    )


@query("unmapped_classes", "SELECT CASE WHEN p_size BETWEEN 21 AND 30 THEN 'muito alta' ELSE '' END AS class, count(*) AS n FROM part WHERE p_size > 20 AND p_size NOT BETWEEN 31 AND 40 GROUP BY 1")
def unmapped_classes(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part").withColumn("classe", F.expr(_CLASS_TEXT))
    return tables.unmapped_classes(part, "classe", S.class_ordinal(F.col("classe")))


@query("class_labels", "WITH b AS (SELECT [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]::DOUBLE[] AS b), c AS (SELECT greatest(1, least(5, len(list_filter(b, lambda x: x <= l_discount)))) AS k, b, l_discount FROM lineitem, b) SELECT CASE WHEN l_discount > 0.05 THEN printf('%.3f', b[k]) || '-' || printf('%.3f', b[k + 1]) ELSE '-' END AS label, count(*) AS n FROM c GROUP BY 1")
def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Class labels from bounds; a dash where there is no value."""
    bounds = F.array(*(F.lit(k / 50) for k in range(6)))
    value = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    label = F.coalesce(S.class_label(bounds, S.class_of(value, bounds)), S.number_text(F.lit(None).cast("double")))
    return _t(spark, sf, "lineitem", "l_discount").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("review_filter", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') AND NOT l_discount > 0.09 GROUP BY 1")
def review_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory rows that can be read and name a known process."""
    kind = F.when(F.col("l_returnflag") == "A", "inundacao").when(F.col("l_returnflag") == "N", "massa").otherwise("outros")
    inventory = _t(spark, sf, "lineitem", "l_returnflag", "l_discount").select(F.col("l_returnflag").alias("flag"), kind.alias("kind"), (F.col("l_discount") > 0.09).alias("error"))
    return indicators.reviewable(inventory).groupBy("flag").agg(F.count("*").alias("n"))


@query("range_check", "SELECT 'disc' AS indicator, count_if(l_discount * 10 < 0 OR l_discount * 10 > 1) AS outside, count_if(l_discount IS NULL) AS missing FROM lineitem UNION ALL SELECT 'qty', count_if(l_quantity / 45 < 0 OR l_quantity / 45 > 1), count_if(l_quantity IS NULL) FROM lineitem")
def range_check(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each scaled indicator are outside [0, 1]."""
    line = _t(spark, sf, "lineitem", "l_discount", "l_quantity").select((F.col("l_discount") * 10).alias("disc"), (F.col("l_quantity") / 45).alias("qty"))
    return tables.range_check(line, ["disc", "qty"])


@query("narrowed", "SELECT l_returnflag AS flag, round(sum(l_extendedprice::FLOAT::DOUBLE), 1) AS total, count(DISTINCT l_extendedprice::FLOAT) AS n FROM lineitem GROUP BY 1")
def narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """Single precision, written and read back."""
    path = scratch(spark, "slim")
    sinks.save_slim(_t(spark, sf, "lineitem", "l_returnflag", "l_extendedprice"), path, ["l_returnflag"], ["l_extendedprice"])
    return readers.read_table(spark, path).groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 1).alias("total"), F.countDistinct("l_extendedprice").alias("n"))


# clusters


def _kmeans_sql(source: str, key: str, columns: tuple[str, ...], score: str, k: int, starts: int, iterations: int) -> str:
    """CTEs from source to clustered (its columns and cluster): the same first centres, all starts, iteration after iteration."""
    n = len(columns)
    square = " + ".join(f"(p.z{i} - c.z{i}) ** 2" for i in range(n))
    zs, means = ", ".join(f"z{i}" for i in range(n)), ", ".join(f"coalesce(m.z{i}, c.z{i}) AS z{i}" for i in range(n))
    standard = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS z{i}" for i, c in enumerate(columns))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in (*columns, score))
    parts = [
        f"zed AS MATERIALIZED (SELECT *, {standard} FROM {source} WHERE {whole})",
        f"start AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) - 1 AS o FROM zed)",
        f"c0 AS MATERIALIZED (SELECT o // {k} AS s, o % {k} AS i, {zs} FROM start WHERE o < {starts * k})",
    ]
    for t in range(iterations + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT p.{key}, s, arg_min(i, ({square}, i)) AS i, min({square}) AS d FROM zed p CROSS JOIN c{t} c GROUP BY ALL)")
        if t < iterations:
            parts.append(f"m{t} AS (SELECT s, i, {', '.join(f'avg(z{j}) AS z{j}' for j in range(n))} FROM a{t} JOIN zed USING ({key}) GROUP BY s, i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.s, c.i, {means} FROM c{t} c LEFT JOIN m{t} m USING (s, i))")
    parts.append(f"best AS (SELECT s FROM a{iterations} GROUP BY s ORDER BY round(sum(d), 6), s LIMIT 1)")
    parts.append(f"ordered AS (SELECT i, row_number() OVER (ORDER BY avg({score}) DESC, i) - 1 AS cluster FROM a{iterations} JOIN best USING (s) JOIN zed USING ({key}) GROUP BY i)")
    parts.append(f"clustered AS MATERIALIZED (SELECT zed.*, cluster::INTEGER AS cluster FROM zed JOIN a{iterations} USING ({key}) JOIN best USING (s) JOIN ordered USING (i))")
    return ", ".join(parts)


DIMENSIONS = {"ip": ("many of the groups first served", "few of them"), "iv": ("vulnerable", "secure"), "ie": ("exposed", "sheltered"), "ig": ("badly governed", "well governed")}
_ROUNDS, _STARTS = 30, 20
_CELL_SQL = """l AS (SELECT l_orderkey AS k, avg(l_discount * 10) AS ip, avg(l_tax * 12) FILTER (l_returnflag <> 'A') AS ie, sum(l_quantity) AS households FROM lineitem GROUP BY 1),
 grid AS (SELECT o_custkey AS muni, ip, least(o_totalprice / 500000, 1) AS iv, ie, 1 - (c_acctbal + 1000) / 11000 AS ig, households FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON k = o_orderkey),
 scored_grid AS (SELECT *, (coalesce(ip, 0) + iv + coalesce(ie, 0) + ig) / (2 + (ip IS NOT NULL)::INT + (ie IS NOT NULL)::INT) AS final_index, greatest(coalesce(households, 1), 0.001) AS w FROM grid),"""
_MUNI_SQL = " munis AS (SELECT muni, " + ", ".join(f"sum({c} * w) / nullif(sum(w) FILTER ({c} IS NOT NULL), 0) AS {c}" for c in ("final_index", *DIMENSIONS)) + " FROM scored_grid GROUP BY 1)"
_CLUSTERED = f"{_CELL_SQL}{_MUNI_SQL}, {_kmeans_sql('munis', 'muni', tuple(DIMENSIONS), 'final_index', 4, _STARTS, _ROUNDS)}"


def _cluster_run(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The municipalities of a run over all cells, and where it wrote."""
    line = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg(F.col("l_discount") * 10).alias("ip"), F.avg(F.when(F.col("l_returnflag") != "A", F.col("l_tax") * 12)).alias("ie"), F.sum("l_quantity").alias("households"))
    c = _t(spark, sf, "customer")
    cells = _t(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(line, "o_orderkey", "left")
    cells = cells.select(F.col("o_custkey").alias("muni"), "ip", F.least(F.col("o_totalprice") / 500_000, F.lit(1.0)).alias("iv"), "ie", (1 - (F.col("c_acctbal") + 1000) / 11_000).alias("ig"), "households")
    cells = cells.withColumn("final_index", S.row_mean(*map(F.col, DIMENSIONS)))
    places = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lookup = c.filter("c_custkey % 10 <> 0").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("muni"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("size_class"))
    path = scratch(spark, "clusters")
    return index.cluster_run(cells, lookup, DIMENSIONS, "final_index", "muni", "households", path, starts=_STARTS, iterations=_ROUNDS), path


@query("cluster_run", f"""WITH {_CLUSTERED}, named AS (SELECT clustered.*, r_name AS region, c_mktsegment AS size_class FROM clustered LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = muni LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
 pool AS (SELECT named.* FROM named JOIN (SELECT cluster, median(final_index) AS cut FROM named GROUP BY 1) USING (cluster) WHERE final_index >= cut),
 f AS (SELECT *, region IS NOT NULL AND row_number() OVER (PARTITION BY cluster, region, size_class ORDER BY final_index DESC, muni) = 1 AS first FROM pool),
 ranks AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY first DESC, CASE WHEN first THEN region END, CASE WHEN first THEN size_class END, final_index DESC, muni) AS candidate_rank FROM f)
 SELECT muni, named.cluster, named.region, named.size_class, round(named.final_index, 6) AS final_index, candidate_rank FROM named LEFT JOIN (SELECT muni, candidate_rank FROM ranks WHERE first OR candidate_rank <= 50) USING (muni)""")
def cluster_run(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to municipalities to clusters to candidates, read back from what the run wrote."""
    out, _ = _cluster_run(spark, sf)
    return _r(out.select("muni", "cluster", "region", "size_class", "final_index", F.col("candidate_rank").cast("long").alias("candidate_rank")))


def _profile_sql() -> str:
    names = ("final_index", *DIMENSIONS)
    own = ", ".join(f"round(avg({d}), 6) AS {d}_mean, round(stddev_samp({d}), 6) AS {d}_sd, round((avg({d}) - any_value({d}_mu)) / greatest(any_value({d}_s), 1e-9), 6) AS {d}_z" for d in names)
    overall = ", ".join(f"avg({d}) AS {d}_mu, stddev_samp({d}) AS {d}_s" for d in names)
    texts = ", ".join(f"CASE WHEN abs({d}_z) >= 0.5 THEN (-abs({d}_z), CASE WHEN {d}_z > 0 THEN '{hi}' ELSE '{lo}' END) END" for d, (hi, lo) in DIMENSIONS.items())
    marked = f"list_sort(list_filter([{texts}], lambda x: x IS NOT NULL))[1:3]"
    return f"""WITH {_CLUSTERED}, o AS (SELECT {overall} FROM clustered), g AS (SELECT cluster, count(*) AS n, {own} FROM clustered, o GROUP BY 1)
 SELECT *, CASE WHEN len({marked}) > 0 THEN array_to_string(list_transform({marked}, lambda x: x[2]), '; ') ELSE 'near the mean in all dimensions' END AS label FROM g"""


@query("cluster_run_profiles", _profile_sql())
def cluster_run_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The profiles that a cluster run wrote: every dimension's mean, spread and z-score, and the label."""
    return _r(readers.read_table(spark, f"{_cluster_run(spark, sf)[1]}/profiles"))
