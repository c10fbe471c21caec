"""Registered queries of whole runs: quality while writing, report tables, versions, stored layout and the SQL functions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions import grid as G
from gridindex.operators import tables
from gridindex.plans import index
from gridindex.plans.catalog import query
from gridindex.plans.queries import _AXIAL_CELLS, _CELLS, _EVENTS, _MERGED, _ROUNDED, _cells, _events, _overlap_sql, _points, _r, _t
from gridindex.plans.queries_index import _RUN_SQL, _run
from gridindex.shared import scratch
from gridindex.sources import readers, sinks

# quality


def _quality_sql() -> str:
    columns = {"p1_disc_norm": ("indicator", "p1"), "p2_tax_norm": ("indicator", "p2"), "e1_ret_norm": ("indicator", "e1"), "g1_qty_norm": ("indicator", "g1"), "ip": ("dimension", "ip"), "ie": ("dimension", "ie"), "ig": ("dimension", "ig"), "final_index": ("index", "final_index")}
    long = " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS kind, ({c})::DOUBLE AS v FROM wide" for name, (kind, c) in columns.items())
    return f"""{_RUN_SQL}, wide AS (SELECT f.*, p1, p2, e1, g1 FROM f LEFT JOIN m ON k = cell_id), long AS ({long}),
 whole AS (SELECT ip, ie, ig FROM wide WHERE ip IS NOT NULL AND ie IS NOT NULL AND ig IS NOT NULL),
 sd AS (SELECT 1 / stddev_samp(ip) AS ip, 1 / stddev_samp(ie) AS ie, 1 / stddev_samp(ig) AS ig FROM whole), w AS (SELECT ip / (ip + ie + ig) AS ip, ie / (ip + ie + ig) AS ie, ig / (ip + ie + ig) AS ig FROM sd),
 r AS (SELECT corr((whole.ip + whole.ie + whole.ig) / 3, whole.ip * w.ip + whole.ie * w.ie + whole.ig * w.ig) AS r FROM whole, w),
 g AS (SELECT name, kind, count(v) AS n, count(*) - count(v) AS missing, count_if(v > 0) AS positive, count_if(v < 0 OR v > 1) AS outside, min(v) AS low, max(v) AS high, avg(v) AS mean, quantile_cont(v, 0.99) AS p99, count_if(v IN (0, 1)) = count(v) AS bin FROM long GROUP BY 1, 2),
 s AS (SELECT *, 100.0 * positive / n AS pct FROM g)
 SELECT name, kind, n, missing, positive, round(pct, 6) AS percent_nonzero, outside, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(CASE name WHEN 'ip' THEN w.ip WHEN 'ie' THEN w.ie WHEN 'ig' THEN w.ig END, 6) AS weight,
 CASE WHEN outside > 0 THEN 'RANGE' WHEN kind <> 'indicator' THEN NULL WHEN bin THEN 'BINARY' WHEN p99 = 0 AND pct < 1 THEN 'SPARSE' WHEN p99 = 0 THEN 'COLLAPSE' WHEN pct < 1 THEN 'RISK' WHEN pct < 5 THEN 'SPARSE' ELSE 'OK' END AS status,
 CASE WHEN kind = 'index' THEN round(r.r, 6) END AS equalised_r FROM s, w, r"""


@query("quality_run", _quality_sql())
def quality_run(spark: SparkSession, sf: str) -> DataFrame:
    """The quality table of an index run, taken while the run was written."""
    return _r(readers.read_table(spark, f"{_run(spark, sf)}/quality_2024"))


# report


_LEVELS = [(), ("region",), ("region", "state"), ("region", "state", "muni")]


def _report_sql() -> str:
    values = "least(price / 500000, 1)::DOUBLE AS score, ((balance + 1000) / 11000)::DOUBLE AS iv, CASE WHEN status = 'F' THEN price / 600000 END::DOUBLE AS ie"
    return f"""WITH {_CELLS}, v AS (SELECT *, {values} FROM cells), q AS (SELECT size_class, quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM v GROUP BY 1 HAVING count(*) >= 10),
 c AS (SELECT v.*, greatest(1, least(5, len(list_filter(coalesce(b, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: x <= score)))) AS class FROM v LEFT JOIN q USING (size_class)),
 t AS (SELECT CASE grouping(region, state, muni, size_class, class) WHEN 31 THEN 'all' WHEN 15 THEN 'region' WHEN 7 THEN 'region+state' WHEN 3 THEN 'region+state+muni' ELSE 'size_class+class' END AS level, region, state, muni, size_class, class::INTEGER AS class, count(score) AS n, avg(score) AS mean, min(score) AS least, max(score) AS greatest, avg(iv) AS iv_mean, avg(ie) AS ie_mean
  FROM c GROUP BY GROUPING SETS ((), (region), (region, state), (region, state, muni), (size_class, class))),
 p AS (SELECT mean, 100.0 * count_if(v.score < mean - 1e-12) / count(*) AS percent_below FROM (SELECT DISTINCT mean FROM t), v GROUP BY 1)
 SELECT level, region, state, muni, size_class, class, n, round(mean, 6) AS mean, round(least, 6) AS least, round(greatest, 6) AS greatest, round(iv_mean, 6) AS iv_mean, round(ie_mean, 6) AS ie_mean, round(percent_below, 6)::DOUBLE AS percent_below FROM t JOIN p USING (mean)"""


@query("report_tables", _report_sql())
def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A report's tables, national to municipal and by class, over cells of which some come twice."""
    c = _cells(spark, sf)
    cells = c.select("cell_id", "region", "state", "muni", "size_class", F.least(F.col("price") / 500_000, F.lit(1.0)).alias("score"), ((F.col("balance") + 1000) / 11_000).alias("iv"), F.when(F.col("status") == "F", F.col("price") / 600_000).alias("ie"))
    out = index.report(cells.unionAll(cells.filter("cell_id % 3 = 0")), _LEVELS, "score", "size_class", ["iv", "ie"])
    return _r(out)


# versions and layout


@query("versioned_run", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS versions FROM orders GROUP BY 1")
def versioned_run(spark: SparkSession, sf: str) -> DataFrame:
    """Three writers save their part of one result at the same time: each gets a version of its own."""
    path, o = f"{scratch(spark, 'versions')}/result.parquet", _t(spark, sf, "orders", "o_orderstatus", "o_totalprice")
    with ThreadPoolExecutor(3) as writers:
        saved = list(writers.map(lambda s: sinks.save_version(o.filter(F.col("o_orderstatus") == s), path), ("F", "O", "P")))
    parts = [readers.read_table(spark, p).withColumn("version", F.lit(readers.version_of(p)[1])) for p in saved]
    by = tables.union_all(parts).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.first("version").alias("version"))
    return by.select(F.col("o_orderstatus").alias("status"), "n", F.round("total", 2).alias("total"), F.size(F.collect_set("version").over(Window.partitionBy())).cast("long").alias("versions"))  # three rows


@query("stored_merge", f"WITH {_MERGED} SELECT cell_id, round(qty, 6) AS qty, round(disc, 6) AS disc, round(tax, 6) AS tax FROM merged")
def stored_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators kept in buckets of the cell, merged without moving a row."""
    tag, line = f"g{abs(hash(scratch(spark, 'stored'))):x}", _t(spark, sf, "lineitem")
    for name, column, flag in (("qty", "l_quantity", "A"), ("disc", "l_discount", "N"), ("tax", "l_tax", "R")):
        sinks.save_bucketed(line.filter(F.col("l_returnflag") != flag).select(F.col("l_orderkey").alias("cell_id"), F.col(column).alias("value")), f"{tag}_{name}", "cell_id", 8)
    sinks.save_bucketed(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id")), f"{tag}_base", "cell_id", 8)
    return _r(tables.merge_stored(spark.table(f"{tag}_base"), {n: spark.table(f"{tag}_{n}") for n in ("qty", "disc", "tax")}))


# SQL functions


_DISK_SQL = " UNION ALL ".join(f"SELECT {k} AS k, i AS dq, j AS dr FROM generate_series(-{k}, {k}) a(i), generate_series(-{k}, {k}) b(j) WHERE abs(i + j) <= {k}" for k in (1, 3))


@query("sql_disk", f"WITH {_EVENTS}, c AS (SELECT DISTINCT q, r FROM cells), o AS ({_DISK_SQL}) SELECT k::INTEGER AS k, (q + dq) || ':' || (r + dr) AS cell_id, count(*) AS n FROM c, o GROUP BY ALL")
def sql_disk(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbourhoods of one and of three steps, in SQL."""
    G.register(spark, 25.0)
    _events(spark, sf).createOrReplaceTempView("sql_disk_events")
    return spark.sql(
        "WITH c AS (SELECT DISTINCT cell_of(x, y) AS cell FROM sql_disk_events), a AS (SELECT cell, explode(array(1, 3)) AS k FROM c), d AS (SELECT k, grid_disk(cell, k) AS near FROM a), "
        "n AS (SELECT k, explode(near) AS cell_id FROM d) SELECT k, cell_id, count(*) AS n FROM n GROUP BY k, cell_id"
    )


@query("sql_row_mean", f"WITH {_MERGED} SELECT cell_id, round((coalesce(qty / 50, 0) + coalesce(disc, 0) + coalesce(tax, 0)) / nullif((qty IS NOT NULL)::INT + (disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT, 0), 6) AS mean FROM merged")
def sql_row_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of what a row has, in SQL."""
    from gridindex.plans.queries import _merged

    G.register(spark, 25.0)
    _merged(spark, sf).createOrReplaceTempView("sql_row_mean_cells")
    return spark.sql("SELECT cell_id, round(row_mean(array(qty / 50, disc, tax)), 6) AS mean FROM sql_row_mean_cells")


@query("sql_overlap", _overlap_sql(200.0, 300.0, 500.0))
def sql_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """overlap_area's rows, the cells found by a table function in SQL, strip by strip."""
    G.register(spark, 200.0)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    _points(spark, sf).select(F.col("vec_id").alias("feature_id"), (F.col("label") % 3).cast("string").alias("state"), (F.col("label") % 6).alias("class"), F.array(F.array(corner(300.0, 0.0), corner(0.0, 500.0), corner(-300.0, 0.0), corner(0.0, -500.0))).alias("rings")).createOrReplaceTempView("sql_overlap_polygons")
    met = spark.sql(
        "WITH p AS (SELECT *, strips(rings, 200D) AS strips FROM sql_overlap_polygons), s AS (SELECT feature_id, state, class, rings, explode(strips) AS strip FROM p), "
        "m AS (SELECT s.feature_id, s.state, s.class, o.cell_id, o.area, o.holds_center FROM s, LATERAL overlap_cells(s.rings, 200D, s.strip.low, s.strip.high) o) "
        "SELECT feature_id, state, class, cell_id, area FROM m WHERE cell_id IN (SELECT cell_id FROM m WHERE holds_center)"
    )
    out = tables.with_fractions(tables.area_by_cell(met), G.cell_area(200.0))
    return out.withColumns({"area": F.round("area", 3), "high_area": F.round("high_area", 3), "high_fraction": F.round("high_fraction", 6), "coverage": F.round("coverage", 6)})
