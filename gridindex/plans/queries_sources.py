"""Registered queries of readers, sinks and streams: what is derived from the given tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.functions import grid as G
from gridindex.functions import scalars as S
from gridindex.operators import spatial, tables
from gridindex.plans import index, indicators
from gridindex.plans.catalog import query
from gridindex.plans.queries import _AXIAL_CELLS, _EVENTS, _POINTS, _ROUNDED, _events, _points, _r, _t
from gridindex.shared import scratch
from gridindex.sources import readers, sinks
from gridindex.sources.registry import Registry
from gridindex.streaming import events

_CODES = sorted(readers.STATE_CODES)
_NATIONS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_REGION_OF = " ".join(f"WHEN sigla IN ({', '.join(map(repr, states))}) THEN '{r}'" for r, states in S.MACRO_REGIONS.items())


def _state_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a numeric state code, one of the fixed ones for each nation."""
    c = _t(spark, sf, "customer", "c_custkey", "c_nationkey")
    code = F.element_at(F.array(*map(F.lit, _CODES)), F.col("c_nationkey") + 1)
    return _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice", code.alias("uf"))


@query("csv_set_regions", f"SELECT o_orderkey AS h3_id, o_totalprice AS v, {_CODES}[c_nationkey + 1] AS cd_uf, {[readers.STATE_CODES[k] for k in _CODES]}[c_nationkey + 1] AS sigla_uf FROM {_NATIONS}")
def csv_set_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A file set by state, in which some files have other spellings, another order of columns and another delimiter."""
    cells, path = _state_cells(spark, sf), scratch(spark, "csv")
    north = F.col("uf") < 30
    cells.filter(north).select("uf", F.col("o_orderkey").alias("H3_ID"), F.col("o_totalprice").alias("V")).write.partitionBy("uf").option("header", True).csv(f"{path}/a")
    cells.filter(~north).select("uf", F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("h3_id")).write.partitionBy("uf").option("header", True).option("sep", ";").csv(f"{path}/b")
    found = readers.with_region_from_filename(readers.read_csv_set(spark, f"{path}/*/uf=*", ["h3_id", "v"]))
    return found.select(F.col("h3_id").cast("long").alias("h3_id"), S.to_num(F.col("v")).alias("v"), "cd_uf", "sigla_uf")


@query("csv_latin", "SELECT p_partkey AS cd_mun, p_name || ' São' AS nome FROM part")
def csv_latin(spark: SparkSession, sf: str) -> DataFrame:
    """A file that is not UTF-8 is read as Latin-1 with semicolons."""
    path = scratch(spark, "csv")
    _t(spark, sf, "part").select(F.col("p_partkey").alias("cd_mun"), F.concat("p_name", F.lit(" São")).alias("nome")).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv_fallback(spark, path, ["cd_mun", "nome"]).select(F.col("cd_mun").cast("long").alias("cd_mun"), "nome")


@query("csv_marked", "SELECT p_partkey, round(p_retailprice, 1) AS price FROM part")
def csv_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded, with a byte-order mark, and read back."""
    path = scratch(spark, "csv")
    sinks.save_csv(_t(spark, sf, "part", "p_partkey", "p_retailprice"), path, 1, bom=True)
    found = readers.read_csv_set(spark, path, ["p_partkey", "p_retailprice"])
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), S.to_num(F.col("p_retailprice")).alias("price"))


@query("ledger_spend", f"SELECT o_custkey AS cd_mun, round(avg(CASE WHEN c_nationkey > 0 THEN o_totalprice / c_nationkey ELSE 0 END), 6) AS value FROM {_NATIONS} WHERE o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '(?i)urgent|high') GROUP BY 1")
def ledger_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers by region, Latin-1 with three lines before the header and decimal commas: spend a head of one account."""
    found = indicators.spend_values(_ledger(spark, sf), {"filter_column": "F", "filter_account": "urgent|high"})
    return found.select(F.col("cd_mun").cast("long").alias("cd_mun"), F.round("value", 6).alias("value"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a file a region, each written with its lines in order and read by the place of its header."""
    path = scratch(spark, "ledger")
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.concat_ws(";", "o_orderstatus", "o_orderpriority", F.regexp_replace(F.col("o_totalprice").cast("string"), "[.]", ","), "c_nationkey", "o_custkey")
    lines = o.select("n_regionkey", F.lit(4).alias("k"), row.alias("line"))
    head = ["Finanças", "Despesas por Função", "Exercício", "Coluna;Conta;Valor;População;Cod IBGE"]
    preamble = _t(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.posexplode(F.array(*map(F.lit, head))).alias("k", "line"))
    ordered = lines.unionByName(preamble).repartition("n_regionkey").sortWithinPartitions("n_regionkey", "k").select("n_regionkey", "line")
    ordered.write.partitionBy("n_regionkey").option("sep", "\x01").option("quote", "").option("emptyValue", "").option("encoding", "ISO-8859-1").csv(path)
    return tables.union_all([S.standard_names(readers.read_csv_preamble(spark, p)) for p, _ in readers.glob(spark, f"{path}/*/part-*")])


_SPEND = f"s AS (SELECT o_custkey AS muni, avg(CASE WHEN c_nationkey > 0 THEN o_totalprice / c_nationkey ELSE 0 END) AS spend FROM {_NATIONS} WHERE o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '(?i)urgent|high') GROUP BY 1)"


@query("ledger_indicator", f"""WITH {_SPEND}, v AS (SELECT o_orderkey AS cell_id, ln(1 + coalesce(spend, 0)) AS x FROM orders LEFT JOIN s ON muni = o_custkey), lim AS (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM v)
 SELECT cell_id, round(x, 6) AS abs_value, round(CASE WHEN a = b THEN 0 ELSE (least(greatest(x, a), b) - a) / (b - a) END, 6)::DOUBLE AS norm_value FROM v, lim""")
def ledger_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """From ledger files to a cell's value: spend a head, on a log scale, winsorised over cells."""
    registry = Registry.from_dict({"dimensions": {"governance": {"abbr": "IG", "indicators": {"g1": {"abbr": "spend", "source": {"filter_column": "F", "filter_account": "urgent|high"}}}}}})
    cells = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").cast("string").alias("cd_mun"))
    return _r(indicators.indicator(spark, registry, "g1", {"cells": cells, "ledger": _ledger(spark, sf)}))


@query("yearly_fires", f"""WITH ok AS (SELECT year(l_shipdate) AS yr, (l_partkey * 37 % 1000)::DOUBLE AS x, (l_suppkey * 91 % 1000)::DOUBLE AS y FROM lineitem WHERE l_tax > 0), okx AS (SELECT yr, {_AXIAL_CELLS} FROM ok), hit AS (SELECT DISTINCT yr, {_ROUNDED} FROM okx WHERE yr <= 1999),
 {_EVENTS}, base AS (SELECT DISTINCT q, r FROM cells WHERE yr >= 2000), offs AS (SELECT a.i AS dq, b.i AS dr FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(i) WHERE abs(a.i + b.i) <= 1),
 ny AS (SELECT q + dq AS q, r + dr AS r, count(DISTINCT yr) AS n FROM hit, offs GROUP BY 1, 2), f AS (SELECT count(DISTINCT year(l_shipdate)) AS found FROM lineitem WHERE year(l_shipdate) <= 1999),
 v AS (SELECT base.q || ':' || base.r AS cell_id, CASE WHEN coalesce(n, 0) / found >= 3 / 10.0 THEN coalesce(n, 0) / found ELSE 0 END::DOUBLE AS x FROM f, base LEFT JOIN ny ON ny.q = base.q AND ny.r = base.r),
 lim AS (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM v) SELECT cell_id, round(x, 6) AS abs_value, round(CASE WHEN a = b THEN 0 ELSE (least(greatest(x, a), b) - a) / (b - a) END, 6)::DOUBLE AS norm_value FROM v, lim""")  # fmt: skip
def yearly_fires(spark: SparkSession, sf: str) -> DataFrame:
    """Fires by year from a file set in which some years are missing and some coordinates invalid: the share of found years, its floor set by ten configured ones."""
    path = scratch(spark, "csv")
    line = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_shipdate", "l_tax")
    lat = F.when(F.col("l_tax") > 0, (F.col("l_suppkey") * 91 % 1000) / 20).otherwise(999.0)
    line.select(F.year("l_shipdate").alias("y"), lat.alias("lat"), ((F.col("l_partkey") * 37 % 1000) / 10).alias("lon")).write.partitionBy("y").option("header", True).csv(path)
    found, years = readers.read_years(spark, path + "/y={year}", 1990, 1999, ["lat", "lon"])
    points = found.filter(S.valid_coordinates(F.col("lat"), F.col("lon"))).select("year", F.round(S.to_num(F.col("lon")) * 10).alias("x"), F.round(S.to_num(F.col("lat")) * 20).alias("y"))
    base = _events(spark, sf).filter("year >= 2000").select(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("cell_id"))
    return _r(index.fire_indicator(points, base, 25.0, len(years), 10, 3, 1))


def _corner_sql(k: int, size: float) -> str:
    import math

    angle = math.pi * (2 * k + 1) / 6
    return f"printf('%.6f', cx + {size * math.cos(angle)!r}) || ' ' || printf('%.6f', cy + {size * math.sin(angle)!r})"


@query("boundary_export", f"""WITH {_EVENTS}, c AS (SELECT DISTINCT q, r, (q + r / 2.0)::DOUBLE * {3**0.5 * 25.0!r} AS cx, r * 37.5::DOUBLE AS cy FROM cells)
 SELECT q || ':' || r AS cell_id, round(cx, 6) AS x, round(cy, 6) AS y, 'POLYGON((' || {" || ', ' || ".join(_corner_sql(k % 6, 25.0) for k in range(7))} || '))' AS wkt FROM c""")
def boundary_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell with its centre and its outline as text, written and read back."""
    cells = _events(spark, sf).select(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("cell_id")).distinct()
    path = scratch(spark, "wkt")
    sinks.save_table(sinks.with_boundary_wkt(cells, "cell_id", 25.0), path)
    x, y = G.center(F.col("cell_id"), 25.0)
    return _r(readers.read_table(spark, path).select("cell_id", x.alias("x"), y.alias("y"), "wkt"))


@query("failure_ledger", "SELECT l_suppkey::VARCHAR AS cd_mun, count(*) AS n, max(least(length(repeat(l_returnflag, (l_quantity * 20)::INT)), 500))::INT AS longest FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def failure_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of two stages appended to one ledger after a reset, reasons cut at 500 characters."""
    path = scratch(spark, "failures")
    line = _t(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate").withColumn("reason", F.expr("repeat(l_returnflag, cast(l_quantity * 20 as int))"))
    rows = line.select(F.col("l_shipdate").cast("string").alias("timestamp"), F.col("l_suppkey").cast("string").alias("cd_mun"), F.lit("massa").alias("tipo"), F.col("l_returnflag").alias("stage"), "reason")
    sinks.reset_failures(rows, path)
    for stage in ("A", "R"):
        sinks.append_failures(rows.filter(F.col("stage") == stage), path)
    return readers.read_table(spark, path).groupBy("cd_mun").agg(F.count("*").alias("n"), F.max(F.length("reason")).alias("longest"))


@query("restartable_partitions", "SELECT l_linestatus AS state, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linestatus <> 'F' OR l_tax > 0.04 GROUP BY 1")
def restartable_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written by state, one of them replaced by a later run, the rest kept; the done states come from the output."""
    path = scratch(spark, "parts")
    line = _t(spark, sf, "lineitem", "l_linestatus", "l_quantity", "l_tax").withColumnRenamed("l_linestatus", "state")
    sinks.save_partitioned(line, path, "state")
    sinks.save_partitioned(line.filter("state = 'F' AND l_tax > 0.04"), path, "state")
    out = spark.read.parquet(path)
    done = readers.states_of(out)
    return out.join(done, "state").groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("remaining_work", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remaining_work(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return sinks.remaining(line, line.filter("l_returnflag = 'R'"), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("candidate_export", "WITH m AS (SELECT o_custkey AS id, avg(o_totalprice) AS score, any_value(c_nationkey) % 4 AS cluster FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT cluster, count(*) AS n, round(max(score), 6) AS best FROM m JOIN (SELECT cluster, median(score) AS cut FROM m GROUP BY 1) USING (cluster) WHERE score >= cut GROUP BY 1")
def candidate_export(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles and candidates written, candidates by cluster, and read back."""
    path = scratch(spark, "candidates")
    o = _t(spark, sf, "orders", "o_custkey", "o_totalprice").join(_t(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("score"), (F.first("c_nationkey") % 4).alias("cluster"))
    pool = tables.at_least_group_quantile(m, "cluster", "score", 0.5)
    sinks.save_candidates(m.groupBy("cluster").agg(F.count("*").alias("n")), pool, path)
    return readers.read_table(spark, f"{path}/candidates").groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("lookup_regions", f"WITH s AS (SELECT {[readers.STATE_CODES[k] for k in _CODES]}[c_nationkey + 1] AS sigla, o_totalprice AS v FROM {_NATIONS}) SELECT CASE {_REGION_OF} ELSE '?' END AS region, count(*) AS n, round(sum(v), 2) AS total FROM s GROUP BY 1")
def lookup_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup whose codes are written as decimals, read by canonical code and joined."""
    path = scratch(spark, "lookup")
    codes = F.element_at(F.array(*(F.lit(readers.STATE_CODES[k]) for k in _CODES)), F.col("c_nationkey") + 1)
    _t(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("CD_MUN"), codes.alias("UF")).write.option("header", True).option("sep", ";").csv(path)
    lookup = readers.read_lookup(spark, path, "cd_mun", ["uf"])
    cells = _t(spark, sf, "orders").select(S.canon_code(F.col("o_custkey")).alias("cd_mun"), "o_totalprice")
    return tables.enrich(cells, lookup, "cd_mun").groupBy(S.macro_region(F.col("uf")).alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("first_of_files", "SELECT l_orderkey, l_returnflag AS file_name, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_quantity) = 1")
def first_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """One row a cell: the first file's, and of its rows the least."""
    line = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("file_name"), "l_linenumber", "l_quantity")
    return readers.first_of_file(line, ["l_orderkey"]).select("l_orderkey", "file_name", "l_quantity")


@query("aligned_indicators", """WITH a AS (SELECT l_orderkey AS cell_id, l_discount AS disc FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1),
 b AS (SELECT l_orderkey AS cell_id, l_tax AS tax FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1) SELECT cell_id, disc, tax FROM a FULL JOIN b USING (cell_id)""")
def aligned_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Indicator columns of different cells side by side, each cell's first row: of equal line numbers the first in the files."""
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "_metadata.file_name", "_metadata.row_index").withColumnRenamed("l_orderkey", "cell_id")
    order = [F.col(c) for c in ("l_linenumber", "file_name", "row_index")]
    one = lambda flag, column, name: tables.dedup_first(line.filter(F.col("l_returnflag") == flag), ["cell_id"], order).select("cell_id", F.col(column).alias(name))
    return tables.outer_accumulate([one("A", "l_discount", "disc"), one("R", "l_tax", "tax")], "cell_id").select("cell_id", "disc", "tax")


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Diamonds with a point in the middle of every edge."""
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(*(at(dx, dy) for dx, dy in ((300.0, 0.0), (150.0, 250.0), (0.0, 500.0), (-150.0, 250.0), (-300.0, 0.0), (-150.0, -250.0), (0.0, -500.0), (150.0, -250.0))))
    return _points(spark, sf).select(F.col("vec_id").alias("feature_id"), (F.col("label") % 3).cast("string").alias("state"), (F.col("label") % 6).alias("class"), F.array(ring).alias("rings"))


@query("simplified_polygons", f"WITH {_POINTS} SELECT vec_id AS feature_id, (label % 3)::VARCHAR AS state, 4 AS n_points, round(x + 300, 6) AS right FROM points WHERE label % 3 = 1")
def simplified_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons of one state from a table by state, without the points that a line replaces."""
    path = scratch(spark, "polygons")
    _outlines(spark, sf).write.partitionBy("state").parquet(path)
    thin = spatial.simplify_rings(readers.read_polygons(spark, path, "1").withColumn("state", F.col("state").cast("string")), 5.0)
    ring = F.element_at("rings", 1)
    return thin.select("feature_id", "state", F.size(ring).alias("n_points"), F.round(F.array_max(F.transform(ring, lambda p: p["x"])), 6).alias("right"))


@query("map_extent", f"WITH {_POINTS}, e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM points) SELECT round(a - (b - a) * 0.05, 4) AS x0, round(b + (b - a) * 0.05, 4) AS x1, round(c - (d - c) * 0.05, 4) AS y0, round(d + (d - c) * 0.05, 4) AS y1 FROM e")
def map_extent(spark: SparkSession, sf: str) -> DataFrame:
    return _r(spatial.extent(_points(spark, sf)), 4)


@query("near_sea", f"""WITH {_POINTS}, d AS (SELECT t.vec_id, t.label, min(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2)) AS m FROM points t, points p WHERE p.label = 1 AND t.label <> 1 GROUP BY 1, 2)
 SELECT vec_id AS target_id, round(CASE WHEN m <= 400 THEN m END, 6) AS distance, coalesce(label / 4.0 BETWEEN 0 AND 1 AND m <= 400 AND m <= 300, false) AS low FROM d""")
def near_sea(spark: SparkSession, sf: str) -> DataFrame:
    """Distance to the nearest flagged pixel within 400 m, and land at 0 to 1 m within 300 m of it."""
    points = _points(spark, sf)
    targets = points.filter("label <> 1").select(F.col("vec_id").alias("target_id"), "x", "y", (F.col("label") / 4.0).alias("elevation"))
    found = spatial.near_flagged(targets, points.select(F.col("vec_id").alias("point_id"), "x", "y", (F.col("label") == 1).alias("flag")), 400.0)
    joined = found.join(targets, "target_id")
    return joined.select("target_id", F.round("distance", 6).alias("distance"), S.coastal_low(F.col("elevation"), F.col("distance"), 300.0).alias("low"))


# streams


def _drained(query_) -> None:
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("stream_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The events taken in by a stream, twice: the second run finds nothing new."""
    path, schema = scratch(spark, "stream"), _t(spark, sf, "events").schema
    for _ in range(2):
        _drained(events.ingest_once(events.read_stream(spark, f"{sf}/events.parquet", schema), f"{path}/out", f"{path}/checkpoint"))
    return _r(spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("stream_counts", "WITH m AS (SELECT max(ts) - INTERVAL 10 minutes AS mark FROM events), w AS (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, start, n FROM w, m WHERE start + INTERVAL 1 hour <= mark")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of a stream: the windows that its watermark has closed."""
    path, schema = scratch(spark, "stream"), _t(spark, sf, "events").schema
    counts = events.tumbling_counts(events.read_stream(spark, f"{sf}/events.parquet", schema, 1_000_000), "event_type")
    _drained(counts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{path}/out").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_exposure", f"""WITH ev AS (SELECT year(ts) AS yr, (user_id * 37 % 1000)::DOUBLE AS x, (user_id * 91 % 1000)::DOUBLE AS y FROM events), fx AS (SELECT yr, {_AXIAL_CELLS} FROM ev), cells AS (SELECT DISTINCT yr, {_ROUNDED} FROM fx),
 offs AS (SELECT a.i AS dq, b.i AS dr FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(i) WHERE abs(a.i + b.i) <= 1) SELECT (q + dq) || ':' || (r + dr) AS cell_id, count(DISTINCT yr) AS n_years FROM cells, offs GROUP BY 1""")
def stream_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Cells near an event, kept up to date by a stream, and in how many years."""
    path, source = scratch(spark, "stream"), _t(spark, sf, "events")
    marks = source.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    late, middle = F.col("event_id") > marks[1], F.col("event_id") > marks[0]
    for part in (source.filter(late), source.filter(~middle), source):  # out of order, and all of it again
        part.write.mode("append").parquet(f"{path}/in")
        points = events.read_stream(spark, f"{path}/in", source.schema, 1_000_000).select("ts", (F.col("user_id") * 37 % 1000).cast("double").alias("x"), (F.col("user_id") * 91 % 1000).cast("double").alias("y"))
        _drained(events.keep_exposed(points, 25.0, 1, f"{path}/years", f"{path}/checkpoint"))
    events.compact_years(spark, f"{path}/years")
    return events.exposed_years(spark, f"{path}/years")
