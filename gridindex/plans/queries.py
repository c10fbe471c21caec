"""The registered queries: each applies one operator or composed plan to the given tables, read at the reference's grain.

Orders stand for cells, parts for tracts, customers for municipalities, nations for states, regions for macro-regions,
ship dates for yearly events, the first two components of embeddings for points. Doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions import grid as G
from gridindex.functions import scalars as S
from gridindex.operators import spatial, stats, tables
from gridindex.plans import index, indicators
from gridindex.plans.catalog import query
from gridindex.shared import written
from gridindex.sources.registry import Registry


def _t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def _r(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("tract_id")).distinct()


def _households(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_quantity").alias("households"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return index.dasymetric_base(_pairs(spark, sf), _households(spark, sf))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """cell, municipality, state, macro-region, size class, price."""
    o = _t(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = _t(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("muni"), F.col("n_name").alias("state"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("size_class"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


_CELLS = """cells AS (SELECT o_orderkey AS cell_id, o_custkey AS muni, n_name AS state, r_name AS region, c_mktsegment AS size_class, o_totalprice AS price,
 c_acctbal AS balance, o_orderpriority AS priority, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_BASE = """pairs AS (SELECT DISTINCT l_orderkey AS cell_id, l_partkey AS tract_id FROM lineitem),
 hh AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS households FROM lineitem GROUP BY 1),
 base AS (SELECT cell_id, tract_id, households, coalesce(households / nullif(sum(households) OVER (PARTITION BY tract_id), 0), 0) AS weight FROM pairs JOIN hh USING (cell_id) WHERE households > 0)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, region, score, reference: labels as the reference map, text length as the score and (up to 1,000 characters) as the coverage."""
    d = _t(spark, sf, "documents", "doc_id", "n_chars", "lang").join(_t(spark, sf, "labels", "doc_id", "quality", "toxic"), "doc_id")
    return d.select("doc_id", F.col("lang").alias("region"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), (F.col("quality") == 1).alias("reference"), (F.col("toxic") == 1).alias("used"), F.least(F.col("n_chars") / 1000.0, F.lit(1.0)).alias("coverage"))


_SCORED = "scored AS (SELECT doc_id, lang AS region, least(n_chars / 5000.0, 1.0)::DOUBLE AS score, quality = 1 AS reference, toxic = 1 AS used, least(n_chars / 1000.0, 1.0)::DOUBLE AS coverage FROM documents JOIN labels USING (doc_id))"
_F1 = "coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS \"precision\", coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::DOUBLE AS f1"


def _rounded(sql: str, *columns: str, keep: str) -> str:
    return f"SELECT {keep}, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns) + f" FROM ({sql})"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") * 10_000).alias("x"), (F.col("embedding")[1].cast("double") * 10_000).alias("y"), "label")


_POINTS = "points AS (SELECT vec_id, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y, label FROM embeddings)"


def _axial_sql(x: str, y: str, size: float) -> str:
    q, r = f"(({x}) * {3**0.5 / 3!r} - ({y}) / 3) / {size!r}", f"({y}) * {2 / 3!r} / {size!r}"
    return f"({q}) AS fq, ({r}) AS fr"


_AXIAL_CELLS = _axial_sql("x", "y", 25.0)
_ROUNDED = """CASE WHEN abs(floor(fq+.5)-fq) > abs(floor(fr+.5)-fr) AND abs(floor(fq+.5)-fq) > abs(floor(-fq-fr+.5)-(-fq-fr)) THEN -floor(fr+.5)-floor(-fq-fr+.5) ELSE floor(fq+.5) END::BIGINT AS q,
 CASE WHEN NOT (abs(floor(fq+.5)-fq) > abs(floor(fr+.5)-fr) AND abs(floor(fq+.5)-fq) > abs(floor(-fq-fr+.5)-(-fq-fr))) AND abs(floor(fr+.5)-fr) > abs(floor(-fq-fr+.5)-(-fq-fr)) THEN -floor(fq+.5)-floor(-fq-fr+.5) ELSE floor(fr+.5) END::BIGINT AS r"""


# base, census and scaling


@query("dasymetric_weight", f"WITH {_BASE} SELECT cell_id, tract_id, households, round(weight, 6) AS weight FROM base")
def dasymetric_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_base(spark, sf).select("cell_id", "tract_id", "households", "weight"))


def _sums(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").withColumnRenamed("p_partkey", "tract_id")
    weight = S.income_weight(F.col("p_retailprice"), 950.0)
    return index.census_sums(_base(spark, sf), part, {"people": F.col("p_size"), "poor": F.col("p_size") * weight, "income": F.col("p_size") * F.col("p_retailprice"), "rooms": F.col("p_size") % 7 + 1})


_SUMS = f"""{_BASE}, sums AS (SELECT cell_id, sum(p_size * weight) AS people, sum(p_size * CASE WHEN p_retailprice > 0 THEN least(1, 950 / p_retailprice) ELSE 1 END * weight) AS poor,
 sum(p_size * p_retailprice * weight) AS income, sum((p_size % 7 + 1) * weight) AS rooms FROM base JOIN part ON tract_id = p_partkey GROUP BY cell_id)"""


@query("census_weighted_sum", f"WITH {_SUMS} SELECT cell_id, round(people, 6) AS people, round(poor, 6) AS poor, round(income, 4) AS income, round(rooms, 6) AS rooms FROM sums")
def census_weighted_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_sums(spark, sf).withColumn("income", F.round("income", 4)))


def _scaled_sql(value: str, lo: float, hi: float, source: str = "v") -> str:
    return f"""lim AS (SELECT quantile_cont({value}, {lo}) AS a, quantile_cont({value}, {hi}) AS b FROM {source}),
 scaled AS (SELECT {source}.*, CASE WHEN a IS NULL THEN NULL WHEN a = b THEN 0.0 WHEN {value} IS NULL THEN NULL ELSE (least(greatest({value}, a), b) - a) / (b - a) END AS norm FROM {source}, lim)"""


@query("ratio_indicator", f"WITH {_SUMS}, v AS (SELECT cell_id, coalesce(poor / nullif(people, 0), 0) AS x FROM sums), {_scaled_sql('x', 0.01, 0.99)} SELECT cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM scaled")
def ratio_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """A low-income share: weighted counts over people, winsorised and scaled."""
    return _r(index.ratio_indicator(_sums(spark, sf), ["poor"], ["people"]))


@query("ratio_or_cap", f"WITH {_SUMS}, v AS (SELECT cell_id, coalesce(least(rooms, people) / nullif(people, 0), 0) AS x FROM sums), {_scaled_sql('x', 0.01, 0.99)} SELECT cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM scaled")
def ratio_or_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping counts capped by their base."""
    return _r(index.ratio_indicator(_sums(spark, sf), ["rooms"], ["people"], overlapping=True))


@query("income_inverted", f"WITH {_SUMS}, v AS (SELECT cell_id, least(coalesce(income / nullif(people, 0), 0), 1400) AS x FROM sums), {_scaled_sql('x', 0.01, 0.99)} SELECT cell_id, round(x, 6) AS abs_value, round(1 - norm, 6) AS norm_value FROM scaled")
def income_inverted(spark: SparkSession, sf: str) -> DataFrame:
    """Mean income, capped, inverted after scaling."""
    return _r(index.ratio_indicator(_sums(spark, sf), ["income"], ["people"], cap=1400.0, inverted=True))


def _minmax(spark: SparkSession, sf: str, winsorize: tuple[float, float] | None, mode: str = "sorted") -> DataFrame:
    o = _t(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return _r(stats.normalize_minmax(o, ["o_totalprice"], winsorize, mode=mode).select("o_orderkey", F.col("o_totalprice_norm").alias("norm")))


def _minmax_sql(lo: float, hi: float) -> str:
    return f"WITH v AS (SELECT o_orderkey, o_totalprice AS x FROM orders), {_scaled_sql('x', lo, hi)} SELECT o_orderkey, round(norm, 6) AS norm FROM scaled"


@query("minmax_plain", _minmax_sql(0, 1))
def minmax_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _minmax(spark, sf, None)


@query("minmax_winsor_p1", _minmax_sql(0.01, 0.99))
def minmax_winsor_p1(spark: SparkSession, sf: str) -> DataFrame:
    return _minmax(spark, sf, (0.01, 0.99))


@query("minmax_winsor_p3", _minmax_sql(0.03, 0.97))
def minmax_winsor_p3(spark: SparkSession, sf: str) -> DataFrame:
    return _minmax(spark, sf, (0.03, 0.97))


@query("minmax_winsor_sorted", _minmax_sql(0.01, 0.99))
def minmax_winsor_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The same limits from a range-partitioned sort."""
    return _minmax(spark, sf, (0.01, 0.99), "sorted")


@query("log_minmax", f"WITH v AS (SELECT o_orderkey, ln(1 + o_totalprice) AS x FROM orders), {_scaled_sql('x', 0.01, 0.99)} SELECT o_orderkey, round(norm, 6) AS norm FROM scaled")
def log_minmax(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.log1p("o_totalprice").alias("x"))
    return _r(stats.normalize_minmax(o, ["x"], (0.01, 0.99)).select("o_orderkey", F.col("x_norm").alias("norm")))


CENSUS = Registry.from_dict({"dimensions": {"all": {"abbr": "IP", "indicators": {
    "p4": {"abbr": "ido", "source": {"num_cols": ["size_ren"], "den_cols": ["size"]}},
    "v1": {"abbr": "ren", "source": {"num_cols": ["v06004_size"], "den_cols": ["size"], "cap_abs": 1400, "invert_norm": True}},
    "v2": {"abbr": "mor", "source": {"num_cols": ["rooms"], "den_cols": ["size"], "or_logic": True}},
}}}})


def _one_sql(key: str, value: str, inverted: bool = False) -> str:
    norm = "1 - norm" if inverted else "norm"
    return f"SELECT '{key}' AS indicator, cell_id, round(x, 6) AS abs_value, round({norm}, 6) AS norm_value FROM (WITH v AS (SELECT cell_id, {value} AS x FROM sums), {_scaled_sql('x', 0.01, 0.99)} SELECT * FROM scaled)"


@query("census_indicators", f"WITH {_SUMS} " + " UNION ALL ".join((_one_sql("p4", "coalesce(poor / nullif(people, 0), 0)"), _one_sql("v1", "least(coalesce(income / nullif(people, 0), 0), 1400)", True), _one_sql("v2", "coalesce(least(rooms, people) / nullif(people, 0), 0)"))))
def census_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """All census indicators of a registry in one join, two aggregates and projections, long."""
    part = _t(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("tract_id"), F.col("p_size").alias("size"), (F.col("p_size") % 7 + 1).alias("rooms"), F.col("p_retailprice").alias("v06004"))
    return _r(indicators.census_indicators(_base(spark, sf), part, CENSUS, 950.0))


@query("score_extremes", "(SELECT o_orderkey, o_totalprice, 'top' AS \"end\" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' AS \"end\" FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def score_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """A top-and-bottom report of five each."""
    return indicators.extremes(_t(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


# merging and scores

_FILES = {"qty": "l_quantity", "disc": "l_discount", "tax": "l_tax"}


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", *_FILES.values(), "l_returnflag")
    parts = {k: line.filter(F.col("l_returnflag") != f).select(F.col("l_orderkey").alias("cell_id"), F.col(c).alias("value")) for (k, c), f in zip(_FILES.items(), "ANR", strict=True)}
    return tables.merge_indicators(_t(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("cell_id")), parts)


_MERGED = """merged AS (SELECT o_orderkey AS cell_id, qty, disc, tax FROM orders
 LEFT JOIN (SELECT l_orderkey AS k, avg(l_quantity) AS qty FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) a ON o_orderkey = a.k
 LEFT JOIN (SELECT l_orderkey AS k, avg(l_discount) AS disc FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) b ON o_orderkey = b.k
 LEFT JOIN (SELECT l_orderkey AS k, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) c ON o_orderkey = c.k)"""


@query("indicator_merge", f"WITH {_MERGED} SELECT cell_id, round(qty, 6) AS qty, round(disc, 6) AS disc, round(tax, 6) AS tax FROM merged")
def indicator_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_merged(spark, sf))


REGISTRY = Registry.from_dict({"dimensions": {
    "priority": {"abbr": "IP", "indicators": {"p1": {"abbr": "poor", "source": {}}, "p2": {"abbr": "room", "source": {}}}},
    "exposure": {"abbr": "IE", "indicators": {"e1": {"abbr": "qty", "source": {}}, "e2": {"abbr": "disc", "source": {}}}},
    "governance": {"abbr": "IG", "invert": True, "indicators": {"g1": {"abbr": "tax", "source": {}}, "g2": {"abbr": "none", "source": {}}}},
}})


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """Households weigh tracts, tract counts become ratios, all indicators are scaled and averaged twice."""
    sums = _sums(spark, sf).select("cell_id", S.safe_ratio(F.col("poor"), F.col("people")).alias("poor"), S.safe_ratio(F.col("rooms"), F.col("people")).alias("room"))
    wide = written(spark, tables.onto_grid(_merged(spark, sf), sums))  # read for the limits and again for the scores
    scaled = stats.normalize_minmax(wide, ["poor", "room", "qty", "disc", "tax"], index.WINSOR)
    named = scaled.select("cell_id", *(F.col(f"{i.abbr}_norm").alias(i.normalised) for i in REGISTRY.indicators if f"{i.abbr}_norm" in scaled.columns))
    return index.dimension_scores(named, REGISTRY)


def _norm_sql(c: str) -> str:
    return f"CASE WHEN {c}_a = {c}_b THEN 0 WHEN {c} IS NULL THEN NULL ELSE (least(greatest({c}, {c}_a), {c}_b) - {c}_a) / ({c}_b - {c}_a) END AS {c}_n"


_INDEX = f"""{_SUMS}, {_MERGED}, wide AS (SELECT merged.*, coalesce(poor / nullif(people, 0), CASE WHEN people IS NULL THEN NULL ELSE 0 END) AS poor, coalesce(rooms / nullif(people, 0), CASE WHEN people IS NULL THEN NULL ELSE 0 END) AS room FROM merged LEFT JOIN sums USING (cell_id)),
 lim AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b' for c in ('poor', 'room', 'qty', 'disc', 'tax'))} FROM wide),
 nrm AS (SELECT cell_id, {', '.join(_norm_sql(c) for c in ('poor', 'room', 'qty', 'disc', 'tax'))} FROM wide, lim),
 dims AS (SELECT cell_id, (coalesce(poor_n, 0) + coalesce(room_n, 0)) / nullif((poor_n IS NOT NULL)::INT + (room_n IS NOT NULL)::INT, 0) AS ip,
 (coalesce(qty_n, 0) + coalesce(disc_n, 0)) / nullif((qty_n IS NOT NULL)::INT + (disc_n IS NOT NULL)::INT, 0) AS ie, 1 - tax_n AS ig FROM nrm)"""


@query("dimension_scores", f"WITH {_INDEX} SELECT cell_id, round(ip, 6) AS ip, round(ie, 6) AS ie, round(ig, 6) AS ig FROM dims")
def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_index(spark, sf).select("cell_id", "ip", "ie", "ig"))


@query("final_index", f"WITH {_INDEX} SELECT cell_id, round((coalesce(ip, 0) + coalesce(ie, 0) + coalesce(ig, 0)) / nullif((ip IS NOT NULL)::INT + (ie IS NOT NULL)::INT + (ig IS NOT NULL)::INT, 0), 6) AS final_index FROM dims")
def final_index(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_index(spark, sf).select("cell_id", "final_index"))


# dedup, joins and sets


@query("dedup_first", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    return tables.dedup_first(line, ["l_orderkey"], list(map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))).select("l_orderkey", "l_partkey", "l_quantity")


@query("dedup_last", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dedup_last(_t(spark, sf, "events", "user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts"], ["event_id", "value"])


@query("max_per_muni", "SELECT o_custkey AS muni, max(o_totalprice) AS value FROM orders GROUP BY 1")
def max_per_muni(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("muni")).agg(F.max("o_totalprice").alias("value"))


@query("outer_accumulate", """WITH a AS (SELECT p_partkey AS k, any_value(p_size) AS size, any_value(p_retailprice) AS price FROM part WHERE p_size <= 30 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, size, price, qty FROM a FULL JOIN b ON a.k = b.k""")
def outer_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """Two thematic files over different tracts; a column both have comes from the first."""
    a = _t(spark, sf, "part").filter("p_size <= 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    b = _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_returnflag", "l_discount").filter("l_returnflag = 'R' AND l_discount > 0.05").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("qty"), F.lit(0.0).alias("price"))
    return tables.outer_accumulate([a, b], "k")


@query("semi_exposed", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exposed(spark: SparkSession, sf: str) -> DataFrame:
    hit = _t(spark, sf, "lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.only_in(_t(spark, sf, "orders", "o_orderkey", "o_totalprice"), hit, "o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("anti_resume", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_resume(spark: SparkSession, sf: str) -> DataFrame:
    return tables.not_in(_t(spark, sf, "customer", "c_custkey", "c_mktsegment"), _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("prefer_layers", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'a::' || l_linestatus ELSE 'a' END AS path FROM lineitem)
 SELECT l_orderkey, l_linenumber, path FROM v QUALIFY NOT bool_or(contains(path, '::')) OVER (PARTITION BY l_orderkey) OR contains(path, '::')""")
def prefer_layers(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    paths = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.concat(F.lit("a::"), "l_linestatus")).otherwise(F.lit("a")).alias("path"))
    return tables.prefer_layers(paths, ["l_orderkey"], "path")


# survey, ledger and municipal


@query("survey_binary_or", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS a, CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_tax > 0.04 THEN 0 END AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END AS value FROM v""")
def survey_binary_or(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("l_returnflag") == "A", "Sim").when(F.col("l_returnflag") == "N", "Não")
    other = F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_tax") > 0.04, 0)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.row_or(S.yes_no(answer), other).alias("value"))


@query("survey_count", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS a, CASE WHEN l_tax > 0.04 THEN 1 END AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS value FROM v""")
def survey_count(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.row_count(a, F.when(F.col("l_tax") > 0.04, 1)).alias("value"))


@query("spend_per_capita", """SELECT s_nationkey AS muni, round(avg(CASE WHEN p_size > 0 THEN l_extendedprice / p_size ELSE 0 END), 6) AS per_capita FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
 WHERE l_linestatus = 'F' AND regexp_matches(p_type, '(?i)steel|brass') GROUP BY 1""")
def spend_per_capita(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows of one kind whose account matches a pattern, by population, a municipality."""
    line = _t(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_extendedprice", "l_linestatus")
    rows = line.join(_t(spark, sf, "part", "p_partkey", "p_size", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, sf, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    matched = rows.filter(S.ledger_match(F.col("l_linestatus"), "F", F.col("p_type"), "steel|brass"))
    return _r(tables.per_capita(matched, "s_nationkey", "l_extendedprice", "p_size").withColumnRenamed("s_nationkey", "muni"))


@query("weighted_muni_mean", f"""WITH {_CELLS}, hh AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS households FROM lineitem GROUP BY 1), j AS (SELECT cells.*, households, greatest(coalesce(households, 1), 0.001) AS w FROM cells LEFT JOIN hh USING (cell_id))
 SELECT muni, round(sum(price * w) / sum(w), 6) AS price, count(*) AS n_cells, coalesce(sum(households), 0) AS households FROM j GROUP BY muni""")
def weighted_muni_mean(spark: SparkSession, sf: str) -> DataFrame:
    joined = _cells(spark, sf).join(_households(spark, sf), "cell_id", "left")
    return _r(tables.weighted_mean(joined, ["muni"], "households", ["price"]))


@query("mean_of_means", f"WITH {_CELLS}, m AS (SELECT muni, avg((status = 'F')::INT) AS m FROM cells GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(avg((m = 1)::INT) * 100, 6) AS percent_full, count(*) AS groups FROM m")
def mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.mean_of_means(_cells(spark, sf).withColumn("v", (F.col("status") == "F").cast("int")), "muni", "v"))


@query("municipal_indicator", f"""WITH {_CELLS}, m AS (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier GROUP BY 1), s AS (SELECT cell_id, v, ln(1 + greatest(coalesce(v, 0), 0)) AS x FROM cells JOIN nation ON n_name = state LEFT JOIN m ON s_nationkey = n_nationkey), {_scaled_sql('x', 0.01, 0.99, 's')}
 SELECT cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM scaled""")
def municipal_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """A state's mean ledger balance for each of its cells, logged and scaled over cells."""
    m = _t(spark, sf, "supplier", "s_nationkey", "s_acctbal").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v")).withColumn("v", F.greatest("v", F.lit(0.0)))
    named = m.join(_t(spark, sf, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("state"), "v")
    return _r(index.municipal_indicator(_cells(spark, sf), named, "state", "v", "cells", log=True))


# exposure


@query("override_flag", """WITH z AS (SELECT l_orderkey AS cell_id, max(l_discount) AS score FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey AS cell_id, avg((l_returnflag = 'R')::INT) AS high, avg((l_linestatus = 'F')::INT) AS cov FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
 SELECT cell_id, CASE WHEN coalesce(high > 0.3 AND cov >= 0.5, false) THEN 1.0 ELSE score END::DOUBLE AS score, coalesce(high > 0.3 AND cov >= 0.5, false) AS flag FROM z LEFT JOIN f USING (cell_id)""")
def override_flag(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_discount", "l_returnflag", "l_linestatus").withColumnRenamed("l_orderkey", "cell_id")
    z = line.groupBy("cell_id").agg(F.max("l_discount").alias("score"))
    f = line.filter("l_returnflag <> 'A'").groupBy("cell_id").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("high"), F.avg((F.col("l_linestatus") == "F").cast("int")).alias("cov"))
    score, flag = S.override(F.col("score"), F.col("high"), F.col("cov"))
    return z.join(f, "cell_id", "left").select("cell_id", score.alias("score"), flag.alias("flag"))


@query("exposure_indicator", f"""WITH z AS (SELECT l_orderkey AS cell_id, max(l_extendedprice) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), {_scaled_sql('x', 0, 1, 'z')}
 SELECT o_orderkey AS cell_id, round(x, 6) AS abs_value, round(norm, 6) AS norm_value FROM orders LEFT JOIN scaled ON cell_id = o_orderkey""")
def exposure_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """Zonal rows with border duplicates, scaled before they go onto the grid; uncovered cells stay missing."""
    zonal = _t(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("cell_id"), F.col("l_extendedprice").alias("v"))
    return _r(index.exposure_indicator(zonal, "v", _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"))))


@query("terrain_classes", """SELECT CASE WHEN h <= 0 THEN NULL WHEN h < 2 THEN 1.0 WHEN h < 4 THEN 0.66 WHEN h < 6 THEN 0.33 ELSE 0.0 END::DOUBLE * hz AS score, count(*) AS n FROM (SELECT l_quantity / 5 - 1 AS h, (l_linestatus = 'F')::INT AS hz FROM lineitem) GROUP BY 1""")
def terrain_classes(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_quantity", "l_linestatus")
    return line.groupBy(S.terrain_score(F.col("l_quantity") / 5 - 1, F.col("l_linestatus") == "F").alias("score")).agg(F.count("*").alias("n"))


@query("clear_pixels", "SELECT l_linenumber, count(*) AS n, round(avg(l_partkey * 0.00341802 + 149.0 - 273.15), 6) AS celsius FROM lineitem WHERE (l_suppkey >> 3) & 1 = 0 AND (l_suppkey >> 4) & 1 = 0 GROUP BY 1")
def clear_pixels(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_linenumber", "l_partkey", "l_suppkey").filter(S.clear_pixel(F.col("l_suppkey")))
    return _r(line.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg(S.surface_celsius(F.col("l_partkey"))).alias("celsius")))


# grid


def _events(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_shipdate")
    return line.select(F.year("l_shipdate").alias("year"), (F.col("l_partkey") * 37 % 1000).cast("double").alias("x"), (F.col("l_suppkey") * 91 % 1000).cast("double").alias("y"))


_EVENTS = f"""ev AS (SELECT year(l_shipdate) AS yr, (l_partkey * 37 % 1000)::DOUBLE AS x, (l_suppkey * 91 % 1000)::DOUBLE AS y FROM lineitem), fx AS (SELECT yr, {_axial_sql('x', 'y', 25.0)} FROM ev), cells AS (SELECT yr, {_ROUNDED} FROM fx)"""


@query("cell_assign", f"WITH {_EVENTS} SELECT q || ':' || r AS cell_id, count(*) AS n FROM cells GROUP BY 1")
def cell_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("cell_id")).agg(F.count("*").alias("n"))


_DISK = "offs AS (SELECT a.i AS dq, b.i AS dr FROM generate_series(-{k}, {k}) a(i), generate_series(-{k}, {k}) b(i) WHERE abs(a.i + b.i) <= {k})"


@query("grid_disk_exposure", f"WITH {_EVENTS}, {_DISK.format(k=2)} SELECT (q + dq) || ':' || (r + dr) AS cell_id, count(*) AS n_hit FROM (SELECT DISTINCT q, r FROM cells WHERE yr = 1997), offs GROUP BY 1")
def grid_disk_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Cells within two steps of a hit in one year, and how many hit cells are that near."""
    hit = _events(spark, sf).filter("year = 1997").select(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("hit"))
    return G.exploded_disk(hit, "hit", 2, "cell_id").groupBy("cell_id").agg(F.count("*").alias("n_hit"))


@query("recurrent_years", f"""WITH {_EVENTS}, {_DISK.format(k=1)}, base AS (SELECT DISTINCT q, r FROM cells WHERE yr >= 2000), hit AS (SELECT DISTINCT yr, q, r FROM cells WHERE yr < 2000),
 ny AS (SELECT q + dq AS q, r + dr AS r, count(DISTINCT yr) AS n FROM hit, offs GROUP BY 1, 2)
 SELECT base.q || ':' || base.r AS cell_id, CASE WHEN coalesce(n, 0) / 5.0 >= 3 / 7.0 THEN round(coalesce(n, 0) / 5.0, 6) ELSE 0 END::DOUBLE AS fraction FROM base LEFT JOIN ny ON ny.q = base.q AND ny.r = base.r""")
def recurrent_years(spark: SparkSession, sf: str) -> DataFrame:
    """Share of five found years with an event near; the floor is three of seven configured years."""
    ev = _events(spark, sf)
    base = ev.filter("year >= 2000").select(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("cell_id"))
    years = spatial.recurrent_exposure(ev.filter("year < 2000"), base, 25.0, 1)
    share = F.coalesce("n_years", F.lit(0)) / F.lit(5)
    return _r(base.distinct().join(years, "cell_id", "left").select("cell_id", S.recurrence_floor(share, 3, 7).alias("fraction")))


@query("knn_gravity", f"""WITH {_POINTS}, d AS (SELECT t.vec_id, p.vec_id AS pid, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) AS dist, p.vec_id % 6 + 1 AS capacity FROM points t, points p WHERE p.label = 0),
 k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, pid) <= 3) SELECT vec_id AS target_id, round(sum(capacity / (dist + 100)), 6) AS score FROM k GROUP BY 1""")
def knn_gravity(spark: SparkSession, sf: str) -> DataFrame:
    """Capacity over distance of the three nearest facilities."""
    points = _points(spark, sf)
    facilities = points.filter("label = 0").select(F.col("vec_id").alias("point_id"), "x", "y", (F.col("vec_id") % 6 + 1).alias("capacity"))
    return _r(spatial.gravity(points.select(F.col("vec_id").alias("target_id"), "x", "y"), facilities))


@query("zonal_mean", f"""WITH {_EVENTS}, px AS (SELECT (l_partkey * 37 % 1000)::DOUBLE AS x, (l_suppkey * 91 % 1000)::DOUBLE AS y, l_quantity AS v FROM lineitem), cs AS (SELECT DISTINCT q, r, (q + r / 2.0) * {3**0.5 * 25!r} AS cx, r * 37.5 AS cy FROM cells)
 SELECT q || ':' || r AS cell_id, round(avg(v), 6) AS mean, round(avg((v > 25)::INT), 6) AS share, count(*) AS n_pixels FROM cs JOIN px ON (x - cx) ** 2 + (y - cy) ** 2 <= 900 GROUP BY 1""")
def zonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and share over the pixels within 30 m of each cell's centre."""
    line = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_quantity")
    px = line.select((F.col("l_partkey") * 37 % 1000).cast("double").alias("x"), (F.col("l_suppkey") * 91 % 1000).cast("double").alias("y"), F.col("l_quantity").alias("v"))
    cells = px.select(G.cell_of(F.col("x"), F.col("y"), 25.0).alias("cell_id")).distinct()
    return _r(spatial.zonal_mean(px, cells, 25.0, 30.0, {"mean": F.col("v"), "share": (F.col("v") > 25).cast("int")}))


@query("two_period_anomaly", "SELECT l_partkey, round(avg(l_quantity) FILTER (year(l_shipdate) BETWEEN 1999 AND 2001) - avg(l_quantity) FILTER (year(l_shipdate) BETWEEN 1995 AND 1997), 6) AS anomaly FROM lineitem GROUP BY 1")
def two_period_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_shipdate")
    return _r(spatial.two_period_anomaly(line, "l_partkey", F.year("l_shipdate"), F.col("l_quantity"), (1995, 1997), (1999, 2001)))


def _overlap_sql(size: float, rx: float, ry: float) -> str:
    """Diamonds clipped by each cell's six half-planes in turn; areas by cell and state, fractions, and the state with most area."""
    w, h = 3**0.5 * size, 1.5 * size
    corner = lambda k: f"[cx + {size!r} * cos(pi() * {2 * k + 1} / 6), cy + {size!r} * sin(pi() * {2 * k + 1} / 6)]"
    area = "abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] * p[i % len(p) + 1][2] - p[i % len(p) + 1][1] * p[i][2]))) / 2"
    side = "((b[1] - a[1]) * (q[2] - a[2]) - (b[2] - a[2]) * (q[1] - a[1]))"
    return f"""WITH RECURSIVE {_POINTS}, poly AS (SELECT vec_id, label % 3 AS state, label % 6 AS class, x, y FROM points),
 near AS (SELECT poly.*, q, r, (q + r / 2.0) * {w!r} AS cx, r * {h!r} AS cy FROM (SELECT *, unnest(generate_series(floor((y - {ry + size}) / {h!r})::BIGINT, ceil((y + {ry + size}) / {h!r})::BIGINT)) AS r FROM poly) poly,
  LATERAL (SELECT unnest(generate_series(floor((x - {rx + w!r}) / {w!r} - r / 2.0)::BIGINT, ceil((x + {rx + w!r}) / {w!r} - r / 2.0)::BIGINT)) AS q)),
 cut(vec_id, q, r, k, p, corners) AS (SELECT vec_id, q, r, 0, [[x + {rx}, y], [x, y + {ry}], [x - {rx}, y], [x, y - {ry}]], [{', '.join(map(corner, range(6)))}] FROM near
  UNION ALL SELECT vec_id, q, r, k + 1, list_transform(list_filter(flatten(list_transform(range(1, len(p) + 1), lambda i: [[s[i], p[i][1], p[i][2]],
   CASE WHEN (s[i] >= 0) <> (s[i % len(p) + 1] >= 0) THEN [0.0, p[i][1] + s[i] / (s[i] - s[i % len(p) + 1]) * (p[i % len(p) + 1][1] - p[i][1]), p[i][2] + s[i] / (s[i] - s[i % len(p) + 1]) * (p[i % len(p) + 1][2] - p[i][2])] ELSE [-1.0, 0.0, 0.0] END])), lambda t: t[1] >= 0), lambda t: [t[2], t[3]]), corners
   FROM (SELECT *, list_transform(p, lambda q: {side}) AS s FROM (SELECT *, corners[k + 1] AS a, corners[(k + 1) % 6 + 1] AS b FROM cut WHERE k < 6 AND len(p) > 2))),
 met AS (SELECT vec_id, q, r, {area} AS area FROM cut WHERE k = 6 AND len(p) > 2),
 held AS (SELECT DISTINCT q, r FROM near WHERE abs(cx - x) / {rx} + abs(cy - y) / {ry} <= 1),
 a AS (SELECT q, r, state, sum(area) AS area, sum(CASE WHEN class >= 4 THEN area ELSE 0 END) AS high, max(class) AS max_class, count(*) AS n FROM met JOIN poly USING (vec_id) JOIN held USING (q, r) WHERE area > 0 GROUP BY ALL)
 SELECT q || ':' || r AS cell_id, arg_max(state, (area, state))::VARCHAR AS state, round(sum(area), 3) AS area, round(sum(high), 3) AS high_area, max(max_class) AS max_class, sum(n)::BIGINT AS n_records,
  round(least(1, sum(high) / {1.5 * 3**0.5 * size * size!r}), 6) AS high_fraction, round(least(1, sum(area) / {1.5 * 3**0.5 * size * size!r}), 6) AS coverage FROM a GROUP BY q, r"""


@query("overlap_area", _overlap_sql(200.0, 300.0, 500.0))
def overlap_area(spark: SparkSession, sf: str) -> DataFrame:
    """Diamonds around points as classified polygons: overlap with cells, fractions, dominant state."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    polys = _points(spark, sf).select(F.col("vec_id").alias("feature_id"), (F.col("label") % 3).cast("string").alias("state"), (F.col("label") % 6).alias("class"), F.array(F.array(corner(300.0, 0.0), corner(0.0, 500.0), corner(-300.0, 0.0), corner(0.0, -500.0))).alias("rings"))
    out = spatial.reference_fractions(polys, 200.0)
    return out.withColumns({"area": F.round("area", 3), "high_area": F.round("high_area", 3), "high_fraction": F.round("high_fraction", 6), "coverage": F.round("coverage", 6)})


@query("metric_projection", """WITH p AS (SELECT vec_id, radians(embedding[1]::DOUBLE * 30) AS phi, radians(embedding[2]::DOUBLE * 20) AS lam FROM embeddings)
 SELECT vec_id, CASE WHEN abs(phi) < 1e-9 THEN round(lam * 6371007.2, 3) ELSE round(cos(phi) / sin(phi) * sin(lam * sin(phi)) * 6371007.2, 3) END AS x,
 CASE WHEN abs(phi) < 1e-9 THEN 0.0 ELSE round((phi + cos(phi) / sin(phi) * (1 - cos(lam * sin(phi)))) * 6371007.2, 3) END::DOUBLE AS y FROM p""")
def metric_projection(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings", "vec_id", "embedding")
    x, y = G.to_metric(F.col("embedding")[0].cast("double") * 30, F.col("embedding")[1].cast("double") * 20 - 54)
    return e.select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# aggregates, windows and reports


@query("column_profile", """SELECT 'o_totalprice' AS "column", count(o_totalprice)::DOUBLE AS n, count_if(o_totalprice IS NULL)::DOUBLE AS nulls, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, round(median(o_totalprice), 4) AS median, max(o_totalprice) AS max,
 count_if(o_totalprice = 0)::DOUBLE AS zeros, count_if(o_totalprice > 0)::DOUBLE AS positives, count_if(o_totalprice >= 0.999)::DOUBLE AS ones, count_if(o_totalprice <= 0.001)::DOUBLE AS near_zeros FROM orders""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.column_profile(_t(spark, sf, "orders", "o_totalprice"), ["o_totalprice"]), 4)


@query("group_quintiles", f"""WITH {_CELLS}, q AS (SELECT size_class, quantile_cont(price, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM cells GROUP BY 1 HAVING count(*) >= 10) SELECT size_class, {', '.join(f'round(b[{k + 1}], 4) AS b{k}' for k in range(6))} FROM q""")
def group_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.group_quintiles(_cells(spark, sf), "size_class", "price")
    return q.select("size_class", *(F.round(F.col("bounds")[k], 4).alias(f"b{k}") for k in range(6)))


@query("equal_intervals", "WITH l AS (SELECT greatest(0, min(l_discount)) AS a, least(1, max(l_discount)) AS b FROM lineitem) SELECT " + ", ".join(f"round(a + (b - a) / 5 * {k}, 6) AS b{k}" for k in range(6)) + " FROM l")
def equal_intervals(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.equal_intervals(_t(spark, sf, "lineitem", "l_discount"), "l_discount")
    return q.select(*(F.round(F.col("bounds")[k], 6).alias(f"b{k}") for k in range(6)))


@query("classify_by_bounds", f"""WITH {_CELLS}, q AS (SELECT size_class, quantile_cont(price, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM cells GROUP BY 1 HAVING count(*) >= 10)
 SELECT cell_id, greatest(1, least(5, (b[1] <= price)::INT + (b[2] <= price)::INT + (b[3] <= price)::INT + (b[4] <= price)::INT + (b[5] <= price)::INT + (b[6] <= price)::INT)) AS class FROM cells JOIN q USING (size_class)""")
def classify_by_bounds(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf)
    return stats.classify(cells, "size_class", "price", stats.group_quintiles(cells, "size_class", "price")).select("cell_id", "class")


@query("histogram", f"WITH {_SCORED} SELECT region, least(floor(score * 20), 19)::INT AS bin, count(*) AS n FROM scored GROUP BY ALL")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return tables.histogram(_scored(spark, sf), "score", 20, ["region"])


@query("density_grid", f"WITH v AS (SELECT l_discount * 10 AS x, l_tax * 12 AS y FROM lineitem), fx AS (SELECT {_axial_sql('x', 'y', 0.07)} FROM v WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) SELECT q, r, count(*) AS n FROM (SELECT {_ROUNDED} FROM fx) GROUP BY 1, 2")
def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "lineitem", "l_discount", "l_tax").select((F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 12).alias("y"))
    return stats.density_grid(v, "x", "y", 0.07)


@query("pct_below", "WITH m AS (SELECT c_mktsegment, round(avg(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_mktsegment, v, round(100.0 * (SELECT count(*) FROM orders WHERE o_totalprice < v) / (SELECT count(*) FROM orders), 6) AS percent FROM m")
def pct_below(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return _r(stats.percent_below(_t(spark, sf, "orders", "o_totalprice"), "o_totalprice", m, "c_mktsegment", "v"))


@query("rank_pct", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER (), 6) AS rank FROM orders")
def rank_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.percentile_rank(_t(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.col("rank").cast("double").alias("rank")))


@query("ecdf", "SELECT o_totalprice, round((row_number() OVER (ORDER BY o_totalprice) - 1) / (count(*) OVER () - 1), 6) AS share FROM orders")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.ecdf(_t(spark, sf, "orders", "o_totalprice"), "o_totalprice"))


@query("candidate_selection", f"""WITH {_CELLS}, p AS (SELECT *, muni % 4 AS cluster FROM (SELECT muni, any_value(region) AS region, any_value(size_class) AS size_class, avg(price) AS score FROM cells GROUP BY 1)),
 pool AS (SELECT p.* FROM p JOIN (SELECT cluster, median(score) AS m FROM p GROUP BY 1) USING (cluster) WHERE score >= m), f AS (SELECT *, row_number() OVER (PARTITION BY cluster, region, size_class ORDER BY score DESC, muni) = 1 AS first FROM pool),
 n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY first DESC, CASE WHEN first THEN region END, CASE WHEN first THEN size_class END, score DESC, muni) AS candidate_rank FROM f) SELECT muni AS id, cluster, candidate_rank FROM n WHERE first OR candidate_rank <= 50""")
def candidate_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = _cells(spark, sf).groupBy(F.col("muni").alias("id")).agg(F.first("region").alias("region"), F.first("size_class").alias("size_class"), F.avg("price").alias("score")).withColumn("cluster", F.col("id") % 4)
    return index.candidates(m).select("id", "cluster", F.col("candidate_rank").cast("long").alias("candidate_rank"))


@query("dominant_category", f"WITH {_CELLS} SELECT muni, arg_max(status, (a, status)) AS status, sum(a) AS total FROM (SELECT muni, status, count(*) AS a FROM cells GROUP BY 1, 2) GROUP BY 1")
def dominant_category(spark: SparkSession, sf: str) -> DataFrame:
    by = _cells(spark, sf).groupBy("muni", "status").agg(F.count("*").alias("a"))
    return by.groupBy("muni").agg(F.max_by("status", F.struct("a", "status")).alias("status"), F.sum("a").alias("total"))


@query("priority_pick", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'sig_x.zip' WHEN 1 THEN 'bc_x.zip' WHEN 2 THEN 'arquivos_vetoriais.zip' WHEN 3 THEN 'mde_x.zip' ELSE 'other.zip' END AS name, CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS k FROM lineitem)
 SELECT l_orderkey, name FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_linenumber, name) = 1""")
def priority_pick(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("sig_x.zip", "bc_x.zip", "arquivos_vetoriais.zip", "mde_x.zip", "other.zip")))
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("name", F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")))
    return tables.pick_archive(line, "l_orderkey", "name", "l_linenumber").select("l_orderkey", "name")


@query("status_pivot", f"WITH {_CELLS} SELECT state, count(*) AS total, count_if(status = 'F') AS \"F\", count_if(status = 'O') AS \"O\", count_if(status = 'P') AS \"P\" FROM cells GROUP BY 1")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return tables.status_pivot(_cells(spark, sf), "state", "status", ["F", "O", "P"])


@query("status_funnel", f"""WITH {_CELLS}, d AS (SELECT muni, priority, CASE WHEN bool_or(status = 'F') THEN 'error' WHEN bool_or(status = 'O') THEN 'sem_dado' WHEN bool_or(status = 'P') THEN 'ok' ELSE '' END AS download FROM cells GROUP BY 1, 2) SELECT download, count(*) AS n FROM d GROUP BY 1""")
def status_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The worst status of each municipality and kind, counted."""
    known = F.create_map(*map(F.lit, ("F", "error", "O", "sem_dado", "P", "ok")))
    cells = _cells(spark, sf).withColumn("status", F.try_element_at(known, F.col("status")))
    return tables.worst_status(cells, ["muni", "priority"], "status").groupBy(F.col("status").alias("download")).agg(F.count("*").alias("n"))


@query("class_mapping_upkeep", "WITH e AS (SELECT DISTINCT p_type AS class, p_size % 6 AS value FROM part WHERE p_size <= 10 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1), s AS (SELECT DISTINCT p_type AS class FROM part) SELECT coalesce(e.class, s.class) AS class, coalesce(value, CASE WHEN contains(coalesce(e.class, s.class), 'STEEL') THEN 5 END, -1)::INT AS value FROM e FULL JOIN s ON e.class = s.class")
def class_mapping_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part", "p_partkey", "p_type", "p_size")
    known = tables.dedup_first(part.filter("p_size <= 10"), ["p_type"], [F.col("p_partkey")]).select(F.col("p_type").alias("class"), (F.col("p_size") % 6).alias("value"))
    return tables.class_mapping(known, part.select(F.col("p_type").alias("class")), F.when(F.col("class").contains("STEEL"), 5)).withColumn("value", F.col("value").cast("int"))


@query("zscore_labels", f"""WITH {_CELLS}, o AS (SELECT avg(price) AS mu, stddev_samp(price) AS sd FROM cells), g AS (SELECT muni, avg(price) AS m FROM cells GROUP BY 1)
 SELECT muni, round((m - mu) / greatest(sd, 1e-9), 6) AS z, CASE WHEN abs((m - mu) / greatest(sd, 1e-9)) < 0.5 THEN 'near the mean in all dimensions' WHEN m > mu THEN 'high price' ELSE 'low price' END AS label FROM g, o""")
def zscore_labels(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf).select(F.col("muni").alias("cluster"), "price")
    out = index.cluster_profiles(cells, ["price"], {"price": ("high price", "low price")})
    return _r(out.select(F.col("cluster").alias("muni"), F.col("price_z").alias("z"), "label"))


@query("score_band_shares", f"WITH {_SCORED}, b AS (SELECT region, CASE WHEN score = 0 THEN 'zero' WHEN score <= 0.33 THEN 'low' WHEN score <= 0.66 THEN 'middle' ELSE 'high' END AS band FROM scored) SELECT region, band, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 6) AS share FROM b GROUP BY 1, 2")
def score_band_shares(spark: SparkSession, sf: str) -> DataFrame:
    bands = _scored(spark, sf).groupBy("region", S.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    return _r(tables.share_of_total(bands, "n", "region", "share").select("region", "band", "n", "share"))


@query("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 300")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return tables.hash_sample(_t(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", 300)


# validation and statistics


@query("threshold_sweep", f"""WITH {_SCORED}, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM generate_series(0, 20) g(i)), c AS (SELECT threshold, count_if(score > threshold AND reference) AS tp, count_if(score > threshold AND NOT reference) AS fp, count_if(NOT score > threshold AND reference) AS fn, count_if(NOT score > threshold AND NOT reference) AS tn FROM t, scored GROUP BY 1)
 SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, tp + fp AS n_pred_pos, tp + fn AS n_ref_pos FROM (SELECT *, {_F1} FROM c)""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.threshold_sweep(_scored(spark, sf), "score", "reference", [i / 20 for i in range(21)]))


@query("best_threshold", f"""WITH {_SCORED}, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM generate_series(0, 20) g(i)), c AS (SELECT threshold, count_if(score > threshold AND reference) AS tp, count_if(score > threshold AND NOT reference) AS fp, count_if(NOT score > threshold AND reference) AS fn FROM t, scored GROUP BY 1)
 SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, {_F1} FROM c) ORDER BY round(f1, 12) DESC, threshold LIMIT 1""")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.best_threshold(stats.threshold_sweep(_scored(spark, sf), "score", "reference", [i / 20 for i in range(21)])).select("threshold", "f1"))


@query("regional_f1", f"""WITH {_SCORED}, c AS (SELECT region, count_if(score > 0.1 AND reference) AS tp, count_if(score > 0.1 AND NOT reference) AS fp, count_if(score <= 0.1 AND reference) AS fn, count_if(score <= 0.1 AND NOT reference) AS tn FROM scored WHERE NOT used AND coverage >= 0.5 GROUP BY 1)
 SELECT region, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_F1} FROM c)""")
def regional_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _r(index.validation(_scored(spark, sf), "score", "reference", "coverage", "used", 0.1, "region")[1])


@query("false_negatives", f"""WITH {_SCORED} SELECT coalesce(region, 'all') AS region, count_if(reference AND score <= 0.1) AS n, round(avg(score) FILTER (reference AND score <= 0.1), 6) AS mean_score, round(avg((score = 0)::INT) FILTER (reference AND score <= 0.1), 6) AS zero_share, round(count_if(reference AND score <= 0.1) / nullif(count_if(reference), 0), 6) AS rate FROM scored WHERE NOT used AND coverage >= 0.5 GROUP BY ROLLUP (region)""")
def false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _r(index.validation(_scored(spark, sf), "score", "reference", "coverage", "used", 0.1, "region")[2])


_WIDE = "SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem"


@query("spearman_pairs", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, count(*) AS n, round(corr(rx, ry), 6) AS rho, abs(corr(rx, ry)) >= 0.7 AS strong FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM ({_WIDE}))" for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount").toDF("a", "b", "c")
    return _r(stats.spearman_pairs(line, ["a", "b", "c"]))


@query("pearson_regression", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def pearson_regression(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.regression(_t(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("variance_weights", """WITH s AS (SELECT 1 / stddev_samp(l_discount) AS a, 1 / stddev_samp(l_tax) AS b FROM lineitem), d AS (SELECT l_discount * a / (a + b) + l_tax * b / (a + b) - (l_discount + l_tax) / 2 AS d FROM lineitem, s)
 SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.95), 6) AS p95, count_if(abs(d) > 0.001) AS beyond FROM d""")
def variance_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.weight_sensitivity(_t(spark, sf, "lineitem", "l_discount", "l_tax"), ["l_discount", "l_tax"], 0.001))


@query("quality_status", f"""WITH {_CELLS} SELECT size_class, CASE WHEN p = 0 AND z < 1 THEN 'SPARSE' WHEN p = 0 THEN 'COLLAPSE' WHEN z < 1 THEN 'RISK' WHEN z < 5 THEN 'SPARSE' ELSE 'OK' END AS status FROM (SELECT size_class, quantile_cont(greatest(balance, 0), 0.99) AS p, avg((balance > 0)::INT) * 100 AS z FROM cells GROUP BY 1)""")
def quality_status(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf)
    cut = tables.group_quantiles(cells.select("size_class", F.greatest("balance", F.lit(0.0)).alias("v")), "size_class", "v", [0.99]).select("size_class", F.col("q")[0].alias("p"))
    by = cells.groupBy("size_class").agg((F.avg((F.col("balance") > 0).cast("int")) * 100).alias("z")).join(cut, "size_class", "left")
    return by.select("size_class", S.quality_status(F.col("p"), F.col("z")).alias("status"))


@query("box_summary", f"""WITH {_CELLS}, q AS (SELECT size_class, quantile_cont(price, 0.25) AS q1, median(price) AS median, quantile_cont(price, 0.75) AS q3 FROM cells GROUP BY 1)
 SELECT size_class, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(price) AS low, max(price) AS high FROM cells JOIN q USING (size_class) WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def box_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.box_summary(_cells(spark, sf), "size_class", "price"), 4)


@query("code_canon", "SELECT c_custkey, lpad((c_custkey * 7)::VARCHAR, 7, '0') AS code FROM customer")
def code_canon(spark: SparkSession, sf: str) -> DataFrame:
    """Codes as they come from different files: text, whole, decimal."""
    c = _t(spark, sf, "customer", "c_custkey")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), (F.col("c_custkey") * 7).cast("string"), F.lit(".0"))).otherwise((F.col("c_custkey") * 7).cast("string"))
    return c.select("c_custkey", S.canon_code(raw).alias("code"))


@query("text_rules", """SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS slug, CASE WHEN n_nationkey % 3 = 0 THEN 'massa' WHEN n_nationkey % 3 = 1 THEN 'inundacao' ELSE 'outros' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 4 WHEN n_nationkey % 3 = 1 THEN 4 END AS class FROM nation""")
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    layer = F.element_at(F.array(*map(F.lit, ("Deslizamento_A", "Inundacao_A", "HID_Massa"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", S.slug(F.col("n_name")).alias("slug"), S.classify_kind(F.concat_ws("/", F.lit("base"), "n_name", layer)).alias("kind"), F.when(F.col("n_nationkey") % 3 < 2, S.infer_class(layer)).alias("class"))


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    m = _cells(spark, sf).groupBy("muni").agg(F.avg("price").alias("price"), F.first("balance").alias("balance"))
    return stats.kmeans(m, ["price", "balance"], "price", "muni")


@query("kmeans_profiles")
def kmeans_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Municipalities by mean price and balance: clusters and their profiles. Their centres depend on random starts: kmeans_nearest checks them."""
    return _r(index.cluster_profiles(_clustered(spark, sf), ["price", "balance"], {"price": ("dear", "cheap"), "balance": ("rich", "poor")}))


@query("kmeans_nearest", f"WITH {_CELLS} SELECT count(DISTINCT muni) AS n, 4::BIGINT AS clusters, 0::BIGINT AS misplaced, 0::BIGINT AS misnumbered FROM cells")
def kmeans_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """What makes a clustering one: rows, clusters, rows nearer to another cluster's mean than to their own's, clusters out of order."""
    rows = written(spark, _clustered(spark, sf))
    scale = rows.agg(F.stddev_samp("price").alias("sp"), F.stddev_samp("balance").alias("sb"))
    means = rows.groupBy("cluster").agg(F.avg("price").alias("mp"), F.avg("balance").alias("mb"))  # four rows
    gap = ((F.col("price") - F.col("mp")) / F.col("sp")) ** 2 + ((F.col("balance") - F.col("mb")) / F.col("sb")) ** 2
    met = rows.withColumnRenamed("cluster", "own").crossJoin(F.broadcast(means)).crossJoin(F.broadcast(scale)).withColumn("gap", gap)
    by = met.groupBy("muni").agg(F.min("gap").alias("least"), F.max(F.when(F.col("own") == F.col("cluster"), F.col("gap"))).alias("mine"))
    order = means.select("cluster", F.col("mp"), F.lag("mp").over(Window.orderBy("cluster")).alias("before")).agg(F.count("*").alias("clusters"), F.count_if(F.col("mp") > F.col("before")).alias("misnumbered"))
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("mine") > F.col("least") * 1.001 + 1e-3).alias("misplaced")).crossJoin(order).select("n", "clusters", "misplaced", "misnumbered")


_PCA = ("a", "b", "c", "d")


def _power(name: str, matrix: str, steps: int = 600) -> str:
    """The greatest eigenvalue of a 4 x 4 matrix and its vector, by power iteration."""
    times = "[list_dot_product(m[1], v), list_dot_product(m[2], v), list_dot_product(m[3], v), list_dot_product(m[4], v)]"
    return f"""{name}_it(k, m, v) AS (SELECT 0, m, [0.9, 0.7, 0.5, 0.3]::DOUBLE[] FROM {matrix} UNION ALL SELECT k + 1, m, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (SELECT k, m, {times} AS u FROM {name}_it WHERE k < {steps})),
 {name} AS (SELECT m, v, list_dot_product(v, {times}) AS l FROM {name}_it WHERE k = {steps})"""


@query("pca2", "WITH RECURSIVE x AS (SELECT l_quantity AS a, l_extendedprice + 1000 * l_quantity AS b, l_discount AS c, l_discount + l_tax AS d FROM lineitem), r AS (SELECT [" + ", ".join("[" + ", ".join(f"corr({i}, {j})" for j in _PCA) + "]" for i in _PCA) + "] AS m FROM x), " + _power("one", "r")
 + ", r2 AS (SELECT list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM one), " + _power("two", "r2")
 + " SELECT ['a', 'b', 'c', 'd'][i] AS \"column\", k AS component, round(v[i] * v[i], 5) AS loading_squared, round(l / 4, 6) AS explained, round(l, 5) AS score_variance FROM (SELECT 1 AS k, v, l FROM one UNION ALL SELECT 2, v, l FROM two), (SELECT unnest(range(1, 5)) AS i)")
def pca2(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings (squared: their signs are free), explained shares, and the variance of the scores, which is the eigenvalue."""
    x = _t(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") + 1000 * F.col("l_quantity")).alias("b"), F.col("l_discount").alias("c"), (F.col("l_discount") + F.col("l_tax")).alias("d"))
    scores, loadings = stats.pca(x, _PCA)
    variance = scores.agg(F.array(F.var_samp("pc1"), F.var_samp("pc2")).alias("v"))  # one row
    return loadings.crossJoin(F.broadcast(variance)).select("column", F.col("component").cast("int").alias("component"), F.round(F.col("loading") ** 2, 5).alias("loading_squared"), F.round("explained", 6).alias("explained"), F.round(F.get("v", F.col("component") - 1), 5).alias("score_variance"))


@query("archive_coverage", """WITH v AS (SELECT l_orderkey AS archive, CASE l_returnflag WHEN 'A' THEN 'inundacao' WHEN 'N' THEN 'massa' ELSE 'outros' END AS kind, l_linestatus AS class FROM lineitem)
 SELECT archive, count_if(kind = 'inundacao') AS n_flood, count_if(kind = 'massa') AS n_mass, coalesce(string_agg(DISTINCT class, '|' ORDER BY class) FILTER (kind = 'inundacao'), '') AS flood_classes, coalesce(string_agg(DISTINCT class, '|' ORDER BY class) FILTER (kind = 'massa'), '') AS mass_classes,
 CASE WHEN count_if(kind = 'inundacao') > 0 AND count_if(kind = 'massa') > 0 THEN 'complete' WHEN count_if(kind <> 'outros') > 0 THEN 'partial' ELSE 'none' END AS status FROM v GROUP BY 1""")
def archive_coverage(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    inventory = line.select(F.col("l_orderkey").alias("archive"), F.when(F.col("l_returnflag") == "A", "inundacao").when(F.col("l_returnflag") == "N", "massa").otherwise("outros").alias("kind"), F.col("l_linestatus").alias("class"), F.lit(False).alias("error"))
    return tables.archive_coverage(inventory).select("archive", "n_flood", "n_mass", "flood_classes", "mass_classes", "status")


@query("archive_issues", """WITH v AS (SELECT l_orderkey AS archive, CASE l_returnflag WHEN 'A' THEN 'inundacao' WHEN 'N' THEN 'massa' ELSE 'outros' END AS kind, l_linenumber::VARCHAR AS path, l_tax > 0.04 AS has_class, l_discount >= 0.1 AS broken FROM lineitem)
 SELECT archive, bool_or(kind = 'inundacao') AS has_flood, bool_or(kind = 'massa') AS has_mass, coalesce(string_agg(DISTINCT path, '|' ORDER BY path) FILTER (kind = 'outros'), '') AS unclassified,
 coalesce(string_agg(DISTINCT path, '|' ORDER BY path) FILTER (kind <> 'outros' AND NOT has_class), '') AS without_class, coalesce(string_agg(DISTINCT path, '|' ORDER BY path) FILTER (broken), '') AS errors FROM v GROUP BY 1""")
def archive_issues(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_tax", "l_discount")
    kind = F.when(F.col("l_returnflag") == "A", "inundacao").when(F.col("l_returnflag") == "N", "massa").otherwise("outros")
    inventory = line.select(F.col("l_orderkey").alias("archive"), kind.alias("kind"), F.col("l_linenumber").cast("string").alias("path"), F.when(F.col("l_tax") > 0.04, "CLASSE").alias("class_column"), F.when(F.col("l_discount") >= 0.1, "Bad CRC").alias("notes"))
    return tables.archive_issues(inventory)


@query("place_summary", f"""WITH {_CELLS} SELECT muni, count(*) AS n, round(avg(price), 8) AS mean, min(price) AS least, max(price) AS greatest, round(avg(balance), 8) AS balance, round(avg(balance) - (SELECT avg(balance) FROM cells), 8) AS balance_against_all FROM cells GROUP BY 1""")
def place_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.place_summary(_cells(spark, sf), "muni", "price", ["balance"]), 8)


@query("value_shares", "SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _r(tables.value_shares(_t(spark, sf, "lineitem", "l_returnflag"), "l_returnflag"))


@query("coverage_by_region", f"""WITH {_CELLS} SELECT coalesce(region, 'all') AS region, count(*) AS total, count_if(price >= 200000) AS covered, round(avg((price >= 200000)::INT), 6) AS share, round(median(price), 4) AS median FROM cells GROUP BY ROLLUP (region)""")
def coverage_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Region and national rows from one pass."""
    full = F.col("price") >= 200_000
    cells = _cells(spark, sf)
    out = tables.regional_summary(cells, "region", {"total": F.count("*"), "covered": F.count_if(full), "share": F.avg(full.cast("int"))})
    whole = tables.group_quantiles(cells.select(F.lit("all").alias("region"), "price"), "region", "price", [0.5])
    medians = tables.group_quantiles(cells, "region", "price", [0.5]).unionByName(whole).select(F.col("region").alias("__region"), F.col("q")[0].alias("median"))
    out = out.join(medians, F.col("region").eqNullSafe(F.col("__region")), "left")
    return out.select("region", "total", "covered", F.round("share", 6).alias("share"), F.round("median", 4).alias("median"))


@query("window_counts", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream's tumbling counts give once every window is closed."""
    ev = _t(spark, sf, "events", "ts", "event_type").withColumn("t", F.col("ts").cast("timestamp"))
    return ev.groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


