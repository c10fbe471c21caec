"""Scaling, sweeps, correlations, weights, class bounds and clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions.scalars import precision_recall_f1, to_num
from gridindex.operators.ranks import cumulative, group_quantiles, ranked, spread
from gridindex.operators.tables import column_quantiles, quantiles
from gridindex.shared import written


def normalize_minmax(df: DataFrame, columns: Sequence[str], winsorize: tuple[float, float] | None = None, suffix: str = "_norm", mode: str = "sorted") -> DataFrame:
    """Columns scaled to [0, 1], after clipping to two quantiles where asked.

    Missing stays missing, but a constant column is 0 in every row; a column without numbers stays missing. All columns'
    statistics come from one aggregate, and only they come back.
    """
    value = {c: to_num(F.col(c)) for c in columns}
    if winsorize and mode == "sorted":
        found = column_quantiles(df, value, winsorize)
        limits = {c: found.get(c, [None, None]) for c in columns}
    elif winsorize:
        f = F.percentile if mode == "exact" else (lambda v, q: F.percentile_approx(v, q, 10_000))
        row = df.agg(*(f(value[c], F.array(*map(F.lit, winsorize))).alias(c) for c in columns)).head()
        limits = {c: row[c] or [None, None] for c in columns}
    else:
        row = df.agg(*(F.array(F.min(value[c]), F.max(value[c])).alias(c) for c in columns)).head()
        limits = {c: row[c] for c in columns}
    out = {}
    for c in columns:
        lo, hi = limits[c]
        if lo is None:
            out[c + suffix] = F.lit(None).cast("double")
        elif lo == hi:
            out[c + suffix] = F.lit(0.0)
        else:
            clipped = F.when(value[c].isNotNull(), F.least(F.greatest(value[c], F.lit(lo)), F.lit(hi)))
            out[c + suffix] = (clipped - lo) / (hi - lo)
    return df.withColumns(out)


def threshold_sweep(df: DataFrame, score: str, reference: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1, n_pred_pos, n_ref_pos for score > threshold.

    Scores are counted once by the number of thresholds they pass; the sweep itself runs over that many rows.
    """
    cuts = sorted(thresholds)
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < F.col(score)))
    rows = df.filter(F.col(score).isNotNull() & F.col(reference).isNotNull())
    counts = rows.groupBy(passed.alias("passed")).agg(F.count_if(F.col(reference)).alias("pos"), F.count_if(~F.col(reference)).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(map(float, cuts))), "k int, threshold double")
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    above = F.broadcast(grid).join(F.broadcast(counts), F.col("passed") > F.col("k"), "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    full = above.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.coalesce("all_pos", F.lit(0)) - F.col("tp")).alias("fn"), (F.coalesce("all_neg", F.lit(0)) - F.col("fp")).alias("tn"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return full.withColumns({"precision": p, "recall": r, "f1": f, "n_pred_pos": F.col("tp") + F.col("fp"), "n_ref_pos": F.col("tp") + F.col("fn")})


def top_thresholds(sweep: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of the greatest F1, of equals the lowest threshold first, with their rank."""
    first = Window.orderBy(F.desc("f1"), "threshold")  # a sweep has a row a threshold
    return sweep.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the greatest F1, of equals the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def _gap_pairs(table: DataFrame, pairs: Sequence[tuple[int, int]], rows: int) -> DataFrame:
    """i, j, n, rho of columns v0, v1, ... (and an id) over the rows where both are there, each pair with ranks of its own."""
    side = lambda g, s, k: F.struct(F.lit(g).alias("g"), F.lit(s).alias("side"), F.col(f"v{k}").alias("v"))
    items = [F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), F.array(side(g, 0, i), side(g, 1, j))) for g, (i, j) in enumerate(pairs)]
    long = table.select("id", F.explode(F.flatten(F.filter(F.array(*items), lambda x: x.isNotNull()))).alias("r")).select("id", "r.*")
    most = 2 * len(pairs) * rows
    ranks = spread(ranked(long, ["g", "side"], "v", rows=most).select("g", "side", "id", "rank"), most, "g", "id").groupBy("g", "id").agg(*(F.max(F.when(F.col("side") == k, F.col("rank"))).alias(f"r{k}") for k in (0, 1)))
    one = ranks.groupBy("g").agg(F.count("*").alias("n"), F.corr("r0", "r1").alias("rho"))
    names = table.sparkSession.createDataFrame([(g, i, j) for g, (i, j) in enumerate(pairs)], "g int, i int, j int")
    return one.join(F.broadcast(names), "g").select("i", "j", "n", "rho")


def _whole_pairs(table: DataFrame, pairs: Sequence[tuple[int, int]], rows: int) -> DataFrame:
    """i, j, n, rho of columns without missing values: each is ranked once, and all correlations are one aggregate."""
    columns = sorted({k for p in pairs for k in p})
    long = table.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"v{k}").alias("v")) for k in columns))).alias("r")).select("id", "r.c", "r.v")
    every = len(columns) * rows
    wide = spread(ranked(long, ["c"], "v", rows=every).select("id", "c", "rank"), every, "id").groupBy("id").agg(*(F.max(F.when(F.col("c") == k, F.col("rank"))).alias(f"r{k}") for k in columns))
    one = wide.agg(F.count("*").alias("n"), *(F.corr(f"r{i}", f"r{j}").alias(f"p{g}") for g, (i, j) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("n"), F.col(f"p{g}").alias("rho")) for g, (i, j) in enumerate(pairs)))).alias("r")).select("r.*")


def spearman_pairs(df: DataFrame, columns: Sequence[str], flag_at: float = 0.7) -> DataFrame:
    """a, b, n, rho and a flag for strong pairs, over rows where both are there; ties share ranks. Strongest first, then by name.

    Only pairs with a column that has missing values are ranked pair by pair; the number of jobs follows neither the number
    of columns nor that of pairs.
    """
    spark = df.sparkSession
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, n long, rho double, strong boolean")
    rows = df.select(F.monotonically_increasing_id().alias("id"), *(to_num(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)))
    rows = written(spark, rows)  # ids stay as they are
    missing = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"v{i}").isNull()).alias(f"v{i}") for i in range(len(columns)))).head()
    gaps = {i for i in range(len(columns)) if missing[f"v{i}"]}
    found = [f(rows, some, missing["rows"]) for f, some in ((_whole_pairs, [p for p in pairs if not gaps & set(p)]), (_gap_pairs, [p for p in pairs if gaps & set(p)])) if some]
    sums = reduce(DataFrame.unionByName, found)
    every = spark.createDataFrame([(i, j, columns[i], columns[j]) for i, j in pairs], "i int, j int, a string, b string")  # a row a pair
    out = F.broadcast(every).join(F.broadcast(sums), ["i", "j"], "left")
    out = out.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "rho", F.coalesce(F.abs("rho") >= flag_at, F.lit(False)).alias("strong"))
    return out.orderBy(F.abs("rho").desc_nulls_last(), "a", "b")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, Pearson's r, slope, intercept and R squared over complete pairs."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def variance_weights(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """(1 / sd) over their sum: dimensions of more spread weigh less."""
    row = df.dropna(subset=list(columns)).agg(*(F.stddev_samp(c).alias(c) for c in columns)).head()
    inverse = {c: 1 / row[c] for c in columns if row[c]}
    return {c: v / sum(inverse.values()) for c, v in inverse.items()}


def weight_sensitivity(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """How far the variance-weighted index is from the plain mean: mean, P5, P95, and how many rows are beyond the limit."""
    weights = variance_weights(df, columns)
    whole = df.dropna(subset=list(columns))
    delta = sum((F.col(c) * weights.get(c, 0.0) for c in columns), F.lit(0.0)) - sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    d = whole.select(delta.alias("d"))
    p5, p95 = (F.lit(x).cast("double") for x in quantiles(d, "d", [0.05, 0.95]) or [None, None])
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), p5.alias("p5"), p95.alias("p95"), F.count_if(F.abs("d") > limit).alias("beyond"))


def group_quintiles(df: DataFrame, by: str, value: str, least: int = 10) -> DataFrame:
    """Quintile bounds a group (groups of fewer values have none), forced to ascend."""
    q = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).transform(group_quantiles, by, value, [k / 5 for k in range(6)]).filter(F.col("n") >= least)
    rising = F.aggregate(F.slice("q", 2, 5), F.slice("q", 1, 1), lambda acc, x: F.concat(acc, F.array(F.when(x <= F.element_at(acc, -1), F.element_at(acc, -1) + 1e-6).otherwise(x))))
    return q.select(by, rising.alias("bounds"))


def equal_intervals(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """One row: bounds of equal width over the values' range within [0, 1]."""
    lo, hi = F.greatest(F.lit(0.0), F.col("lo")), F.least(F.lit(1.0), F.col("hi"))
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).select(lo.alias("lo"), hi.alias("hi"))
    width = (F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 0.001).otherwise(F.col("hi")) - F.col("lo")) / classes
    return ends.select(F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda k: F.when(k == classes, F.least(F.lit(1.0), F.col("lo") + width * k)).otherwise(F.col("lo") + width * k)).alias("bounds"))


FALLBACK_BOUNDS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def classify(df: DataFrame, by: str, value: str, bounds: DataFrame) -> DataFrame:
    """df with its class 1 to 5 by its group's bounds, or by the plain fifths where the group has none."""
    from gridindex.functions.scalars import class_label, class_of

    joined = df.join(bounds, by, "left").withColumn("bounds", F.coalesce("bounds", F.array(*map(F.lit, FALLBACK_BOUNDS))))
    return joined.withColumn("class", class_of(F.col(value), F.col("bounds"))).withColumn("label", class_label(F.col("bounds"), F.col("class"))).drop("bounds")


def density_grid(df: DataFrame, x: str, y: str, size: float = 0.02) -> DataFrame:
    """Counts in hexagonal bins of the unit square."""
    from gridindex.functions.grid import axial

    q, r = axial(F.col(x), F.col(y), size)
    return df.filter(F.col(x).between(0, 1) & F.col(y).between(0, 1)).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


def percent_below(df: DataFrame, value: str, limits: DataFrame, key: str, limit: str) -> DataFrame:
    """For each row of limits, the percentage of values strictly below it: value counts, summed by ranges, then one lookup."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    both = counts.select("v", "n").unionByName(limits.select(F.col(limit).cast("double").alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("v").agg(F.sum("n").alias("n"))
    placed = cumulative(both, "v", "n").select(F.col("v").alias("__limit"), (100.0 * F.col("before") / F.col("total")).alias("percent"))
    return limits.withColumn("__limit", F.col(limit).cast("double")).join(placed, "__limit").select(key, limit, "percent")


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles a group, and whiskers: the furthest values within one and a half interquartile ranges."""
    q = group_quantiles(df, by, value, [0.25, 0.5, 0.75])
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(by, "q1", "median", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


class Start(NamedTuple):
    """One k-means start: its centres on standardised columns and the sum of squared distances to the nearest of them."""

    centres: list[list[float]]
    inertia: float


def _numbers(x: list | float) -> Column:
    """Nested lists of numbers as one literal (column by column, it would take a call for each number)."""
    sql = lambda v: f"array({', '.join(map(sql, v))})" if isinstance(v, list) else f"{v!r}D"
    return F.expr(sql(x))


#: Rows that are compared with all centres at once: what they need stays in the processor's cache.
STEP = 1024


def _nearest_sums(starts: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task hands on: for each start and centre the number of rows nearest to it, their squared distances and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.stack(starts)  # start, centre, column
        n, d, sums = np.zeros(first.shape[:2], np.int64), np.zeros(first.shape[:2]), np.zeros(first.shape)
        width, offset = first.shape[1], np.arange(len(first)) * first.shape[1]
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for at in range(0, len(rows), STEP):
                p = rows[at : at + STEP]
                least, own = np.full((len(p), len(first)), np.inf), np.zeros((len(p), len(first)), np.int64)
                for i in range(width):
                    square = sum((p[:, j, None] - first[None, :, i, j]) ** 2 for j in range(p.shape[1]))
                    nearer = square < least  # the first of equals
                    np.copyto(own, i, where=nearer)
                    np.copyto(least, square, where=nearer)
                place = (own + offset).ravel()
                total = lambda w: np.bincount(place, weights=w, minlength=n.size).reshape(n.shape)
                n += np.bincount(place, minlength=n.size).reshape(n.shape)
                d += total(least.ravel())
                for j in range(p.shape[1]):
                    sums[:, :, j] += total(np.repeat(p[:, j], len(first)))
        out = [(s, i, int(n[s, i]), float(d[s, i]), sums[s, i].tolist()) for s, i in np.argwhere(n).tolist()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["s", "i", "n", "d", "sums"])

    return run


def lloyd(rows: DataFrame, x: str, centres: Sequence[list[list[float]]], iterations: int = 100, still: float = 1e-9) -> list[Start]:
    """Several k-means starts side by side over an array column: each iteration is one pass and one aggregate for all of them.

    A task hands on one sum a start and centre, whatever its rows. A centre without rows stays; a row between two centres goes
    to the first. Starts that have come to rest are left alone while others go on.
    """
    now, inertia = [list(map(list, c)) for c in centres], [math.inf] * len(centres)
    size, open_ = len(now[0][0]), list(range(len(now)))
    for step in range(iterations + 1):
        parts = rows.select(x).mapInArrow(_nearest_sums([np.array(now[s]) for s in open_]), "s int, i int, n long, d double, sums array<double>")
        found = parts.groupBy("s", "i").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums")).collect()  # a row a start and centre
        for place, s in enumerate(open_):
            inertia[s] = math.fsum(r.d for r in found if r.s == place)
        if step == iterations:
            break
        resting = set(open_)
        for r in found:
            s = open_[r.s]
            moved = [v / r.n for v in r.sums]
            if max(abs(a - b) for a, b in zip(moved, now[s][r.i], strict=True)) > still:
                now[s][r.i] = moved
                resting.discard(s)
        open_ = [s for s in open_ if s not in resting]
        if not open_:
            break
    return [Start(c, d) for c, d in zip(now, inertia, strict=True)]


def kmeans_starts(df: DataFrame, columns: Sequence[str], key: str, k: int = 4, seed: int = 42, starts: int = 20, iterations: int = 100) -> tuple[DataFrame, list[Start]]:
    """(complete cases with their standardised columns as __z, in the shared folder, and every start at rest).

    The starts x k rows of least hash of their key are the first centres: start 0 takes the first k of them, and so on. Too
    few rows give fewer starts, and one of fewer than k centres where there are fewer than k rows.
    """
    whole = df.dropna(subset=list(columns))
    row = whole.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).head()
    z = F.array(*((F.col(c) - (row[f"{c}__mean"] or 0.0)) / (row[f"{c}__sd"] or 1.0) for c in columns))
    # a file a core: an iteration is much work on few bytes, which would be few tasks
    rows = written(df.sparkSession, whole.withColumn("__z", z).repartition(df.sparkSession.sparkContext.defaultParallelism))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    first = [list(r[0]) for r in rows.orderBy(order, key).limit(starts * k).select("__z").collect()]
    matrices = [first[i : i + k] for i in range(0, len(first), k) if i == 0 or len(first) >= i + k]
    return rows, lloyd(rows, "__z", matrices, iterations) if matrices else []


def kmeans(df: DataFrame, columns: Sequence[str], score: str, key: str, k: int = 4, seed: int = 42, starts: int = 20, iterations: int = 100) -> DataFrame:
    """df (complete cases) with a cluster 0 .. k - 1, numbered by falling mean score; the start of least inertia (to six places)."""
    rows, tried = kmeans_starts(df.dropna(subset=[score]), columns, key, k, seed, starts, iterations)
    if not tried:
        return rows.withColumn("cluster", F.lit(None).cast("int")).drop("__z")
    best = min(tried, key=lambda s: round(s.inertia, 6)).centres
    square = lambda c: F.aggregate(F.zip_with("__z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    own = F.array_min(F.transform(_numbers(best), lambda c, i: F.struct(square(c).alias("d"), i.alias("i"))))["i"]
    found = rows.withColumn("__c", own)
    means = sorted(found.groupBy("__c").agg(F.avg(score).alias("m")).collect(), key=lambda r: (-r.m, r["__c"]))  # k rows
    name = F.create_map(*(F.lit(x) for rank, r in enumerate(means) for x in (r["__c"], rank)))
    return found.withColumn("cluster", F.element_at(name, F.col("__c"))).drop("__z", "__c")


def pca(df: DataFrame, columns: Sequence[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(df with pc1 .. pck, loadings with explained shares) on standardised columns; signs are free."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    raw = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(df.dropna(subset=list(columns)))
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(raw).transform(raw)
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(scaled)
    scores = model.transform(scaled).withColumn("__pc", vector_to_array("__pc"))
    out = scores.select(*df.columns, *(F.col("__pc")[i].alias(f"pc{i + 1}") for i in range(k)))
    weights, shares = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(c, i + 1, float(weights[j, i]), float(shares[i])) for j, c in enumerate(columns) for i in range(k)]
    return out, df.sparkSession.createDataFrame(rows, "column string, component int, loading double, explained double")


def recommendations(sweep: DataFrame, regional: DataFrame, current: float, misses: DataFrame) -> DataFrame:
    """What a calibration suggests: a better threshold (F1 gain over .02), weak regions (.15 below the best), regions whose misses mostly score 0."""
    now = sweep.filter(F.abs(F.col("threshold") - current) < 1e-9).select(F.col("f1").alias("now"))
    better = best_threshold(sweep).crossJoin(F.broadcast(now)).filter("f1 - now > 0.02").select(F.lit("threshold").alias("kind"), F.col("threshold").cast("string").alias("subject"), (F.col("f1") - F.col("now")).alias("amount"))
    top = regional.agg(F.max("f1").alias("best"))
    weak = regional.crossJoin(F.broadcast(top)).filter("f1 < best - 0.15").select(F.lit("weak region").alias("kind"), F.col("region").alias("subject"), (F.col("best") - F.col("f1")).alias("amount"))
    blind = misses.filter("zero_share > 0.7").select(F.lit("zero scores").alias("kind"), F.col("region").alias("subject"), F.col("zero_share").alias("amount"))
    return better.unionByName(weak).unionByName(blind)
