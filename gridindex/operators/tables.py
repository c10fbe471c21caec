"""Joins, aggregates, windows and sets over cells, tracts and municipalities."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions.scalars import joined_distinct, precision_recall_f1, safe_ratio, to_num
from gridindex.operators.ranks import cumulative, group_quantiles, ranked
from gridindex.shared import written

# joins


def merge_indicators(base: DataFrame, tables: Mapping[str, DataFrame], key: str = "cell_id", value: str = "value") -> DataFrame:
    """base with one column for each indicator: the mean of its rows a key, missing where it has none.

    All tables go long, are averaged and pivoted in one aggregate and joined once: three shuffles, however many tables.
    """
    long = reduce(DataFrame.unionByName, (df.select(key, F.lit(name).alias("indicator"), F.col(value).cast("double").alias("value")) for name, df in tables.items()))
    wide = long.groupBy(key).agg(*(F.avg(F.when(F.col("indicator") == name, F.col("value"))).alias(name) for name in tables))
    return base.join(wide, key, "left")


def merge_stored(base: DataFrame, tables: Mapping[str, DataFrame], key: str = "cell_id", value: str = "value") -> DataFrame:
    """merge_indicators for tables that lie in buckets of the key (sinks.save_bucketed, all with as many): nothing is shuffled.

    Each table is averaged inside its buckets and joined to the same bucket of the others.
    """
    out = base
    for name, df in tables.items():
        out = out.join(dedup_mean(df.select(key, F.col(value).cast("double").alias(name)), key, [name]).hint("merge"), key, "left")
    return out


def outer_accumulate(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All keys; of tables that share a column the first one gives it."""
    out = tables[0]
    for df in tables[1:]:
        out = out.join(df.select(key, *(c for c in df.columns if c not in out.columns)), key, "full")
    return out


def onto_grid(grid: DataFrame, values: DataFrame, key: str = "cell_id") -> DataFrame:
    """Values re-gridded: cells without one stay missing."""
    return grid.join(values, key, "left")


def enrich(df: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(lookup, on, "left")


def only_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key the other table has too."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys), keys, "left_semi")


def not_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys), keys, "left_anti")


def harmonise_code_length(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Where the usual code lengths differ, both are cut to the shorter."""
    usual = lambda d: d.select(F.mode(F.length(key), deterministic=True)).head()[0]
    n, m = usual(a), usual(b)
    if n is None or m is None or n == m:
        return a, b
    cut = lambda d: d.withColumn(key, F.substring(key, 1, min(n, m)))
    return cut(a), cut(b)


# aggregates


def dedup_mean(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.avg(v).alias(v) for v in values))


def weighted_sums(df: DataFrame, key: str, weight: str, values: Sequence[str]) -> DataFrame:
    """Dasymetric sums: value times weight, missing as 0."""
    return df.groupBy(key).agg(*(F.sum(F.coalesce(to_num(F.col(v)), F.lit(0.0)) * F.col(weight)).alias(v) for v in values))


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in an order that must be total to be reproducible."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def dedup_last(df: DataFrame, keys: Sequence[str], by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's greatest row by the given columns: an aggregate, without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by, *values)).alias("__last")).select(*keys, "__last.*")


def weighted_mean(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Per group: means weighted by households (missing 1, at least 0.001), a missing value leaving its weight out; rows and total weight."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(0.001))
    mean = lambda v: F.try_divide(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w)))
    return df.groupBy(*keys).agg(*(mean(v).alias(v) for v in values), F.count("*").alias("n_cells"), F.coalesce(F.sum(weight).cast("double"), F.lit(0.0)).alias("households"))


def per_capita(df: DataFrame, key: str, value: str, population: str) -> DataFrame:
    """Mean over ledger rows of value by population; 0 where there is nobody."""
    return df.groupBy(key).agg(F.avg(F.when(F.col(population) > 0, F.col(value) / F.col(population)).otherwise(F.lit(0.0))).alias("per_capita"))


def mean_of_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of group means, and the percentage of groups whose mean is 1."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), (F.avg((F.col("m") == 1).cast("int")) * 100).alias("percent_full"), F.count("*").alias("groups"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], mode: str = "sorted") -> list[float]:
    """Linear-interpolated quantiles. sorted: exact, from counts summed by ranges (group_quantiles); exact: Spark's percentile,
    which holds every distinct value in one task; approx: a sketch."""
    if mode == "exact":
        return list(df.select(F.percentile(column, F.array(*map(F.lit, shares)))).head()[0] or [])
    if mode == "approx":
        return list(df.select(F.percentile_approx(column, F.array(*map(F.lit, shares)), 10_000)).head()[0] or [])
    row = group_quantiles(df.select(F.lit(0).alias("__all"), F.col(column).alias("__value")), "__all", "__value", shares).head()
    return list(row.q) if row else []


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: n, nulls, mean, sd, min, median, max, zeros, positives, ones (>= .999), near-zeros (<= .001)."""
    measures = {
        "n": lambda c: F.count(c), "nulls": lambda c: F.count_if(c.isNull()), "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max,
        "zeros": lambda c: F.count_if(c == 0), "positives": lambda c: F.count_if(c > 0), "ones": lambda c: F.count_if(c >= 0.999), "near_zeros": lambda c: F.count_if(c <= 0.001),
    }
    one = df.agg(*(f(F.col(c).cast("double")).cast("double").alias(f"{c}__{m}") for c in columns for m, f in measures.items()))
    medians = column_quantiles(df, {c: F.col(c).cast("double") for c in columns}, [0.5])
    order = ["n", "nulls", "mean", "sd", "min", "median", "max", "zeros", "positives", "ones", "near_zeros"]
    at = lambda c, m: F.lit(medians[c][0] if c in medians else None).cast("double") if m == "median" else F.col(f"{c}__{m}")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(at(c, m).alias(m) for m in order)) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def range_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """indicator, outside (values not in [0, 1]) and missing of each column: one pass."""
    one = df.agg(*(f(F.col(c)).alias(f"{c}__{k}") for c in columns for k, f in (("outside", lambda v: F.count_if((v < 0) | (v > 1))), ("missing", lambda v: F.count_if(v.isNull())))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("indicator"), *(F.col(f"{c}__{k}").alias(k) for k in ("outside", "missing"))) for c in columns))).alias("r")).select("r.*")


#: Rows that are sampled to find where the quantiles of larger tables lie.
SAMPLE = 100_000


def column_quantiles(df: DataFrame, values: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles of several columns at once, exactly; a column without a value is left out.

    df is read once. Of a large table a sample tells between which two values a quantile lies; one pass counts what is below
    and between, and only what is between is put in order. Where the counts show that the sample was wrong, it is the column.
    """
    spark, names = df.sparkSession, [f"v{i}" for i in range(len(values))]
    table = written(spark, df.select(*(v.cast("double").alias(n) for n, v in zip(names, values.values(), strict=True))))
    rows = table.count()
    if rows <= 10 * SAMPLE:
        long = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(n).alias("value")) for n, c in zip(names, values, strict=True)))).alias("r")).select("r.*")
        return {r.column: list(r.q) for r in group_quantiles(long, "column", "value", shares).collect()}  # one row a column
    sample = table.sample(fraction=SAMPLE / rows, seed=1).toArrow()  # bounded
    stretches = [(n, j, *_around(np.sort(sample.column(n).drop_null().to_numpy()), share)) for n in names for j, share in enumerate(shares)]
    inside = lambda n, lo, hi: F.col(n).isNotNull() & (F.lit(True) if lo is None else F.col(n) >= lo) & (F.lit(True) if hi is None else F.col(n) <= hi)
    counts = [x for k, (n, _, lo, hi) in enumerate(stretches) for x in (F.count_if(F.lit(False) if lo is None else F.col(n) < lo).alias(f"less{k}"), F.count_if(inside(n, lo, hi)).alias(f"in{k}"))]
    one = table.agg(*(F.count(n).alias(n) for n in names), *counts).head()
    for k, (n, j, lo, hi) in enumerate(stretches):
        at = float(shares[j]) * (one[n] - 1)
        if not one[f"less{k}"] <= math.floor(at) <= math.ceil(at) < one[f"less{k}"] + one[f"in{k}"]:
            stretches[k] = (n, j, None, None)
    picked = F.array(*(F.when(inside(n, lo, hi), F.struct(F.lit(k).alias("k"), F.col(n).alias("v"))) for k, (n, _, lo, hi) in enumerate(stretches)))
    long = table.select(F.explode(F.filter(picked, lambda x: x.isNotNull())).alias("r")).select("r.*")
    others = spark.createDataFrame([(k, 0 if lo is None else one[f"less{k}"], one[n]) for k, (n, _, lo, _) in enumerate(stretches)], "k int, less long, total long")
    found = {r.k: r.q for r in group_quantiles(long, "k", "v", shares, others).collect()}  # one row a column and share
    return {c: [found[k][stretches[k][1]] for k in range(i * len(shares), (i + 1) * len(shares))] for i, (n, c) in enumerate(zip(names, values, strict=True)) if one[n]}


def _around(ordered: np.ndarray, share: float) -> tuple[float | None, float | None]:
    """Two values of a sample that have the quantile of the whole between them, by six standard errors; None: no bound."""
    m = len(ordered)
    error = 6 * math.sqrt(m * share * (1 - share)) + 6
    lo, hi = math.floor(m * share - error), math.ceil(m * share + error)
    lo, hi = (float(ordered[x]) if 0 <= x < m else None for x in (lo, hi))
    return lo, None if hi is not None and math.isnan(hi) else hi


def area_by_cell(overlaps: DataFrame) -> DataFrame:
    """cell_id, state, class, area -> per cell: total and high-class area, greatest class, records, the state with most area, fractions."""
    known = overlaps.filter(F.col("class") >= 0)
    by_state = known.groupBy("cell_id", "state").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("class") >= 4, F.col("area")).otherwise(0.0)).alias("high"), F.max("class").alias("max_class"), F.count("*").alias("n"))
    return by_state.groupBy("cell_id").agg(F.max_by("state", F.struct("area", "state")).alias("state"), F.sum("area").alias("area"), F.sum("high").alias("high_area"), F.max("max_class").alias("max_class"), F.sum("n").alias("n_records"))


def with_fractions(cells: DataFrame, cell_area: float) -> DataFrame:
    share = lambda c: F.least(F.lit(1.0), F.col(c) / F.lit(cell_area))
    return cells.withColumns({"high_fraction": share("high_area"), "coverage": share("area")})


def confusion(df: DataFrame, score: Column, reference: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of two flags, overall or a group."""
    cells = {"tp": score & reference, "fp": score & ~reference, "fn": ~score & reference, "tn": ~score & ~reference}
    counts = df.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in cells.items()))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [0, 1]; 1 falls in the last."""
    inside = df.filter(F.col(value).between(0, 1))
    return inside.groupBy(*by, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def worst_status(df: DataFrame, keys: Sequence[str], status: str, order: Sequence[str] = ("error", "sem_dado", "ok")) -> DataFrame:
    """The worst status of each group; '' for groups with none of the known ones."""
    pick = reduce(lambda c, s: c.when(F.bool_or(F.col(status) == s), F.lit(s)), order[1:], F.when(F.bool_or(F.col(status) == order[0]), F.lit(order[0])))
    return df.groupBy(*keys).agg(pick.otherwise(F.lit("")).alias("status"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def regional_summary(df: DataFrame, by: str, measures: Mapping[str, Column]) -> DataFrame:
    """The measures a region and, in the row whose region is 'all', overall: one pass."""
    return df.rollup(by).agg(F.grouping(by).alias("__all"), *(m.alias(k) for k, m in measures.items())).withColumn(by, F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col(by))).drop("__all")


def status_pivot(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(v) for v in values))


def column_frequency(df: DataFrame, columns: str, most: int = 12) -> DataFrame:
    """The column names that most schemas (bar-separated lists) have."""
    each = df.select(F.explode(F.split(columns, r"\|")).alias("column")).filter("column <> ''")
    return each.groupBy("column").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "column").limit(most)


def class_mapping(existing: DataFrame, seen: DataFrame, defaults: Column) -> DataFrame:
    """All classes seen or known: what is known stays, new ones take their default or -1. existing: class, value; seen: class."""
    both = existing.join(seen.select("class").distinct(), "class", "full")
    return both.select("class", F.coalesce("value", defaults, F.lit(-1)).alias("value"))


def unmapped_classes(df: DataFrame, column: str, ordinal: Column) -> DataFrame:
    """The class texts without an ordinal, and how many rows have each: what is to be added to the mapping."""
    return df.filter(ordinal == -1).groupBy(F.coalesce(F.col(column), F.lit("")).alias("class")).agg(F.count("*").alias("n"))


def archive_coverage(inventory: DataFrame) -> DataFrame:
    """Per archive: layers and classes of each process, and whether it is complete, partial or without data."""
    of = lambda kind: F.col("kind") == kind
    classes = lambda kind: joined_distinct(F.when(of(kind), F.col("class")))
    out = inventory.groupBy("archive").agg(
        F.count_if(of("inundacao")).alias("n_flood"), F.count_if(of("massa")).alias("n_mass"), classes("inundacao").alias("flood_classes"), classes("massa").alias("mass_classes"),
        F.coalesce(F.bool_or(F.col("error")), F.lit(False)).alias("has_error"), F.count_if(of("outros")).alias("n_other"),
    )
    return out.withColumn("status", F.when(F.col("has_error"), "error").when((F.col("n_flood") > 0) & (F.col("n_mass") > 0), "complete").when((F.col("n_flood") > 0) | (F.col("n_mass") > 0), "partial").otherwise("none"))


# Words in a note that tell of an unreadable file.
READ_ERRORS = ["crc", "magic", "bad", "erro", "falha", "error", "decompres"]


def archive_issues(inventory: DataFrame) -> DataFrame:
    """Per archive: which processes it has, layers of no known process, layers without a class column, and errors (bar-separated)."""
    paths = lambda c: joined_distinct(F.when(c, F.col("path")))
    known = F.col("kind") != "outros"
    return inventory.groupBy("archive").agg(
        F.bool_or(F.col("kind") == "inundacao").alias("has_flood"), F.bool_or(F.col("kind") == "massa").alias("has_mass"),
        paths(~known).alias("unclassified"), paths(known & F.col("class_column").isNull()).alias("without_class"), paths(F.col("notes").rlike("(?i)" + "|".join(READ_ERRORS))).alias("errors"),
    )


def place_summary(df: DataFrame, place: str, score: str, columns: Sequence[str]) -> DataFrame:
    """Per place: rows, mean, least and greatest score, and each column's mean beside the overall one."""
    overall = df.agg(*(F.avg(c).alias(f"{c}__all") for c in columns))  # one row
    own = df.groupBy(place).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"), *(F.avg(c).alias(c) for c in columns))
    return own.crossJoin(F.broadcast(overall)).select(place, "n", "mean", "least", "greatest", *(x for c in columns for x in (F.col(c), (F.col(c) - F.col(f"{c}__all")).alias(f"{c}_against_all"))))


def stage_funnel(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """For boolean stage columns (missing: not applicable): ok, failed, not applicable, and how many fewer are ok than a stage before.

    """
    one = df.agg(*(f(F.col(s)).alias(f"{s}__{k}") for s in stages for k, f in (("ok", lambda c: F.count_if(c)), ("failed", lambda c: F.count_if(~c)), ("n_a", lambda c: F.count_if(c.isNull())))))
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), *(F.col(f"{s}__{k}").alias(k) for k in ("ok", "failed", "n_a"))) for i, s in enumerate(stages)))
    long = one.select(F.explode(rows).alias("r")).select("r.*")  # one row a stage
    return long.withColumn("dropout", F.coalesce(F.lag("ok").over(Window.orderBy("step")) - F.col("ok"), F.lit(0)))


def both_or_neither(df: DataFrame, key: str, kind: str, reached: Column) -> DataFrame:
    """One row: how many keys reached the end in every kind there is, and how many in none."""
    kinds = df.agg(F.countDistinct(kind).alias("kinds"))  # one row
    by = df.groupBy(key).agg(F.countDistinct(F.when(reached, F.col(kind))).alias("n")).crossJoin(F.broadcast(kinds))
    return by.agg(F.count_if(F.col("n") == F.col("kinds")).alias("both"), F.count_if(F.col("n") == 0).alias("neither"))


# windows


def share_of_total(df: DataFrame, value: str, by: str, name: str = "weight") -> DataFrame:
    """Each row's share of its group's total; 0 where the total is 0. An aggregate and a join, so that a large group is no single task."""
    totals = df.groupBy(by).agg(F.sum(value).alias("__total"))
    return df.join(totals, by).withColumn(name, safe_ratio(F.col(value), F.col("__total"))).drop("__total")


def percentile_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average rank of each value over n, ties sharing theirs; a missing value has none."""
    return ranked(df, [], value, "__rank", "__total").withColumn(name, F.col("__rank") / F.col("__total")).drop("__rank", "__total")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Sorted values with their cumulative share, 0 for the first and 1 for the last; a value that stands n times has n rows.

    Ranks come from the values' counts: one value that fills most of the column is one count, not one task's rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranked = cumulative(counts, value, "__n").select(value, "before", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("k"))
    return ranked.select(value, ((F.col("before") + F.col("k")) / F.greatest(F.col("total") - 1, F.lit(1))).alias("share"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


# Name patterns of archives, the best first.
ARCHIVE_PATTERNS = [r"(?i)(^sig_|suscet|suscept)", r"(?i)(^bc_)", r"(?i)(arquivos_vetoriais)"]
ARCHIVE_EXCLUDED = r"(?i)(^mde_|^imagens_|ortofoto)"


def pick_archive(df: DataFrame, item: str, name: str, order: str) -> DataFrame:
    """One archive an item: of the names (each once) the best by pattern, then any not excluded, then any; the first listed of equals."""
    c = F.col(name)
    bad = c.rlike(ARCHIVE_EXCLUDED)
    rank = F.when(c.rlike(ARCHIVE_PATTERNS[0]) & ~bad, 0).when(c.rlike(ARCHIVE_PATTERNS[1]), 1).when(c.rlike(ARCHIVE_PATTERNS[2]), 2).when(~bad, 3).otherwise(4)
    return dedup_first(df.filter(F.lower(c).endswith(".zip")).withColumn("__pick", rank), [item], [F.col("__pick"), F.col(order), c]).drop("__pick")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of their key: the same rows however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


# sets


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefer_layers(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Where a key has any layer path (with ::), its plain paths go."""
    has = df.groupBy(*keys).agg(F.bool_or(F.col(path).contains("::")).alias("__layers"))
    return df.join(has, list(keys)).filter(~F.col("__layers") | F.col(path).contains("::")).drop("__layers")


def at_least_group_quantile(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """Rows at or above their group's quantile."""
    cut = group_quantiles(df, by, value, [share]).select(by, F.col("q")[0].alias("__cut"))
    return df.join(cut, by).filter(F.col(value) >= F.col("__cut")).drop("__cut")
