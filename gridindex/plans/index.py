"""From inputs to indicators, dimension scores and the final index."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions import scalars as S
from gridindex.operators import stats, tables
from gridindex.operators.spatial import gravity, recurrent_exposure
from gridindex.shared import written
from gridindex.sources.readers import missing_inputs, read_table
from gridindex.sources.registry import Registry
from gridindex.sources.sinks import save_candidates, save_dimension_slices, save_run, save_slim

WINSOR = (0.01, 0.99)
#: What a mean of equal scores may be above them.
ROUNDING = 1e-12


def dasymetric_base(pairs: DataFrame, households: DataFrame) -> DataFrame:
    """(cell, tract) pairs with the cell's households and their share of the tract's; inhabited cells only."""
    joined = pairs.join(households, "cell_id")
    return tables.share_of_total(joined, "households", "tract_id").filter("households > 0")


def census_sums(base: DataFrame, tracts: DataFrame, variables: Mapping[str, Column]) -> DataFrame:
    """Variables of tracts, brought to cells by weight: all in one join and one aggregate."""
    derived = tracts.select("tract_id", *(v.alias(k) for k, v in variables.items()))
    return tables.weighted_sums(base.join(derived, "tract_id"), "cell_id", "weight", list(variables))


def ratio_indicator(sums: DataFrame, numerators: Sequence[str], denominators: Sequence[str], overlapping: bool = False, cap: float | None = None, inverted: bool = False, winsorize: tuple[float, float] | None = WINSOR) -> DataFrame:
    """cell_id, abs_value, norm_value of summed counts: capped where counts overlap, inverted after scaling."""
    add = lambda names: reduce(lambda a, b: a + b, map(F.col, names))
    n, d = add(numerators), add(denominators)
    value = S.safe_ratio(S.capped_by(n, d) if overlapping else n, d)
    value = value if cap is None else S.clip(value, hi=cap)
    values = written(sums.sparkSession, sums.select("cell_id", value.alias("abs_value")))  # read for the limits and again to be scaled
    scaled = stats.normalize_minmax(values, ["abs_value"], winsorize, "_n")
    norm = F.col("abs_value_n")
    return scaled.select("cell_id", "abs_value", (S.invert(norm) if inverted else norm).alias("norm_value"))


def exposure_indicator(zonal: DataFrame, value: str, grid: DataFrame, fill: float | None = 0.0, floor: float | None = None, winsorize: tuple[float, float] | None = None) -> DataFrame:
    """A zonal value, one row a cell, scaled over the zonal rows and then brought onto the grid; cells without one stay missing."""
    v = S.to_num(F.col(value))
    v = v if fill is None else F.coalesce(v, F.lit(fill))
    v = v if floor is None else S.clip(v, lo=floor)
    one = tables.dedup_first(zonal.select("cell_id", v.alias("abs_value")), ["cell_id"], [F.col("abs_value").desc_nulls_last()])
    scaled = stats.normalize_minmax(one, ["abs_value"], winsorize, "_n").withColumnRenamed("abs_value_n", "norm_value")
    return tables.onto_grid(grid.select("cell_id").distinct(), scaled)


def flood_indicator(zonal: DataFrame, reference: DataFrame, grid: DataFrame) -> DataFrame:
    """Flood scores, set to 1 (and flagged) where the reference map says so."""
    one = tables.dedup_first(zonal.select("cell_id", "flood_score"), ["cell_id"], [F.col("flood_score").desc_nulls_last()])
    joined = one.join(reference.select("cell_id", "high_fraction", "coverage"), "cell_id", "left")
    score, flag = S.override(F.coalesce(S.to_num(F.col("flood_score")), F.lit(0.0)), F.col("high_fraction"), F.col("coverage"))
    scaled = stats.normalize_minmax(joined.select("cell_id", score.alias("abs_value"), flag.alias("overridden")), ["abs_value"], None, "_n").withColumnRenamed("abs_value_n", "norm_value")
    return tables.onto_grid(grid.select("cell_id").distinct(), scaled)


def sea_indicator(zonal: DataFrame, grid: DataFrame) -> DataFrame:
    """Only coastal cells have a value; inland stays missing, not zero."""
    masked = zonal.select("cell_id", S.inhabited(F.col("households"), S.to_num(F.col("risk"))).alias("risk"))
    return exposure_indicator(masked, "risk", grid, fill=None)


def fire_indicator(events: DataFrame, base: DataFrame, size: float, found_years: int, configured_years: int, min_years: int, k: int = 3) -> DataFrame:
    """Share of the found years with a fire within k steps; the floor is set by the configured years."""
    years = recurrent_exposure(events, base, size, k)
    share = F.coalesce(F.col("n_years"), F.lit(0)) / F.lit(found_years)
    cells = base.select("cell_id").distinct().join(years, "cell_id", "left").select("cell_id", S.recurrence_floor(share, min_years, configured_years).alias("abs_value"))
    return stats.normalize_minmax(cells, ["abs_value"], WINSOR, "_n").withColumnRenamed("abs_value_n", "norm_value")


def health_indicator(cells: DataFrame, facilities: DataFrame, by_rank: bool = False) -> DataFrame:
    """Inaccessibility: one less the scaled gravity of the nearest facilities. cells: target_id, x, y; facilities: point_id, x, y, capacity."""
    scored = gravity(cells, facilities)
    if by_rank:
        return tables.percentile_rank(scored, "score", "r").select(F.col("target_id").alias("cell_id"), F.col("score").alias("abs_value"), S.invert(F.col("r")).alias("norm_value"))
    scaled = stats.normalize_minmax(written(cells.sparkSession, scored), ["score"], (0.03, 0.97), "_n")  # read for the limits and again to be scaled
    return scaled.select(F.col("target_id").alias("cell_id"), F.col("score").alias("abs_value"), S.invert(F.col("score_n")).alias("norm_value"))


def municipal_indicator(cells: DataFrame, values: DataFrame, key: str, value: str, scale_over: str | None = None, log: bool = False) -> DataFrame:
    """A municipality's value for each of its cells. scale_over: None, 'cells' (weighted by them) or 'municipalities'."""
    if scale_over == "municipalities":
        values = stats.normalize_minmax(values, [value], WINSOR, "_n")
    joined = tables.enrich(cells, values, key)
    if scale_over == "cells":
        filled = F.coalesce(F.col(value), F.lit(0.0))
        joined = stats.normalize_minmax(joined.withColumn(value, F.log1p(filled) if log else filled), [value], WINSOR, "_n")
    norm = f"{value}_n" if scale_over else value
    return joined.select("cell_id", F.col(value).alias("abs_value"), F.col(norm).alias("norm_value"))


def dimension_scores(df: DataFrame, registry: Registry, suffix: str = "norm") -> DataFrame:
    """One column a dimension (the mean of what indicators there are, inverted where it says so) and final_index, their mean.

    A dimension without any column is left out.
    """
    out: dict[str, Column] = {}
    for d in registry.dimensions:
        have = [F.col(c) for i in d.indicators for c in (i.normalised if suffix == "norm" else i.key,) if c in df.columns]
        if have:
            mean = S.row_mean(*have)
            out[d.column] = S.invert(mean) if d.inverted else mean
    if not out:
        raise ValueError("no indicator columns")
    scored = df.withColumns(out)
    return scored.withColumn("final_index", S.row_mean(*(F.col(c) for c in out)))


def validation(df: DataFrame, score: str, reference: str, coverage: str, used: str, threshold: float, region: str, least_coverage: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sweep, regional confusion, false negatives a region) over well-covered rows whose score did not use the reference."""
    rows = df.filter((F.col(coverage) >= least_coverage) & ~F.coalesce(F.col(used), F.lit(False)))
    sweep = stats.threshold_sweep(rows, score, reference, [i / 20 for i in range(21)])
    regional = tables.confusion(rows.filter(F.col(score).isNotNull()), F.col(score) > threshold, F.col(reference), [region])
    return sweep, regional, false_negatives(rows, score, reference, threshold, region)


def false_negatives(rows: DataFrame, score: str, reference: str, threshold: float, region: str) -> DataFrame:
    """Per region and overall ('all'): misses, their mean score, the share scoring 0, and misses by positives."""
    positive = F.col(reference)
    missed = positive & ~(F.col(score) > threshold)
    return tables.regional_summary(
        rows.filter(F.col(score).isNotNull()), region,
        {"n": F.count_if(missed), "mean_score": F.avg(F.when(missed, F.col(score))), "zero_share": F.avg(F.when(missed, (F.col(score) == 0).cast("int"))), "rate": F.try_divide(F.count_if(missed), F.count_if(positive))},
    )


def candidates(df: DataFrame, most: int = 50, share: float = 0.5) -> DataFrame:
    """Per cluster: municipalities at or above its quantile; first the best of each region and size class (all of them), then by score up to so many.

    df: id, cluster, region, size_class, score. One without region or size class can only fill up.
    """
    pool = tables.at_least_group_quantile(df, "cluster", "score", share)
    row = F.struct(*pool.columns)
    first = pool.filter("region IS NOT NULL AND size_class IS NOT NULL").groupBy("cluster", "region", "size_class").agg(F.min_by(row, F.struct(-F.col("score"), F.col("id"))).alias("row")).select("row.*").withColumn("pass", F.lit(1))
    rest = tables.not_in(pool, first, "id").withColumn("pass", F.lit(2))
    # what may fill a cluster is among the best of each of its parts: no cluster is one task's
    parts = F.pmod(F.xxhash64("id"), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    few = tables.top_per_group(rest.withColumn("__part", parts), ["cluster", "__part"], [F.desc("score"), F.col("id")], most).drop("__part", "rank")
    order = [F.col("pass"), F.when(F.col("pass") == 1, F.col("region")), F.when(F.col("pass") == 1, F.col("size_class")), F.desc("score"), F.col("id")]
    ranked = tables.top_per_group(first.unionByName(few), ["cluster"], order, 2**31 - 1, "candidate_rank")
    return ranked.filter((F.col("pass") == 1) | (F.col("candidate_rank") <= most))


def cluster_profiles(df: DataFrame, dimensions: Sequence[str], texts: Mapping[str, tuple[str, str]], marked: Sequence[str] = ()) -> DataFrame:
    """Per cluster: size, mean, sd and z-score of each dimension, and a label of the most marked ones (of all, or of those named)."""
    overall = df.agg(*(f(d).alias(f"{d}__{k}") for d in dimensions for k, f in (("mu", F.avg), ("sd", F.stddev_samp))))
    own = df.groupBy("cluster").agg(F.count("*").alias("n"), *(f(d).alias(f"{d}_{k}") for d in dimensions for k, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    joined = own.crossJoin(F.broadcast(overall))  # one row
    z = {d: S.z_score(F.col(f"{d}_mean"), F.col(f"{d}__mu"), F.col(f"{d}__sd")) for d in dimensions}
    label = S.profile_label({d: (z[d], *texts[d]) for d in marked or dimensions})
    return joined.select("cluster", "n", *(F.col(f"{d}_{k}") for d in dimensions for k in ("mean", "sd")), *(z[d].alias(f"{d}_z") for d in dimensions), label.alias("label"))


def cluster_run(cells: DataFrame, lookup: DataFrame, dimensions: Mapping[str, tuple[str, str]], score: str, key: str, weight: str, root: str, k: int = 4, starts: int = 20, iterations: int = 100, most: int = 50, share: float = 0.5) -> DataFrame:
    """From cells to candidates: municipal means weighted by households, clusters of those with all dimensions, profiles, and
    each cluster's candidates. Written under root: profiles and candidates (by cluster). Returns the municipalities, each with
    its cluster, region, size_class (missing where the lookup lacks it) and candidate_rank (missing where it is none).

    dimensions: name -> (text when high, text when low); lookup: key, region, size_class, a row a municipality.
    """
    munis = tables.weighted_mean(cells, [key], weight, [score, *dimensions])
    found = written(cells.sparkSession, tables.enrich(stats.kmeans(munis, list(dimensions), score, key, k, starts=starts, iterations=iterations), lookup.select(key, "region", "size_class"), key))
    profiles = cluster_profiles(found, [score, *dimensions], {score: ("", ""), **dimensions}, marked=list(dimensions))
    chosen = candidates(found.select(F.col(key).alias("id"), "cluster", "region", "size_class", F.col(score).alias("score")), most, share)
    save_candidates(profiles, chosen, root)
    ranks = read_table(cells.sparkSession, f"{root}/candidates").select(F.col("id").alias(key), "candidate_rank")
    return found.join(ranks, key, "left")


def calibration(df: DataFrame, score: str, secondary: str, reference: str, coverage: str, used: str, region: str, current: float = 0.0, secondary_thresholds: Sequence[float] = ()) -> DataFrame:
    """kind, subject, amount: what a validation suggests (stats.recommendations), at the best threshold of the score, and
    whether a secondary predictor (missing as 0) does better by more than .02."""
    rows = df.filter((F.col(coverage) >= 0.5) & ~F.coalesce(F.col(used), F.lit(False)))
    sweep = stats.threshold_sweep(rows, score, reference, [i / 20 for i in range(21)])
    best = stats.best_threshold(sweep).select("threshold", "f1").head()  # one row
    at = F.col(score) > (best.threshold if best else 0.0)
    regional = tables.confusion(rows.filter(F.col(score).isNotNull()), at, F.col(reference), [region]).withColumnRenamed(region, "region")
    misses = false_negatives(rows, score, reference, best.threshold if best else 0.0, region).withColumnRenamed(region, "region").filter("region <> 'all'")
    out = stats.recommendations(sweep, regional, current, misses)
    other = stats.threshold_sweep(rows.withColumn(secondary, F.coalesce(secondary, F.lit(0.0))), secondary, reference, secondary_thresholds or [1 + i / 4 for i in range(17)])
    better = stats.best_threshold(other).select(F.lit("secondary predictor").alias("kind"), F.col("threshold").cast("string").alias("subject"), (F.col("f1") - F.lit(best.f1 if best else 0.0)).alias("amount"))
    return out.unionByName(better.filter("amount > 0.02"))


# A stage's states.
OK, FAILED, NOT_PROCESSED, NOT_APPLICABLE, WITHOUT_DATA = "ok", "failed", "not_processed", "n_a", "sem_dado"


def pipeline_status(manifest: DataFrame, coverage: DataFrame, extracted: DataFrame, extract_failures: DataFrame, harmonised: DataFrame, harmonise_failures: DataFrame) -> DataFrame:
    """Per municipality and process: how the download went and how far its layers came, with the last failure.

    manifest: cd_mun, tipo, status (of several the worst counts); coverage: cd_mun, tipo, has_tipo, status_zip;
    extracted, harmonised: cd_mun, tipo; failures: cd_mun, tipo, reason, timestamp (the last counts). A stage is not
    applicable where its layer does not exist, and not processed where the stage before was not ok.
    """
    keys = ["cd_mun", "tipo"]
    last = lambda df, name: tables.dedup_last(df, keys, ["timestamp"], ["reason"]).withColumnRenamed("reason", name)
    done = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = tables.worst_status(manifest, keys, "status").withColumnRenamed("status", "download")
    seen = coverage.groupBy(*keys).agg(F.bool_or("has_tipo").alias("has_tipo"), F.when(F.bool_or(F.col("status_zip") == OK), OK).otherwise(F.max("status_zip")).alias("status_zip"))
    for df in (seen, done(extracted, "__extracted"), last(extract_failures, "__extract_reason"), done(harmonised, "__harmonised"), last(harmonise_failures, "__harmonise_reason")):
        out = out.join(df, keys, "left")
    zip_ok = F.col("status_zip") == OK
    explore = F.when(F.col("status_zip").isNull(), F.when(F.col("download") == WITHOUT_DATA, NOT_APPLICABLE).otherwise(NOT_PROCESSED)).when(zip_ok & F.coalesce("has_tipo", F.lit(False)), OK).when(zip_ok, NOT_APPLICABLE).otherwise(FAILED)

    def stage(before: str, reached: str, reason: str) -> Column:
        held = F.when(F.col(before) == NOT_APPLICABLE, NOT_APPLICABLE).otherwise(NOT_PROCESSED)
        return F.when(F.col(before) != OK, held).when(F.coalesce(reached, F.lit(False)), OK).when(F.col(reason).isNotNull(), FAILED).otherwise(NOT_PROCESSED)

    out = out.withColumn("explore", explore).withColumn("extract", stage("explore", "__extracted", "__extract_reason")).withColumn("harmonise", stage("extract", "__harmonised", "__harmonise_reason"))
    failed = [("harmonise", F.col("__harmonise_reason")), ("extract", F.col("__extract_reason")), ("explore", F.lit("unreadable or not covered")), ("download", F.lit("download failed"))]
    state = lambda s: F.col(s).isin(FAILED, "error") if s == "download" else F.col(s) == FAILED
    pick = lambda k: reduce(lambda c, f: c.when(state(f[0]), f[k] if k else F.lit(f[0])), failed[1:], F.when(state(failed[0][0]), failed[0][k] if k else F.lit(failed[0][0]))).otherwise(F.lit(""))
    return out.select(*keys, "download", "explore", "extract", "harmonise", (F.col("harmonise") == OK).alias("in_pipeline"), pick(0).alias("last_failure_stage"), pick(1).alias("last_failure_reason"))


def status_summary(status: DataFrame) -> DataFrame:
    """tipo, stage, ok, failed, n_a and dropout (how many fewer are ok than at the stage before) of pipeline_status()."""
    stages = ("download", "explore", "extract", "harmonise")
    rows = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(s).alias("stage"), F.when(F.col(s) == "error", FAILED).otherwise(F.col(s)).alias("state")) for k, s in enumerate(stages)))
    counts = status.select("tipo", F.explode(rows).alias("r")).select("tipo", "r.*").groupBy("tipo", "step", "stage").agg(*(F.count_if(F.col("state") == s).alias(s) for s in (OK, FAILED, NOT_APPLICABLE)))
    before = F.lag(OK).over(Window.partitionBy("tipo").orderBy("step"))  # four rows a process
    return counts.withColumn("dropout", F.coalesce(before - F.col(OK), F.lit(0))).drop("step")


def coastal_only(cells: DataFrame, coastal: DataFrame, key: str) -> DataFrame:
    """Cells of the municipalities on the coastal list: the others' sea-level indicator does not apply."""
    return tables.only_in(cells, coastal, key)


def quality_metrics(columns: Sequence[str], dimensions: Sequence[str]) -> list[Column]:
    """What a write observes of each column, and how the dimensions vary together over rows that have all of them."""
    out = [F.count("*").alias("rows")]
    for c in columns:
        v = F.col(c).cast("double")
        measures = {"n": F.count(v), "positive": F.count_if(v > 0), "outside": F.count_if((v < 0) | (v > 1)), "binary": F.count_if(v.isin(0.0, 1.0)), "min": F.min(v), "max": F.max(v), "mean": F.avg(v)}
        out += [m.alias(f"{c}__{k}") for k, m in measures.items()]
    whole = reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in dimensions))
    both = lambda c: F.when(whole, F.col(c))
    out += [F.covar_samp(both(a), both(b)).alias(f"{a}__with__{b}") for i, a in enumerate(dimensions) for b in dimensions[i:]]
    return out


def quality_table(spark: SparkSession, seen: Mapping[str, float], indicators: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """name, kind, n, missing, positive, percent_nonzero, outside, low, high, mean, weight, status, equalised_r: a row a column of a run.

    status: of indicators, the ladder (a 99th percentile of 0 shows in the counts: so many values are not above 0), or BINARY;
    RANGE where a value is outside [0, 1]. weight: of dimensions, by inverse spread; equalised_r: of final_index, its
    correlation with the mean by those weights, from the dimensions' covariances.
    """
    spread = {d: math.sqrt(v) for d in dimensions if (v := seen.get(f"{d}__with__{d}"))}
    inverse = {d: 1 / v for d, v in spread.items()}
    weight = {d: v / sum(inverse.values()) for d, v in inverse.items()}
    covariance = lambda a, b: seen.get(f"{a}__with__{b}", seen.get(f"{b}__with__{a}")) or 0.0
    among = lambda p, q: sum(p.get(a, 0.0) * q.get(b, 0.0) * covariance(a, b) for a in dimensions for b in dimensions)
    plain = {d: 1 / len(dimensions) for d in dimensions}
    size = math.sqrt(among(plain, plain) * among(weight, weight))
    rows = []
    for name in (*indicators, *dimensions, "final_index"):
        n, positive, outside, binary = (seen[f"{name}__{k}"] for k in ("n", "positive", "outside", "binary"))
        kind = "indicator" if name in indicators else "dimension" if name in dimensions else "index"
        share = 100.0 * positive / n if n else 0.0
        status = None
        if kind == "indicator" and n:
            zero = n - positive > math.ceil(0.99 * (n - 1))  # the 99th percentile is
            status = "BINARY" if binary == n else "ZERO" if zero else "SOME"
        r = among(plain, weight) / size if kind == "index" and size else None
        rows.append((name, kind, n, seen["rows"] - n, positive, share, outside, seen[f"{name}__min"], seen[f"{name}__max"], seen[f"{name}__mean"], weight.get(name) if kind == "dimension" else None, "RANGE" if outside else status, r))
    out = spark.createDataFrame(rows, "name string, kind string, n long, missing long, positive long, percent_nonzero double, outside long, low double, high double, mean double, weight double, status string, equalised_r double")
    ladder = S.quality_status(F.when(F.col("status") == "ZERO", 0.0).otherwise(1.0), F.col("percent_nonzero"))
    return out.withColumn("status", F.when(F.col("status").isin("ZERO", "SOME"), ladder).otherwise(F.col("status")))


def report_tables(cells: DataFrame, bounds: DataFrame, levels: Sequence[Sequence[str]], score: str, size_class: str, means: Sequence[str]) -> DataFrame:
    """All tables of a report in one aggregate: level (its columns joined by +, 'all' for none), the columns of all levels,
    class, n, mean, least, greatest of the score, and the means of other columns, for each level and, as a last level, for each
    size class and class of the score by its own bounds (group_quintiles).
    """
    names = list(dict.fromkeys(c for level in levels for c in level))
    classed = stats.classify(cells, size_class, score, bounds).withColumn("class", F.when(F.col(score).isNotNull(), F.col("class")))
    keys = list(dict.fromkeys([*names, size_class, "class"]))
    sets = [[F.col(c) for c in level] for level in (*levels, (size_class, "class"))]
    measures = [F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"), *(F.avg(c).alias(f"{c}_mean") for c in means)]
    out = classed.groupingSets(sets, *keys).agg(*measures, *(F.grouping(c).alias(f"__{c}") for c in keys))
    level = F.concat_ws("+", *(F.when(F.col(f"__{c}") == 0, F.lit(c)) for c in keys))
    return out.select(F.when(level == "", "all").otherwise(level).alias("level"), *keys, "n", "mean", "least", "greatest", *(f"{c}_mean" for c in means))


def report(cells: DataFrame, levels: Sequence[Sequence[str]], score: str, size_class: str, means: Sequence[str], key: str = "cell_id", order: Sequence[str] = ()) -> DataFrame:
    """report_tables over one row a cell, with the percentage of all cells that score below each row's mean (by more than rounding)."""
    one = tables.dedup_first(cells, [key], [F.col(c) for c in order or sorted(cells.columns)])
    out = written(cells.sparkSession, report_tables(one, stats.group_quintiles(one, size_class, score), levels, score, size_class, means).withColumn("__row", F.monotonically_increasing_id()))
    limits = out.filter("mean IS NOT NULL").select("__row", (F.col("mean") - ROUNDING).alias("__below"))
    return out.join(stats.percent_below(one, score, limits, "__row", "__below").select("__row", F.col("percent").alias("percent_below")), "__row", "left").drop("__row")


def run_index(spark: SparkSession, registry: Registry, inputs: str, base: DataFrame, out: str, run_id: str, key: str = "cell_id", ids: Sequence[str] = (), order: Sequence[Column] = ()) -> tuple[str, list[str]]:
    """The whole index: reads the base and every indicator file that is there, scores, writes. Returns the run's path and the missing indicators.

    The base gives one row a cell (the first by order) with its id columns. Indicators without a file, or whose file lacks
    their column, are left out, and a dimension without any is too. Written under out: the full run (never overwritten),
    the slim extract, the dimensions' slices, and the quality table, whose figures are taken while the run is written.
    """
    missing = missing_inputs(spark, registry, inputs)
    read = [(i, read_table(spark, f"{inputs}/{registry.file_name(i)}")) for i in registry.indicators if i.key not in missing]
    found = {i.normalised: df.select(key, F.col(i.normalised).alias("value")) for i, df in read if {key, i.normalised} <= set(df.columns)}
    missing += [i.key for i, _ in read if i.normalised not in found]
    if not found:
        raise ValueError("no indicator has a file")
    cells = tables.dedup_first(base.select(key, *ids), [key], [*order, *map(F.col, ids)] or [F.col(key)])
    scored = dimension_scores(tables.merge_indicators(cells, found, key), registry)
    dimensions = [d.column for d in registry.dimensions if d.column in scored.columns]
    seen = Observation("quality")
    path = save_run(scored.observe(seen, *quality_metrics([*found, *dimensions, "final_index"], dimensions)), out, run_id)
    quality = quality_table(spark, seen.get, list(found), dimensions)
    quality.write.mode("errorifexists").parquet(f"{out}/quality_{run_id}")
    saved = spark.read.parquet(path)
    scores = [*dimensions, "final_index"]
    save_slim(saved, f"{out}/dashboard_{run_id}", [key, *ids], scores)
    save_dimension_slices(saved, registry, f"{out}/slices_{run_id}", [key])
    return path, missing
