"""Indicators by registry key: which rule applies follows from the fields of an indicator's source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.functions import scalars as S
from gridindex.operators import stats, tables
from gridindex.plans import index
from gridindex.shared import written
from gridindex.sources.registry import Indicator, Registry

INCOME = "v06004"
WEIGHTED = "_ren"  # a variable with this ending is the plain one weighted by income


def variable(name: str, columns: Sequence[str], reference: float) -> Column:
    """A census variable: a column, a count weighted by income (x_ren), or the product of two columns (x_y)."""
    if name in columns:
        return F.col(name)
    if name.endswith(WEIGHTED):
        return S.to_num(F.col(name.removesuffix(WEIGHTED))) * S.income_weight(S.to_num_comma(F.col(INCOME)), reference)
    left, _, right = name.partition("_")
    return S.to_num_comma(F.col(left)) * S.to_num(F.col(right))


def census_indicators(base: DataFrame, tracts: DataFrame, registry: Registry, reference: float, keys: Sequence[str] | None = None) -> DataFrame:
    """indicator, cell_id, abs_value, norm_value for every census indicator (or the keys asked for).

    One join and one aggregate bring all variables to cells, one aggregate takes all quantiles, and the rest is projection.
    """
    chosen = [i for i in registry.indicators if "num_cols" in i.source and (keys is None or i.key in keys)]
    names = sorted({c for i in chosen for c in (*i.source["num_cols"], *i.source["den_cols"])})
    sums = index.census_sums(base, tracts, {n: variable(n, tracts.columns, reference) for n in names})
    add = lambda cols: reduce(lambda a, b: a + b, map(F.col, cols))

    def ratio(i: Indicator) -> Column:
        n, d = add(i.source["num_cols"]), add(i.source["den_cols"])
        value = S.safe_ratio(S.capped_by(n, d) if i.source.get("or_logic") else n, d)
        return S.clip(value, hi=float(i.source["cap_abs"])) if i.source.get("cap_abs") else value

    values = written(base.sparkSession, sums.select("cell_id", *(ratio(i).alias(i.key) for i in chosen)))  # read for the limits and again to be scaled
    scaled = stats.normalize_minmax(values, [i.key for i in chosen], index.WINSOR, "__n")
    norm = lambda i: S.invert(F.col(f"{i.key}__n")) if i.source.get("invert_norm") else F.col(f"{i.key}__n")
    rows = F.array(*(F.struct(F.lit(i.key).alias("indicator"), F.col(i.key).alias("abs_value"), norm(i).alias("norm_value")) for i in chosen))
    return scaled.select("cell_id", F.explode(rows).alias("r")).select("r.indicator", "cell_id", "r.abs_value", "r.norm_value")


def survey_values(survey: DataFrame, source: Mapping, key: str = "cd_mun") -> DataFrame:
    """A municipality's answers as 0/1 (any of several columns) or as a count of yes."""
    cols = [S.yes_no(F.col(c)) for c in source.get("cols", [source.get("col")])]
    return survey.select(key, (S.row_count(*cols) if source.get("type") == "count" else S.row_or(*cols)).alias("value"))


def register_values(lists: Sequence[DataFrame], column: str, key: str = "cod_mun") -> DataFrame:
    """The greatest value of each municipality over several lists with repeated rows."""
    both = tables.union_all([df.select(F.col(key).alias("cd_mun"), S.to_num(F.col(column)).alias("value")) for df in lists])
    return both.groupBy("cd_mun").agg(F.max("value").alias("value"))


def spend_values(ledger: DataFrame, source: Mapping) -> DataFrame:
    """Mean spend a head over the ledger rows of the account asked for; columns coluna, conta, valor, populacao, cod_ibge."""
    rows = ledger.filter(S.ledger_match(F.col("coluna"), source["filter_column"], F.col("conta"), source["filter_account"]))
    plain = rows.select(F.col("cod_ibge").alias("cd_mun"), S.to_num_comma(F.col("valor")).alias("v"), S.to_num_comma(F.col("populacao")).alias("p"))
    return tables.per_capita(plain, "cd_mun", "v", "p").withColumnRenamed("per_capita", "value")


def indicator(spark: SparkSession, registry: Registry, key: str, inputs: Mapping[str, DataFrame | int | float]) -> DataFrame:
    """cell_id, abs_value, norm_value of one indicator.

    inputs by name: base and tracts (census), zonal and grid (exposure), reference (flood), events and found_years (fire),
    cells and facilities (health), cells with cd_mun and survey, lists or ledger (municipal); reference_income, cell_size.
    """
    i = next((x for x in registry.indicators if x.key == key), None)
    if i is None:
        raise KeyError(key)
    s = i.source
    if "num_cols" in s:
        return census_indicators(inputs["base"], inputs["tracts"], registry, float(inputs.get("reference_income", 1212)), [key]).drop("indicator")
    if "k_nearest" in s:
        return index.health_indicator(inputs["cells"], inputs["facilities"], bool(s.get("use_rank_percentile")))
    if "k_ring" in s:
        return index.fire_indicator(inputs["events"], inputs["base"], float(inputs["cell_size"]), int(inputs["found_years"]), s["year_end"] - s["year_start"] + 1, s["min_years"], s["k_ring"])
    if "sgb_coverage_min" in s:
        return index.flood_indicator(inputs["zonal"], inputs["reference"], inputs["grid"])
    if "filter_account" in s:
        return index.municipal_indicator(inputs["cells"], spend_values(inputs["ledger"], s), "cd_mun", "value", "cells", log=True)
    if s.get("type") in ("binary", "count"):
        values = register_values(inputs["lists"], s["col"]) if "lists" in inputs else survey_values(inputs["survey"], s)
        return index.municipal_indicator(inputs["cells"], values, "cd_mun", "value", "municipalities" if s["type"] == "count" else None)
    if s.get("coastal"):
        return index.sea_indicator(inputs["zonal"], inputs["grid"])
    if s.get("anomaly"):
        return index.exposure_indicator(inputs["zonal"], s["value"], inputs["grid"], fill=None, floor=0.0, winsorize=index.WINSOR)
    return index.exposure_indicator(inputs["zonal"], s["value"], inputs["grid"])


def save_indicators(long: DataFrame, path: str) -> None:
    """One partition an indicator; a later run replaces only the indicators it has."""
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("indicator").parquet(path)


def reviewable(inventory: DataFrame, kinds: Sequence[str] = ("inundacao", "massa")) -> DataFrame:
    """Inventory rows that can be read and name a known process."""
    return inventory.filter(~F.coalesce(F.col("error"), F.lit(False)) & F.col("kind").isin(*kinds))


def extremes(df: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """The n greatest and n least rows, ties by key."""
    top = df.orderBy(F.desc(score), key).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(df.filter(F.col(score).isNotNull()).orderBy(score, key).limit(n).withColumn("end", F.lit("bottom")))
