"""Scalar rules as column expressions. Missing is NULL everywhere: it means "does not apply" and is never filled unasked."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of each macro-region.
MACRO_REGIONS = {
    "N": ["AC", "AM", "AP", "PA", "RO", "RR", "TO"],
    "NE": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "CO": ["DF", "GO", "MS", "MT"],
    "SE": ["ES", "MG", "RJ", "SP"],
    "S": ["PR", "RS", "SC"],
}

# Words in layer names and paths, and columns that may hold the class, in order of preference.
KIND_WORDS = {
    "inundacao": ["inundac", "inund", "inuda", "enxurr"],
    "massa": ["massa", "movimento", "desliz", "escorrega", "queda", "corrida", "fluxo"],
}
NOT_SUSCEPTIBILITY = ["massadagua", "hidmassa", "hidrografia", "corposdagua"]
CLASS_COLUMNS = ["CLASSE", "CLASSE_SU", "CLASS", "CLASSIFIC", "SUSCET", "SUSCETIBIL"]
CLASS_ORDINALS = {
    "Muito Alta": 5, "MUITO ALTA": 5, "Muito alta": 5, "Alta": 4, "ALTA": 4, "alta": 4, "Média": 3, "Media": 3, "MEDIA": 3, "média": 3, "M?dia": 3,
    "Moderada": 3, "MODERADA": 3, "moderada": 3, "Baixa": 2, "BAIXA": 2, "baixa": 2, "Muito Baixa": 1, "MUITO BAIXA": 1, "Muito baixa": 1,
    "Sem Suscetibilidade": 0, "Sem suscetibilidade": 0, "Sem suscet": 0, "Área Urbana": 0, "Area Urbana": 0, "area urbana": 0, "Sem Dado": 0, "sem dado": 0,
}
# Words in a layer's name from which a class is taken where it has no class column.
CLASS_WORDS = ["massa", "suscet", "movimento", "desliz", "escorrega", "queda", "fluxo", "enxurr", "inunda"]

_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_num(c: Column) -> Column:
    """A number, or NULL for anything that is none."""
    return null_if_nan(c.try_cast("double"))


def to_num_comma(c: Column) -> Column:
    """A number written with a decimal comma."""
    return to_num(F.regexp_replace(c.cast("string"), ",", "."))


def standard_name(name: str) -> str:
    """A column name in lower case, without Portuguese accents or blanks."""
    return name.strip().lower().translate(str.maketrans("çãéõ", "caeo")).replace(" ", "_")


def standard_names(df: DataFrame) -> DataFrame:
    return df.toDF(*map(standard_name, df.columns))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; 0 where that is no number."""
    return F.coalesce(null_if_nan(F.try_divide(n.cast("double"), d.cast("double"))), F.lit(0.0))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c if lo is None else F.greatest(c, F.lit(lo))
    out = out if hi is None else F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def canon_code(c: Column, width: int = 7) -> Column:
    """A code read as text, whole number or decimal, as digits padded to the width."""
    return F.lpad(F.trim(c.cast("string")).try_cast("double").try_cast("bigint").cast("string"), width, "0")


def income_weight(income: Column, reference: float) -> Column:
    """min(1, reference / income); 1 where income is missing or not positive."""
    return F.when(income > 0, F.least(F.lit(1.0), F.try_divide(F.lit(float(reference)), income))).otherwise(F.lit(1.0))


def capped_by(n: Column, d: Column) -> Column:
    """Counts that may overlap cannot exceed their base."""
    return F.when(n.isNotNull() & d.isNotNull(), F.least(n, d))


def yes_no(c: Column) -> Column:
    return F.when(c == "Sim", 1).when(c == "Não", 0)


def row_or(*cols: Column) -> Column:
    """The greatest, missing skipped."""
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_count(*cols: Column) -> Column:
    """The sum, missing skipped; missing where all are."""
    return F.when(F.coalesce(*cols).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in cols)))


def row_mean(*cols: Column) -> Column:
    """The mean, missing skipped; missing where all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols))
    return F.try_divide(total, reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cols)))


def invert(c: Column) -> Column:
    return F.lit(1.0) - c


def override(score: Column, fraction: Column, coverage: Column, over: float = 0.3, covered: float = 0.5) -> tuple[Column, Column]:
    """(score, flag): where enough of a well-covered cell is in high classes the score is 1."""
    flag = F.coalesce((fraction > over) & (coverage >= covered), F.lit(False))
    return F.when(flag, F.lit(1.0)).otherwise(score), flag


def inhabited(households: Column, value: Column) -> Column:
    return F.when(households > 0, value).otherwise(F.lit(0.0))


def recurrence_floor(fraction: Column, min_years: int, n_years: int) -> Column:
    """Fractions of fewer than min_years of n_years count as 0."""
    return F.when(fraction >= F.lit(min_years / n_years), fraction).otherwise(F.lit(0.0))


def fold_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def _map(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in pairs.items() for x in (k, v)))


def class_ordinal(c: Column, mapping: Mapping[str, int] = CLASS_ORDINALS) -> Column:
    """The ordinal of a class's text, as it is spelt; -1 where it has none."""
    return F.coalesce(F.try_element_at(_map(mapping), c), F.lit(-1))


def raster_class(text: Column, pixel: Column, mapping: Mapping[str, int] = CLASS_ORDINALS) -> Column:
    """The text's ordinal, else the pixel's value where that is a class (0 to 5), else -1."""
    return F.coalesce(F.try_element_at(_map(mapping), text), F.when(pixel.between(0, 5), pixel), F.lit(-1))


def infer_class(layer: Column) -> Column:
    """A class from a layer's name alone: debris flow 5, other named processes 4, else missing."""
    name = F.replace(F.lower(layer), F.lit("_"), F.lit(""))
    return F.when(name.contains("corrida"), 5).when(name.rlike("|".join(CLASS_WORDS)), 4)


def classify_kind(path: Column) -> Column:
    """The process that a layer's path names: the innermost part that names one decides; water bodies name none."""
    lower = F.lower(path)
    parts = F.filter(F.reverse(F.split(lower, "/")), lambda p: p.rlike("|".join(w for ws in KIND_WORDS.values() for w in ws)))
    first = F.try_element_at(parts, F.lit(1))
    of = reduce(lambda c, k: c.when(first.rlike("|".join(KIND_WORDS[k])), F.lit(k)), KIND_WORDS, F.when(F.replace(lower, F.lit("_"), F.lit("")).rlike("|".join(NOT_SUSCEPTIBILITY)), F.lit("outros")))
    return of.otherwise(F.lit("outros"))


def class_column(columns: Sequence[str]) -> str | None:
    """The first of the known class columns that is there, in any case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in CLASS_COLUMNS if c.lower() in have), None)


def first_existing(df: DataFrame, *names: str) -> Column:
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(""))


def macro_region(state: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({s: r for r, states in MACRO_REGIONS.items() for s in states}), state), F.lit("?"))


def with_precedence(official: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(official, F.lit("")), other)


def municipality_of_stem(stem: Column) -> Column:
    """A file stem without its last _kind."""
    return F.regexp_extract(stem, r"^(.*)_[^_]*$", 1)


def terrain_score(height: Column, hazard: Column) -> Column:
    """Height above drainage in steps, where there is a hazard; heights of 0 and below are masked."""
    steps = F.when(height <= 0, F.lit(None).cast("double")).when(height < 2, 1.0).when(height < 4, 0.66).when(height < 6, 0.33).otherwise(0.0)
    return F.when(height.isNotNull(), steps * F.coalesce(hazard, F.lit(False)).cast("int"))


def clear_pixel(qa: Column) -> Column:
    """Neither cloud nor cloud shadow (bits 3 and 4)."""
    return F.coalesce((F.getbit(qa, F.lit(3)) == 0) & (F.getbit(qa, F.lit(4)) == 0), F.lit(False))


def surface_celsius(dn: Column) -> Column:
    return dn * 0.00341802 + 149.0 - 273.15


def coastal_low(elevation: Column, sea_distance: Column, reach: float = 10_000.0) -> Column:
    """Land at 0 to 1 m within reach of the sea."""
    return F.coalesce(elevation.between(0, 1) & (sea_distance <= reach), F.lit(False))


def z_score(mean: Column, overall: Column, sd: Column) -> Column:
    return (mean - overall) / F.greatest(sd, F.lit(1e-9))


def profile_label(scores: Mapping[str, tuple[Column, str, str]], least: float = 0.5, most: int = 3) -> Column:
    """{name: (z, text when high, text when low)} -> the texts of the most marked dimensions, joined."""
    every = F.array(*(F.struct((-F.abs(z)).alias("size"), F.when(z > 0, high).otherwise(low).alias("text")) for z, high, low in scores.values()))
    marked = F.slice(F.array_sort(F.filter(every, lambda x: -x["size"] >= least)), 1, most)
    return F.when(F.size(marked) > 0, F.array_join(F.transform(marked, lambda x: x["text"]), "; ")).otherwise(F.lit("near the mean in all dimensions"))


def score_band(c: Column) -> Column:
    return F.when(c == 0, "zero").when(c <= 0.33, "low").when(c <= 0.66, "middle").when(c > 0.66, "high")


def quality_status(p99: Column, percent_nonzero: Column) -> Column:
    return F.when((p99 == 0) & (percent_nonzero < 1), "SPARSE").when(p99 == 0, "COLLAPSE").when(percent_nonzero < 1, "RISK").when(percent_nonzero < 5, "SPARSE").otherwise("OK")


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    return F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)


def truth_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "sim")


def joined_distinct(c: Column) -> Column:
    """An aggregate: the distinct values, sorted, with bars between."""
    return F.array_join(F.array_sort(F.collect_set(c)), "|")


def class_of(value: Column, bounds: Column) -> Column:
    """1 to 5: bounds[i] <= value < bounds[i + 1], values beyond the ends in the end classes; missing stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.size(bounds) - 1, F.size(F.filter(bounds, lambda b: b <= value)))))


def number_text(c: Column, decimals: int = 3) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c.cast("double"))).otherwise(F.lit("-"))


def class_label(bounds: Column, k: Column) -> Column:
    return F.when(k.isNotNull(), F.concat(number_text(F.try_element_at(bounds, k)), F.lit("-"), number_text(F.try_element_at(bounds, k + 1))))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(to_num(lat).between(-90, 90) & to_num(lon).between(-180, 180), F.lit(False))


def ledger_match(column: Column, value: str, account: Column, pattern: str) -> Column:
    """Rows of one column kind whose account matches a pattern in any case; missing matches nothing."""
    return F.coalesce((column == value) & account.rlike(f"(?i){pattern}"), F.lit(False))


def same_place(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))
