"""Reading: column-tolerant delimited text, file sets, runs and lookups. Paths are any that Spark can read."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridindex.functions.scalars import null_if_nan
from gridindex.sources.registry import Registry


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def glob(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Matching paths and their times of change, by name."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p) or []
    return sorted((s.getPath().toString(), s.getModificationTime()) for s in found)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL: aggregates skip NULL but not NaN."""
    return df.select(*(null_if_nan(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return without_nan(df.select(*columns) if columns else df)


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def tolerant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as named; where one is missing, names are compared without case and come out lower-case."""
    if set(columns) <= set(df.columns):
        return df.select(*columns)
    lower = {c.lower(): c for c in df.columns}
    missing = [c for c in columns if c.lower() not in lower]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*(F.col(f"`{lower[c.lower()]}`").alias(c.lower()) for c in columns))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """A semicolon where the first line has one, else a comma."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and ";" in first[0][0] else ","


def read_csv_columns(spark: SparkSession, path: str, columns: Sequence[str], sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.option("header", True).option("sep", sep or sniff_delimiter(spark, path)).option("encoding", encoding).csv(path)
    return tolerant(df, columns)


def _first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The first line of a file, or of a folder's first file with content, without reading the rest."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getLen() and f.getPath().getName()[0] not in "_.")
        if not files:
            return ""
        p = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(p)
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, encoding)).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("\ufeff")


def read_csv_set(spark: SparkSession, pattern: str, columns: Sequence[str]) -> DataFrame:
    """All files (or folders of files) of a pattern as one table, with the file's or folder's name; raises where none match.

    Files may differ in their columns' order, in other columns and in the delimiter: those with one header are read
    together, and what they give is united by name.
    """
    groups: dict[tuple[str, bool], list[str]] = {}
    for path, _ in glob(spark, pattern):
        fs, p = _fs(spark, path)
        groups.setdefault((_first_line(spark, path), fs.getFileStatus(p).isDirectory()), []).append(path)
    if not groups:
        raise FileNotFoundError(pattern)
    frames = []
    for (header, folder), paths in groups.items():
        df = spark.read.option("header", True).option("sep", ";" if ";" in header else ",").csv(paths)
        name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2 if folder else -1))
        frames.append(tolerant(df.withColumn("file_name", name), [*columns, "file_name"]).toDF(*columns, "file_name"))
    return reduce(DataFrame.unionByName, frames)


def read_csv_fallback(spark: SparkSession, path: str, columns: Sequence[str], attempts: Sequence[tuple[str, str]] = (("UTF-8", ","), ("ISO-8859-1", ";"))) -> DataFrame:
    """The first (encoding, separator) whose encoding every line of the file is valid in and that has the columns."""
    problem: Exception | None = None
    for encoding, sep in attempts:
        try:
            if encoding.upper() == "UTF-8" and not spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty():
                raise ValueError(f"not {encoding}")
            return read_csv_columns(spark, path, columns, sep, encoding)
        except ValueError as e:
            problem = e
    raise ValueError(f"{path}: no attempt fits") from problem


def read_csv_preamble(spark: SparkSession, path: str, skip: int = 3, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """One text file with lines before its header. All columns are text; numbers are for to_num_comma().

    The first skip + 1 lines go by their place in the file; later lines stay, whatever they say.
    """
    value = F.decode(F.col("value").cast("binary"), encoding)  # the text source gives bytes as they are
    lines = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    head = lines.filter("block = 0").limit(skip + 1).collect()  # rows of one block come in the file's order
    if len(head) <= skip:
        raise ValueError(f"{path}: no header after {skip} lines")
    schema = ", ".join(f"`{c.strip().strip(chr(34))}` STRING" for c in head[skip].value.split(sep))
    body = lines.filter(~((F.col("block") == 0) & F.col("place").between(head[0].place, head[skip].place)) & (F.length(F.trim("value")) > 0))
    return body.select(F.from_csv("value", schema, {"sep": sep}).alias("row")).select("row.*")


def read_years(spark: SparkSession, pattern: str, first: int, last: int, columns: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Files named by year, as one table with a year column, and the years found; missing years are skipped."""
    found = [y for y in range(first, last + 1) if exists(spark, pattern.format(year=y))]
    if not found:
        raise FileNotFoundError(pattern)
    frames = [read_csv_columns(spark, pattern.format(year=y), columns).withColumn("year", F.lit(y)) for y in found]
    return reduce(DataFrame.unionByName, frames), found


def missing_inputs(spark: SparkSession, registry: Registry, root: str) -> list[str]:
    """Indicators without a file under root."""
    return [i.key for i in registry.indicators if not exists(spark, f"{root}/{registry.file_name(i)}")]


# Numeric state codes.
STATE_CODES = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO", 21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL",
    28: "SE", 29: "BA", 31: "MG", 32: "ES", 33: "RJ", 35: "SP", 41: "PR", 42: "SC", 43: "RS", 50: "MS", 51: "MT", 52: "GO", 53: "DF",
}


def state_of_code(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in STATE_CODES.items() for x in (k, v))), code.try_cast("int"))


def states_of(df: DataFrame, column: str = "state") -> DataFrame:
    """The keys that a table has, each once: what an inventory asks for, or what a run has already written."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def with_region_from_filename(df: DataFrame, column: str = "cd_uf", file_name: str = "file_name") -> DataFrame:
    """The state code from the file's name where the column is absent or missing."""
    parsed = F.regexp_extract(F.col(file_name), r"(?:^|[^0-9])([1-5][0-9])(?:[^0-9]|$)", 1).try_cast("int")
    own = F.coalesce(F.col(column).try_cast("int"), parsed) if column in df.columns else parsed
    return df.withColumn(column, own).withColumn("sigla_uf", state_of_code(F.col(column)))


def latest_run(spark: SparkSession, folder: str, prefix: str, exclude: Sequence[str] = ("_dim_", "dashboard"), fallback: str | None = None) -> str:
    """The newest run by time of change, then name; raises where neither folder has one."""
    for top in [folder, *([fallback] if fallback else [])]:
        runs = [(t, p) for p, t in glob(spark, f"{top}/{prefix}*") if not any(x in p.rsplit("/", 1)[1] for x in exclude)]
        if runs:
            return max(runs)[1]
    raise FileNotFoundError(f"{folder}/{prefix}*")


def read_polygons(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """feature_id, state, muni, class, rings; a state's filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if state is None else df.filter(F.col("state") == state)


def read_lookup(spark: SparkSession, path: str, key: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """A small table by canonical municipality code; of the rows of one code the least by its columns, in their order."""
    from gridindex.functions.scalars import canon_code

    df = read_csv_columns(spark, path, [key, *columns], sep)
    return df.groupBy(canon_code(F.col(key)).alias(key)).agg(F.min(F.struct(*columns)).alias("__least")).select(key, "__least.*")


def first_of_file(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key: the first file's (by name), and of a file's rows the least by content."""
    order = Window.partitionBy(*keys).orderBy("file_name", *(c for c in sorted(df.columns) if c not in (*keys, "file_name")))
    return df.withColumn("__first", F.row_number().over(order)).filter("__first = 1").drop("__first")


def version_of(path: str) -> tuple[str, int | None, str]:
    """(stem, version or None, suffix) of a path like result_v3.parquet."""
    m = re.fullmatch(r"(.*?)(?:_v(\d+))?(\.[^./]*)?", path)
    return m[1], int(m[2]) if m[2] else None, m[3] or ""
