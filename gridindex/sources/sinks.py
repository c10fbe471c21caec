"""Writing: runs, versions, extracts, partitions and ledgers."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.functions.grid import boundary_wkt
from gridindex.sources.readers import exists, size_of, version_of
from gridindex.sources.registry import Registry


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_run(df: DataFrame, root: str, run_id: str) -> str:
    """A full result in a folder of its own, never overwritten; of two writers of one id, one gets FileExistsError."""
    path = f"{root}/run_id={run_id}"
    if exists(df.sparkSession, path) or not claim(df.sparkSession, path):
        raise FileExistsError(f"{path} exists or is being written")
    df.write.mode("errorifexists").parquet(path)
    return path


def save_slim(df: DataFrame, path: str, ids: Sequence[str], scores: Sequence[str]) -> None:
    """Ids and scores alone, scores in single precision, gzip."""
    df.select(*ids, *(F.col(c).cast("float").alias(c) for c in scores)).write.mode("overwrite").option("compression", "gzip").parquet(path)


def dimension_slices(df: DataFrame, registry: Registry, ids: Sequence[str], most: int = 6) -> dict[str, DataFrame]:
    """Per dimension, tables of at most so many indicators each, named dim_01, dim_02."""
    out = {}
    for d in registry.dimensions:
        have = [c for i in d.indicators for c in (i.normalised,) if c in df.columns]
        for k in range(0, len(have), most):
            out[f"{d.column}_{k // most + 1:02d}"] = df.select(*ids, *(F.col(c).cast("float").alias(c) for c in have[k : k + most]))
    return out


#: Slices beyond this size are reported.
SLICE_BYTES = 95_000_000


def save_dimension_slices(df: DataFrame, registry: Registry, root: str, ids: Sequence[str], most: int = 6, limit: int = SLICE_BYTES) -> list[str]:
    """Writes every slice (gzip) and warns of those larger than the limit."""
    paths = []
    for name, part in dimension_slices(df, registry, ids, most).items():
        path = f"{root}/dim_{name}"
        part.write.mode("overwrite").option("compression", "gzip").parquet(path)
        if (size := size_of(df.sparkSession, path)) > limit:
            warnings.warn(f"{path} has {size} bytes: take fewer indicators to a slice", stacklevel=2)
        paths.append(path)
    return paths


def claim(spark: SparkSession, path: str) -> bool:
    """Whether this caller alone may write the path: an empty file beside it is created, which only one caller can do.

    The claim stays, whatever becomes of its writer, so the path is not given out again.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    marker = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_claim_{place.getName()}")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fs.mkdirs(marker.getParent())
        if fs.getScheme() == "file":  # there, create() looks first and creates afterwards
            return jvm.java.io.File(fs.makeQualified(marker).toUri()).createNewFile()
        fs.create(marker, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def next_version_path(spark: SparkSession, path: str) -> str:
    """The caller's own version of a path, claimed. Free and without version: _v1; free with one: unchanged; taken: the first free version."""
    stem, version, suffix = version_of(path)
    if version is not None and not exists(spark, path) and claim(spark, path):
        return path
    for k in count(1):
        found = f"{stem}_v{k}{suffix}"
        if not exists(spark, found) and claim(spark, found):
            return found
    raise AssertionError


def save_version(df: DataFrame, path: str) -> str:
    """df as a new version of a path; gives the path. Any number of writers at once get versions of their own."""
    path = next_version_path(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table in the warehouse, dealt to buckets by key and sorted in them: what is joined or grouped by the key need not move."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def save_csv(df: DataFrame, path: str, decimals: int | None = None, bom: bool = False) -> None:
    """With a header; bom puts a byte-order mark before it, by which spreadsheets know UTF-8."""
    rounded = df if decimals is None else df.select(*(F.round(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    marked = rounded.toDF("\ufeff" + df.columns[0], *df.columns[1:]) if bom else rounded
    marked.write.mode("overwrite").option("header", True).csv(path)


def save_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has, so that a run can be taken up again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def remaining(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a run that is taken up again still has to do."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_failures(df: DataFrame, path: str) -> None:
    """timestamp, cd_mun, sigla_uf, tipo, stage, reason (500 characters at most)."""
    df.withColumn("reason", F.substring("reason", 1, 500)).write.mode("append").parquet(path)


def reset_failures(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").parquet(path)


def with_boundary_wkt(df: DataFrame, cell: str, size: float) -> DataFrame:
    return df.withColumn("wkt", boundary_wkt(F.col(cell), size))


def save_candidates(profiles: DataFrame, candidates: DataFrame, root: str) -> None:
    profiles.write.mode("overwrite").parquet(f"{root}/profiles")
    candidates.write.mode("overwrite").partitionBy("cluster").parquet(f"{root}/candidates")
