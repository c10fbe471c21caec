"""Tables in the folder that all executors share: lineage is cut there, and losing an executor loses nothing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The lists of temporary() that are open in this thread of work, the outermost first.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths that scratch() gives inside, and removes those still in the list at the end. What is read later must be taken out."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield paths
    finally:
        _OPEN.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local folder on a local master; elsewhere ValueError."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gridindex-")
    path = os.path.join(top, what, uuid.uuid4().hex)
    for paths in _OPEN.get():
        paths.append(path)
    return path


def written(spark: SparkSession, df: DataFrame, what: str = "tables") -> DataFrame:
    """df, written once to the shared folder and read again."""
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folder of a written() table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)
