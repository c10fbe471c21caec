"""Growing inputs: files taken in once, exposed cells kept up to date, counts in windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from gridindex.functions.grid import cell_of, grid_disk
from gridindex.shared import delete
from gridindex.sources.readers import glob


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files under a path. A ts without time zone is read as the session's."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def ingest_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything not yet taken in, each file once, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(df: DataFrame, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts a key and window; what comes later than the delay is dropped, and a window is given out once it is closed."""
    counts = df.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


class _NewYears(StatefulProcessor):
    """Keeps each cell's years for as long as the stream lives, and gives out those it did not have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getValueState("years", "years array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.years.get()
        had = set(held[0]) if held else set()
        new = {r.year for r in rows} - had
        if new:
            self.years.update((sorted(had | new),))
        for year in sorted(new):
            yield Row(cell_id=key[0], year=year)

    def close(self) -> None:
        pass


def exposed_cells(df: DataFrame, size: float) -> DataFrame:
    """(cell_id, year) pairs of events (ts, x, y), each once, however much later it comes again. Events without time or place have none.

    The state is a list of years a cell: it grows with the cells that ever had an event, not with the events.
    """
    cells = df.select(cell_of(F.col("x"), F.col("y"), size).alias("cell_id"), F.year("ts").alias("year")).dropna()
    return cells.groupBy("cell_id").transformWithState(_NewYears(), StructType.fromDDL("cell_id string, year int"), "Append", "None")


#: Keyed state of any life is kept in this store, on disk with changes written beside the checkpoint.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_exposed(df: DataFrame, size: float, k: int, root: str, checkpoint: str) -> StreamingQuery:
    """Brings the pairs under root up to date with all events (ts, x, y) not yet seen, spread over k steps, then stops.

    A batch that is run again after a loss replaces its own folder.
    """
    spark, (name, store) = df.sparkSession, _STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)  # the query takes the settings of its start
    try:
        return exposed_cells(df, size).writeStream.foreachBatch(upsert_years(lambda b: f"{root}/batch={b}", k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def upsert_years(path: Callable[[int], str], k: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: (cell, year) pairs spread over k steps, written as one folder a batch. A batch that is run again
    replaces its own folder; readers take the distinct pairs (exposed_years)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spread = batch.select("year", F.explode(grid_disk(F.col("cell_id"), k)).alias("cell_id")).distinct()
        spread.write.mode("overwrite").parquet(path(batch_id))

    return write


def _folders(spark: SparkSession, root: str, kind: str) -> dict[int, str]:
    """Finished folders of a kind (batch or through) by number."""
    found = (p.rsplit("/", 1)[0] for p, _ in glob(spark, f"{root}/{kind}=*/_SUCCESS"))
    return {int(p.rsplit("=", 1)[1]): p for p in found}


def exposed_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Distinct cell_id, year: the newest compacted folder and the batches after it."""
    whole, batches = _folders(spark, root, "through"), _folders(spark, root, "batch")
    last = max(whole, default=-1)
    paths = [*([whole[last]] if whole else []), *(p for b, p in sorted(batches.items()) if b > last)]
    if not paths:
        return spark.createDataFrame([], "cell_id string, year int")
    return spark.read.schema("cell_id string, year int").parquet(*paths).distinct()


def compact_years(spark: SparkSession, root: str, least: int = 2) -> bool:
    """All finished batches as one folder, where there are so many of them; the old ones go once the new one is whole.

    Readers never see a pair missing: until the new folder is finished they take the old ones, afterwards they pass them over.
    """
    whole, batches = _folders(spark, root, "through"), _folders(spark, root, "batch")
    done = max(whole, default=-1)
    if sum(b > done for b in batches) < least:
        return False
    last = max(batches)
    exposed_pairs(spark, root).write.mode("overwrite").parquet(f"{root}/through={last}")
    for path in [*(p for b, p in batches.items() if b <= last), *whole.values()]:
        delete(spark, path)
    return True


def exposed_years(spark: SparkSession, root: str) -> DataFrame:
    return exposed_pairs(spark, root).groupBy("cell_id").agg(F.count("*").alias("n_years"))
