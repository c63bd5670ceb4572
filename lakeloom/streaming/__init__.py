"""Structured Streaming: replay of logs into versioned tables, and windowed aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import Folder


_STATE = "spark.sql.streaming.stateStore.providerClass"
_ON_HEAP, _ON_DISK = (f"org.apache.spark.sql.execution.streaming.state.{n}StateStoreProvider" for n in ("HDFSBacked", "RocksDB"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to the end and return what the stream puts out; the rows go to files, none to the driver.

    ``path`` is a folder that executors share.  Each batch writes a folder of its own there, so a batch that is
    repeated replaces itself.  In complete mode a batch holds the whole result, and the last one is read.
    """
    spark = stream.sparkSession
    folder = Folder(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:020d}")

    with _state_on_disk(spark):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    written = sorted(folder.names(""))
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{name}" for name in (written[-1:] if mode == "complete" else written)])


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, not on the heap, where nobody has chosen another store."""
    chosen = spark.conf.get(_STATE, _ON_HEAP)
    if chosen == _ON_HEAP:
        spark.conf.set(_STATE, _ON_DISK)
    try:
        yield
    finally:
        if chosen == _ON_HEAP:
            spark.conf.unset(_STATE)


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums for each window; rows later than ``late`` behind the newest are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, ts: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def replay(stream: DataFrame, table, checkpoint: str) -> None:
    """Upsert a log (key columns, values, commit_ts) into a versioned table, batch by batch.

    Within a batch and against the table, the later commit_ts wins, so order of arrival and repeated delivery
    do not matter.  The table needs a ``source_ts`` column.
    """
    from ..operators import versions

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        newest = versions.merge_overlapping(batch, table.key, "source_ts")
        known = table.snapshot().select(*table.key, F.col("source_ts").alias("known_ts"))
        fresh = newest.join(known, table.key, "left").where("known_ts IS NULL OR source_ts > known_ts").drop("known_ts")
        if not fresh.isEmpty():
            table.upsert(fresh)

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
