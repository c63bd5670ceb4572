"""Deterministic batches: epochs, ordered merge, read and write conflicts, sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch(ts: Column, millis: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(millis * 1000)).cast("bigint")


def merged_order(log: DataFrame, batch: str, partition: str, seq: str) -> DataFrame:
    """Position of each entry within its epoch, by partition and sequence; a transaction that was submitted to
    several partitions counts once, at its first place."""
    first = Window.partitionBy("txn").orderBy(batch, partition, seq)
    once = log.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return once.withColumn("position", F.row_number().over(Window.partitionBy(batch).orderBy(partition, seq)).cast("bigint"))


def lost_writes(ops: DataFrame) -> DataFrame:
    """Of the writers (txn, key, ord) of a key, all but the last."""
    after = F.lead("txn").over(Window.partitionBy("key").orderBy("ord"))
    return ops.where("kind = 'w'").withColumn("winner", after).where("winner IS NOT NULL").select("txn", "key")


def read_write(ops: DataFrame) -> DataFrame:
    """Readers of a key that another transaction writes."""
    span = ops.where("kind = 'w'").groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    reads = ops.where("kind = 'r'").join(span, "key")
    return reads.where("low <> ord OR high <> ord").select("txn", "key").distinct()


def shard(key: Column, n: int) -> Column:
    """First eight hex digits of the md5, modulo n."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % n).cast("bigint")


def skew(shards: DataFrame, column: str) -> DataFrame:
    """Coefficient of variation of shard sizes, in per cent."""
    sizes = shards.groupBy(column).count()
    return sizes.agg(F.round(F.stddev_pop("count") / F.avg("count") * 100, 4).alias("cv_percent"), F.count(F.lit(1)).alias("shards"))


def recent_writers(writes: DataFrame, seconds: int) -> DataFrame:
    """Writes whose key was written within the last ``seconds`` before (exact, where a filter would guess)."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "txn"))
    return writes.withColumn("before", before).where(F.col("before").isNotNull() & (F.unix_micros("ts") - F.unix_micros("before") < seconds * 1_000_000)).select("txn", "key")
