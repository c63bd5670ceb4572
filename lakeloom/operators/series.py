"""Time-series analytics over (series, day, value) and small helpers of dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(series: str, order: str):
    return Window.partitionBy(series).orderBy(order)


def pct_change(df: DataFrame, series: str, order: str, value: str, n: int) -> DataFrame:
    """Per cent change over n rows; rows without a predecessor go."""
    before = F.lag(value, n).over(_by(series, order))
    return df.withColumn("before", before).where("before IS NOT NULL AND before <> 0").withColumn("pct", F.round((F.col(value) / F.col("before") - 1) * 100, 4)).drop("before")


def difference(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(_by(series, order)))


def trend(df: DataFrame, series: str, order: str, value: str, n: int = 12) -> DataFrame:
    """Sum of the last n differences, and its name."""
    d = difference(df, series, order, value)
    rank = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(order)))
    total = d.withColumn("rank", rank).where(F.col("rank") <= n).groupBy(series).agg(F.sum("diff").alias("change"))
    return total.withColumn("trend", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat"))


def latest(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Latest and previous value of each series, and their difference."""
    previous = F.lag(value).over(_by(series, order))
    rank = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(order)))
    rows = df.withColumn("previous", previous).withColumn("rank", rank).where("rank = 1")
    return rows.select(series, order, F.col(value).alias("latest"), "previous", (F.col(value) - F.col("previous")).alias("delta"))


def normalised(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """First value of each series as 100."""
    return df.withColumn("index_value", F.round(F.col(value) / F.first(value).over(_by(series, order)) * 100, 4))
