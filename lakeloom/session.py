"""Session settings that the engine assumes, and where they are set."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic, UTC and adaptive plans; broadcast only below a measured size.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
}


def build(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; on a cluster leave ``master`` and ``partitions`` to its own."""
    builder = SparkSession.builder.appName("lakeloom").config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
