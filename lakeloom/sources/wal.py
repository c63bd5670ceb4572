"""A write-ahead log of JSON lines ({"ts": 1, "ops": {"key": value}}) as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """(key, value, commit_ts, deleted) of every sound entry with ts above ``after``.

    Torn lines, and lines whose ts is no number or whose ops is no object, are left out.  Values stay JSON
    text; null is a deletion.  Entries may come in any order.
    """
    lines = spark.read.text(path)
    parsed = lines.select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    stamped = parsed.select(F.expr("try_variant_get(v, '$.ts', 'bigint')").alias("commit_ts"), F.expr("schema_of_variant(variant_get(v, '$.ts'))").alias("kind"), F.expr("to_json(variant_get(v, '$.ops'))").alias("ops"))
    sound = stamped.where("commit_ts IS NOT NULL AND kind = 'BIGINT' AND ops LIKE '{%'").where(F.col("commit_ts") > after)
    each = sound.select("commit_ts", F.explode(F.from_json("ops", "map<string,string>")).alias("key", "value"))
    return each.select("key", "value", "commit_ts", F.col("value").isNull().alias("deleted"))


def append(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append (commit_ts, ops map) rows as JSON lines."""
    rows.select(F.to_json(F.struct(F.col("commit_ts").alias("ts"), "ops"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
