"""Landed JSON payloads into warehouse tables: series with observations, and a forum's items and users.

Fetching is not part of this; payload files lie in a folder that Spark reads.  Every load may be repeated:
rows are upserted by key, the newest ingestion wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: Payload fields.
SERIES = _struct(id=_S, title=_S, observation_start=_S, observation_end=_S, frequency=_S, frequency_short=_S, units=_S, units_short=_S, seasonal_adjustment=_S, seasonal_adjustment_short=_S, last_updated=_S, popularity=_L, notes=_S)
OBSERVATION = _struct(realtime_start=_S, realtime_end=_S, date=_S, value=_S)
ITEM = _struct(id=_L, type=_S, by=_S, time=_L, text=_S, parent=_L, url=_S, score=_L, title=_S, descendants=_L, dead=T.BooleanType(), deleted=T.BooleanType(), poll=_L, kids=T.ArrayType(_L))
USER = _struct(id=_S, created=_L, karma=_L, about=_S)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def series(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json(spark, path, _struct(seriess=T.ArrayType(SERIES))).select(F.inline("seriess"))
    stamp = F.try_to_timestamp(F.regexp_replace("last_updated", r"([+-]\d\d)$", "$1:00"), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return rows.withColumnRenamed("id", "series_id").withColumns({"observation_start": F.col("observation_start").try_cast("date"), "observation_end": F.col("observation_end").try_cast("date"), "last_updated": stamp})


def observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): '.' and empty values are left out, values that are no numbers are rejected.

    Files lie in one folder for each series: ``series_id=GDP/…``.
    """
    raw = spark.read.schema(_struct(observations=T.ArrayType(OBSERVATION), series_id=_S)).option("multiLine", True).json(path)
    rows = raw.select("series_id", F.inline("observations")).withColumn("number", F.col("value").try_cast("double"))
    present = rows.where("value IS NOT NULL AND trim(value) NOT IN ('.', '')")
    good = present.where("number IS NOT NULL").select("series_id", F.col("date").try_cast("date").alias("observation_date"), F.col("number").alias("value"), F.col("realtime_start").try_cast("date").alias("realtime_start"), F.col("realtime_end").try_cast("date").alias("realtime_end"))
    return good, present.where("number IS NULL").select("series_id", "date", "value")


def since(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows from each series' newest loaded day on (that day included); all rows of new series."""
    newest = loaded.groupBy("series_id").agg(F.max("observation_date").alias("newest"))
    return rows.join(newest, "series_id", "left").where("newest IS NULL OR observation_date >= newest").drop("newest")


def items(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, ITEM)


def users(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, USER)


def kids(rows: DataFrame) -> DataFrame:
    """(item_id, kid_id, position); a kid that is named twice keeps its last position."""
    each = rows.select(F.col("id").alias("item_id"), F.posexplode("kids").alias("position", "kid_id"))
    return each.groupBy("item_id", "kid_id").agg(F.max("position").alias("position"))


def thread(rows: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, id, depth) of the comments under each story, level by level, down to ``max_depth``."""
    links = rows.where("type = 'comment'").select("id", "parent")
    level = rows.where("type = 'story'").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    found = level.limit(0)
    for depth in range(1, max_depth + 1):
        level = level.select("root", F.col("id").alias("parent")).join(links, "parent").select("root", "id", F.lit(depth).alias("depth"))
        found = found.unionByName(level)
    return found


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str = "ingested_at") -> DataFrame:
    """The newest row of each key over both."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return old.unionByName(new).withColumn("nth", rank).where("nth = 1").drop("nth")


def load(engine, table: str, rows: DataFrame, source: str) -> int:
    """Upsert into a versioned table and record the outcome in sync_metadata, on failure too."""
    def note(status: str, count: int, error: str | None) -> None:
        when = engine.spark.sql("SELECT current_timestamp() AS t").first().t
        engine.insert("sync_metadata", [{"source": source, "last_sync_at": when, "last_sync_status": status, "records_synced": count, "error_message": error}])

    try:
        count = rows.count()
        engine.table(table).upsert(rows)
    except Exception as error:
        note("failed", 0, str(error).split("\n")[0][:500])
        raise
    note("success", count, None)
    return count
