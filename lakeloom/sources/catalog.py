"""The Parquet tables of a data folder as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The tables of a data folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Views for the tables that a statement names, or for all."""
    named = set(TABLES) if sql is None else set(re.findall(r"\w+", sql.lower())) & set(TABLES)
    for name in named:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
