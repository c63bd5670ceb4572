"""All queries of the engine by name, and the SQL that an independent database runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.quantified import rewrite, spread_not_in
from ..sources.catalog import register
from .core import PAIRS, SAME
from .frames import FRAMES


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, text)
        return spark.sql(spread_not_in(rewrite(text)))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sql(s) for n, s in SAME.items()} | {n: _sql(s) for n, (s, _) in PAIRS.items()} | {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return SAME | {n: d for n, (_, d) in PAIRS.items()} | {n: d for n, (_, d) in FRAMES.items()}
