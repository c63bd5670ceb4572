"""Multi-version rows: snapshots, overlays, compaction and first-committer-wins validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(log: DataFrame, key: list[str], ts: str, gone: str, at: int | None = None) -> DataFrame:
    """The newest version of each key at or before ``at``, deleted ones left out.

    A commutative aggregate: it combines before the shuffle and does not depend on arrival order.
    """
    rows = log if at is None else log.where(F.col(ts) <= at)
    values = [c for c in log.columns if c not in (*key, ts, gone)]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values, gone), F.col(ts)).alias("newest"))
    live = newest.where(~F.coalesce(F.col(f"newest.{gone}"), F.lit(False)))
    return live.select(*[F.col(c) if c in key else F.col(f"newest.`{c}`").alias(c) for c in log.columns if c not in (ts, gone)])


def newest(log: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The newest version of each key, deleted or not, with all columns."""
    values = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*values), F.col(ts)).alias("last"))
    return last.select(*[F.col(c) if c in key else F.col(f"last.`{c}`").alias(c) for c in log.columns])


def last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key the last, in the order of the rows."""
    order = F.monotonically_increasing_id()
    return newest(rows.withColumn("lakeloom_order", order), key, "lakeloom_order").drop("lakeloom_order")


def overlay(base: DataFrame, buffer: DataFrame, key: list[str], gone: str) -> DataFrame:
    """A snapshot as its own transaction sees it: buffered rows replace stored ones."""
    kept = base.join(buffer.select(*key), key, "left_anti")
    return kept.unionByName(buffer.where(~F.col(gone)).select(*base.columns))


def keep_newest(log: DataFrame, key: list[str], ts: str, n: int) -> DataFrame:
    """Garbage collection: the n newest versions of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(ts)))
    return log.withColumn("version_rank", rank).where(F.col("version_rank") <= n).drop("version_rank")


def point_conflicts(reads: DataFrame, commits: DataFrame, key: str = "key") -> DataFrame:
    """Reads (txn, key, read_ts) whose key has a later commit (key, commit_ts)."""
    latest = commits.groupBy(key).agg(F.max("commit_ts").alias("last_ts"))
    return reads.join(latest, key).where("last_ts > read_ts").select("txn", key, "read_ts", "last_ts")


def range_conflicts(ranges: DataFrame, commits: DataFrame, width: int) -> DataFrame:
    """Range reads (txn, low, high, read_ts) with a later commit inside [low, high), for whole-number keys.

    Ranges and keys are cut into cells of ``width``, so that the join has an equality; a commit and a range
    meet in one cell only.
    """
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    keyed = commits.withColumn("cell", F.floor(F.col("key") / width))
    inside = (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")) & (F.col("commit_ts") > F.col("read_ts"))
    return cells.where("low < high").join(keyed, "cell").where(inside).select("txn", "key", "read_ts", "commit_ts")


def merge_overlapping(commits: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Last write of each key."""
    values = [c for c in commits.columns if c not in key]
    return commits.groupBy(*key).agg(F.max_by(F.struct(*values), F.col(ts)).alias("v")).select(*key, "v.*")
