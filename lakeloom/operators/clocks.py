"""Vector clocks, siblings, quorum, ring routing and membership as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increment(clock: Column, node: Column) -> Column:
    one = F.map_from_arrays(F.array(node), F.array(F.coalesce(F.try_element_at(clock, node), F.lit(0)) + 1))
    return F.map_concat(F.map_filter(clock, lambda k, v: k != node), one)


def merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare(a: Column, b: Column) -> Column:
    """BEFORE, AFTER, EQUAL or CONCURRENT; a missing node counts 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "CONCURRENT").when(less, "BEFORE").when(more, "AFTER").otherwise("EQUAL")


def siblings(versions: DataFrame, key: str = "key", clock: str = "clock") -> DataFrame:
    """Versions (id, key, clock, ...) that no other version of their key dominates; of equal ones the least id.

    Of versions with equal clocks one is kept first.  The others of one key meet each other once; a key has
    as many different clocks as it has live writers.
    """
    counted = F.map_filter(F.col(clock), lambda k, v: v != 0)
    name = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counted))))
    values = [c for c in versions.columns if c != key]
    one = versions.groupBy(key, name.alias("_name")).agg(F.min_by(F.struct(*values), F.col("id")).alias("_v"))
    versions = one.select(*[F.col(c) if c == key else F.col(f"_v.`{c}`").alias(c) for c in versions.columns])
    a, b = versions.alias("a"), versions.alias("b")
    order = compare(F.col(f"a.{clock}"), F.col(f"b.{clock}"))
    beaten = (order == "BEFORE") | ((order == "EQUAL") & (F.col("a.id") > F.col("b.id")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.id") != F.col("b.id")) & beaten, "left_anti").select("a.*")


def last_writer(versions: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Of the siblings of each key, the latest by time, then by id."""
    kept = siblings(versions, key)
    values = [c for c in kept.columns if c != key]
    return kept.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(ts, "id")).alias("v"), F.count(F.lit(1)).alias("n_siblings")).select(key, "v.*", "n_siblings")


def quorum(acks: DataFrame, rf: int) -> DataFrame:
    """Per operation: acknowledgements, and success at levels one, quorum and all."""
    n = acks.groupBy("op").agg(F.count_if("ok").alias("acks"))
    return n.select("op", "acks", (F.col("acks") >= 1).alias("one"), (F.col("acks") >= rf // 2 + 1).alias("quorum"), (F.col("acks") >= rf).alias("all_of"))


def ring_position(text: Column) -> Column:
    """md5 modulo 2**32."""
    return F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("bigint")


def ring(nodes: DataFrame, vnodes: int) -> DataFrame:
    """(node, position) of every virtual node, ``node:i``."""
    each = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return each.select("node", ring_position(F.concat_ws(":", "node", F.col("i").cast("string"))).alias("position"))


def route(keys: DataFrame, nodes: DataFrame, vnodes: int, cells: int = 4096) -> DataFrame:
    """(key, node): the first virtual node after each key, around the ring.

    The ring is cut into cells; each cell lists the virtual nodes inside it and the first one behind it, so
    a key looks at the few of its own cell.
    """
    size = (1 << 32) // cells
    places = ring(nodes, vnodes)
    first = places.agg(F.min_by("node", "position")).first()[0]  # one row: the ring's start
    inside = places.select((F.col("position") / size).cast("bigint").alias("cell"), "node", "position")
    grid = nodes.sparkSession.range(cells).withColumnRenamed("id", "cell")
    starts = inside.groupBy("cell").agg(F.min(F.struct("position", "node")).alias("head"))
    ahead = F.first("head", ignorenulls=True).over(Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing))  # as many rows as cells
    behind = grid.join(starts, "cell", "left").select("cell", ahead.alias("next")).where("next IS NOT NULL").select("cell", "next.node", "next.position")
    listed = inside.unionByName(behind).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("places"))
    found = keys.withColumn("h", ring_position(F.col("key"))).withColumn("cell", (F.col("h") / size).cast("bigint")).join(F.broadcast(listed), "cell", "left")
    after = F.filter("places", lambda p: p["position"] > F.col("h"))
    return found.select("key", F.coalesce(F.get(after, 0)["node"], F.lit(first)).alias("node"))


def membership(beats: DataFrame, now: float, suspect: float = 5.0, dead: float = 10.0) -> DataFrame:
    """Newest heartbeat of each node over all views, and its state by age."""
    newest = beats.groupBy("node").agg(F.max(F.struct("heartbeat", "seen_at")).alias("b")).select("node", "b.*")
    age = F.lit(now) - F.col("seen_at")
    return newest.select("node", "heartbeat", F.when(age > dead, "DEAD").when(age > suspect, "SUSPECT").otherwise("ALIVE").alias("state"))


def to_repair(replicas: DataFrame, winners: DataFrame) -> DataFrame:
    """Replica rows (key, node, version) that differ from the winner (key, version)."""
    w = winners.select("key", F.col("version").alias("wanted"))
    return replicas.join(w, "key").where("NOT version <=> wanted").select("key", "node", "version", "wanted")


def live_hints(hints: DataFrame, now: float, ttl: float) -> DataFrame:
    return hints.where(F.lit(now) - F.col("stored_at") <= ttl)
