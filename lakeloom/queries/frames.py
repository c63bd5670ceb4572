"""Queries built from the operator library, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from ..operators import clocks, epochs, series, versions
from ..plans.engine import Engine
from ..sources.catalog import load
from ..sources.versioned import VersionedTable


def _root(spark: SparkSession) -> str:
    """A folder that executors share, for versioned tables and checkpoints of one query."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
    return f"{shared.rstrip('/')}/lakeloom-q-{uuid.uuid4().hex}"


def _orders_table(spark: SparkSession, sf: str) -> VersionedTable:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("prio", T.StringType())])
    table = VersionedTable.create(spark, _root(spark), "orders_v", schema, ["id"])
    table.upsert(load(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "NULLIF(o_orderpriority, '5-LOW') AS prio"))
    return table


_BASE = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, NULLIF(o_orderpriority, '5-LOW') AS prio FROM orders"


def dml_insert(spark, sf):
    t = _orders_table(spark, sf)
    t.upsert(spark.createDataFrame([(-1, "N", 1.5, None), (0, "N", 2.5, "x")], t.schema))
    return t.snapshot()


def dml_insert_select(spark, sf):
    t = _orders_table(spark, sf)
    t.upsert(t.snapshot().where("status = 'P'").withColumn("id", -F.col("id") - 1))
    return t.snapshot()


def dml_update_case(spark, sf):
    t = _orders_table(spark, sf)
    t.update({"price": "CASE WHEN prio IS NULL THEN 0e0 ELSE price * 2e0 END", "prio": "status"}, "status = 'F'")
    return t.snapshot()


def dml_delete(spark, sf):
    t = _orders_table(spark, sf)
    t.delete("prio NOT IN ('1-URGENT', '2-HIGH')")
    return t.snapshot()


def dml_time_travel(spark, sf):
    t = _orders_table(spark, sf)
    before = t.manifest()["version"]
    t.delete("status = 'F'")
    return t.snapshot(before)


def dml_compact(spark, sf):
    t = _orders_table(spark, sf)
    t.delete("status = 'F'")
    t.compact()
    t.vacuum()
    return t.snapshot()


def _log(spark, sf) -> DataFrame:
    return load(spark, sf, "events").selectExpr("user_id AS key", "value", "event_id AS commit_ts", "event_type = 'error' AS deleted")


_LOG = "SELECT user_id AS key, value, event_id AS commit_ts, event_type = 'error' AS deleted FROM events"


def mvcc_snapshot(spark, sf):
    return versions.snapshot(_log(spark, sf), ["key"], "commit_ts", "deleted", 5000)


def mvcc_compact(spark, sf):
    return versions.keep_newest(_log(spark, sf), ["key"], "commit_ts", 3).select("key", "commit_ts")


def occ_conflicts(spark, sf):
    reads = load(spark, sf, "events").where("event_type = 'view'").selectExpr("event_id AS txn", "user_id AS key", "event_id AS read_ts")
    commits = load(spark, sf, "events").where("event_type = 'purchase'").selectExpr("user_id AS key", "event_id AS commit_ts")
    return versions.point_conflicts(reads, commits)


def range_conflicts(spark, sf):
    ranges = load(spark, sf, "events").where("event_type = 'signup'").selectExpr("event_id AS txn", "user_id AS low", "user_id + 5 AS high", "event_id AS read_ts")
    commits = load(spark, sf, "events").where("event_type = 'error'").selectExpr("user_id AS key", "event_id AS commit_ts")
    return versions.range_conflicts(ranges, commits, 16)


def overlay_reads(spark, sf):
    base = load(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal AS value")
    buffer = load(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS value", "s_acctbal < 2000 AS gone")
    return versions.overlay(base, buffer, ["key"], "gone")


def _ops(spark, sf) -> DataFrame:
    kind = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'w' ELSE 'r' END AS kind"
    return load(spark, sf, "events").selectExpr("event_id AS txn", "user_id AS key", "event_id AS ord", kind, "CAST(floor(event_id / 100) AS BIGINT) AS epoch")


def aria_ww(spark, sf):
    return epochs.lost_writes(_ops(spark, sf))


def aria_rw(spark, sf):
    return epochs.read_write(_ops(spark, sf))


def aria_apply(spark, sf):
    rows = load(spark, sf, "events").where("event_type IN ('purchase', 'signup')").selectExpr("user_id AS key", "value", "event_id AS ord")
    return versions.merge_overlapping(rows, ["key"], "ord")


def epoch_merge(spark, sf):
    log = load(spark, sf, "events").selectExpr("event_id AS txn", "CAST(floor(event_id / 100) AS BIGINT) AS epoch", "user_id % 4 AS part", "event_id AS seq")
    return epochs.merged_order(log, "epoch", "part", "seq").select("txn", "epoch", "position")


def epoch_of_time(spark, sf):
    return load(spark, sf, "events").select("event_id", epochs.epoch(F.col("ts"), 10).alias("epoch"))


def shard_mod(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", epochs.shard(F.col("c_name"), 8).alias("shard"))


def shard_skew(spark, sf):
    return epochs.skew(shard_mod(spark, sf), "shard")


def bloom_exact(spark, sf):
    writes = load(spark, sf, "events").selectExpr("event_id AS txn", "user_id AS key", "CAST(ts AS TIMESTAMP) AS ts")
    return epochs.recent_writers(writes, 3600)


def _nodes(spark) -> DataFrame:
    return spark.createDataFrame([(f"node-{i}",) for i in range(5)], "node string")


def ring_route(spark, sf):
    return clocks.route(load(spark, sf, "customer").selectExpr("c_name AS key"), _nodes(spark), 150)


_RING = "SELECT 'node-' || n AS node, CAST(('0x' || substr(md5('node-' || n || ':' || v), 25, 8)) AS BIGINT) AS pos FROM range(5) a(n), range(150) b(v)"


def _versions(spark, sf) -> DataFrame:
    """Each event as a version of its user, written by the node of its type, whose counter grows by a thousand events."""
    clock = F.create_map("event_type", (F.floor(F.col("event_id") / 1000) + 1).cast("int"))
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), clock.alias("clock"), "event_type", F.col("ts"))


def _json(clock):
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clock))))


def vclock_compare(spark, sf):
    """Each version with the one before it of its key."""
    before = F.lag("clock").over(Window.partitionBy("key").orderBy("id"))
    pairs = _versions(spark, sf).withColumn("before", before).where("before IS NOT NULL")
    return pairs.select("id", clocks.compare(F.col("before"), F.col("clock")).alias("rel"), _json(clocks.merge(F.col("before"), F.col("clock"))).alias("merged"), _json(clocks.increment(F.col("clock"), F.lit("view"))).alias("bumped"))


def vclock_lww(spark, sf):
    return clocks.last_writer(_versions(spark, sf)).select("key", "id", F.col("n_siblings").cast("bigint").alias("n_siblings"))


def siblings(spark, sf):
    return clocks.siblings(_versions(spark, sf)).select("key", "id")


_VERSIONS = "SELECT event_id AS id, user_id AS key, event_type AS node, CAST(floor(event_id / 1000) + 1 AS BIGINT) AS n, ts FROM events"
_SIBLINGS = f"SELECT key, node, min(id) AS id FROM ({_VERSIONS}) v WHERE n = (SELECT max(floor(event_id / 1000) + 1) FROM events e WHERE e.user_id = v.key AND e.event_type = v.node) GROUP BY 1, 2"


def _engine(spark, sf) -> Engine:
    engine = Engine(spark, _root(spark))
    engine.execute("CREATE TABLE parties (id INTEGER PRIMARY KEY, name TEXT, balance REAL, code TEXT)")
    rows = load(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "CASE WHEN s_suppkey % 4 = 0 THEN 'none' ELSE CAST(s_suppkey + 0.5 AS STRING) END AS code")
    engine.table("parties").upsert(rows)
    return engine


def sql_dynamic_values(spark, sf):
    return _engine(spark, sf).sql("SELECT id, balance / (id % 3) AS share, round(balance) AS whole, trim(concat(' \t', name, '\n')) AS bare, CAST(code AS INTEGER) AS number, code * 2 AS twice FROM parties WHERE code > 3e0 OR code = 'none'")


def sql_any_value(spark, sf):
    return _engine(spark, sf).sql("SELECT id, id = ANY (SELECT NULLIF(n_nationkey, 3) FROM parties JOIN (SELECT id AS n_nationkey FROM parties WHERE id < 9) n ON true WHERE id = 1) AS among, id > ALL (SELECT id FROM parties WHERE id < 5) AS above FROM parties")


def sql_bound_update(spark, sf):
    engine = _engine(spark, sf)
    engine.execute("UPDATE parties SET NAME = :n, balance = balance * :f WHERE id % 3 = :r", n="it's", f=2, r=1)
    engine.execute("DELETE FROM parties WHERE code = :c", c="none")
    return engine.sql("SELECT id, name, balance FROM parties")


def sql_last_wins(spark, sf):
    engine = _engine(spark, sf)
    engine.execute("INSERT INTO parties (id, name) VALUES (1, 'first'), (1, 'second'), (2, 'only'), (1, 'third')")
    return engine.sql("SELECT id, name, balance FROM parties")


def analyze_row_size(spark, sf):
    found = _engine(spark, sf).analyze("parties")
    return spark.createDataFrame([(found["rows"], round(found["row_bytes"], 6))], "n long, row_bytes double")


_PARTIES = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey + 0.5 END AS code FROM supplier"


def quorum(spark, sf):
    acks = load(spark, sf, "events").selectExpr("CAST(floor(event_id / 3) AS BIGINT) AS op", "event_type <> 'error' AS ok")
    return clocks.quorum(acks, 3)


def gossip_state(spark, sf):
    beats = load(spark, sf, "events").selectExpr("user_id AS node", "event_id AS heartbeat", "CAST(event_id AS DOUBLE) / 100 AS seen_at")
    return clocks.membership(beats, 100.0)


def read_repair(spark, sf):
    replicas = load(spark, sf, "events").selectExpr("user_id AS key", "event_type AS node", "event_id AS version")
    newest = replicas.groupBy("key", "node").agg(F.max("version").alias("version"))
    return clocks.to_repair(newest, newest.groupBy("key").agg(F.max("version").alias("version")))


def hints(spark, sf):
    return clocks.live_hints(load(spark, sf, "events").selectExpr("event_id", "CAST(event_id AS DOUBLE) AS stored_at"), 9000.0, 3600.0).select("event_id")


def _monthly(spark, sf) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderstatus AS series", "CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS day", "CAST(o_totalprice AS DECIMAL(18,2)) AS p")
    return rows.groupBy("series", "day").agg(F.sum("p").cast("double").alias("value"))


_MONTHLY = "m AS (SELECT o_orderstatus AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"
_DAY = "date_format(day, 'yyyy-MM-dd') AS day"


def an_yoy(spark, sf):
    return series.pct_change(_monthly(spark, sf), "series", "day", "value", 12).selectExpr("series", _DAY, "pct")


def an_diff(spark, sf):
    return series.difference(_monthly(spark, sf), "series", "day", "value").selectExpr("series", _DAY, "round(diff, 2) AS diff")


def an_trend(spark, sf):
    return series.trend(_monthly(spark, sf), "series", "day", "value").select("series", F.round("change", 2).alias("change"), "trend")


def an_latest_prev(spark, sf):
    return series.latest(_monthly(spark, sf), "series", "day", "value").select("series", "latest", "previous", F.round("delta", 2).alias("delta"))


def an_normalized(spark, sf):
    return series.normalised(_monthly(spark, sf), "series", "day", "value").selectExpr("series", _DAY, "index_value")


def an_url_domain(spark, sf):
    return load(spark, sf, "pages").groupBy(compat.url_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def fn_trim_ws(spark, sf):
    return load(spark, sf, "part").select("p_partkey", compat.trim(F.concat(F.lit(" \t\n"), "p_name", F.lit("\n "))).alias("t"))


def fn_numeric(spark, sf):
    c = F.col("s_acctbal")
    return load(spark, sf, "supplier").select("s_suppkey", compat.ceil(c).alias("c"), compat.floor(c).alias("f"))


def fn_round(spark, sf):
    c = F.col("s_suppkey") + F.lit(0.5)
    return load(spark, sf, "supplier").select("s_suppkey", compat.rounded(c).alias("r"), compat.rounded(-c).alias("n"), compat.rounded(c, -2).alias("h"))


def fn_cast(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", compat.to_int(F.col("s_acctbal")).alias("i"), compat.to_int(F.lit("abc")).alias("bad"), compat.to_bool(F.when(F.col("s_suppkey") % 3 == 0, "Yes").when(F.col("s_suppkey") % 3 == 1, "f").otherwise("?")).alias("b"))


def compat_distinct(spark, sf):
    v = load(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("v"))
    return v.unionByName(v.select((F.col("v").cast("double") + 0).cast("int").cast("string").alias("v"))).agg(F.count_distinct(compat.identity(F.col("v"))).alias("n"))


def compat_order(spark, sf):
    v = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("code"))
    return v.orderBy(*compat.order_key(F.col("code")), "p_partkey").limit(40)


def compat_compare(spark, sf):
    return load(spark, sf, "part").where(compat.num(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("abc")) > 30).select("p_partkey")


def upsert_newest(spark, sf):
    from ..sources.landing import upsert

    e = load(spark, sf, "events").selectExpr("user_id", "event_type", "value", "event_id AS ingested_at")
    return upsert(e.where("ingested_at % 2 = 0"), e.where("ingested_at % 2 = 1"), ["user_id", "event_type"])


def incremental_load(spark, sf):
    from ..sources.landing import since

    rows = load(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus AS series_id", "CAST(o_orderdate AS DATE) AS observation_date")
    return since(rows, rows.where("o_orderkey % 50 = 0 AND series_id <> 'P'")).select("o_orderkey")


def thread_levels(spark, sf):
    from ..sources.landing import thread

    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey < 200 THEN 'story' ELSE 'comment' END AS type", "CASE WHEN o_orderkey >= 200 THEN CAST(floor(o_orderkey / 3) AS BIGINT) END AS parent")
    return thread(rows, 10)


def analyze_table(spark, sf):
    got = _orders_table(spark, sf).analyze()
    rows = [(n, got["rows"], c["nulls"], c["min"], c["max"]) for n, c in got["columns"].items() if n in ("status", "prio")]
    return spark.createDataFrame(rows, "column_name string, n long, nulls long, lo string, hi string")


def stream_tumbling(spark, sf):
    from .. import streaming

    root = _root(spark)
    load(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value").write.parquet(f"{root}/in")
    source = streaming.source(spark, f"{root}/in", "event_id long, ts timestamp, event_type string, value double")
    out = streaming.drain(streaming.tumbling(source, "ts", "1 day", "1 day", "event_type"), f"{root}/out", f"{root}/cp", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sliding(spark, sf):
    from .. import streaming

    root = _root(spark)
    load(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "value").write.parquet(f"{root}/in")
    source = streaming.source(spark, f"{root}/in", "ts timestamp, value double")
    out = streaming.drain(streaming.sliding(source, "ts", "2 days", "1 day", "1 day"), f"{root}/out", f"{root}/cp", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def stream_sessions(spark, sf):
    from .. import streaming

    root = _root(spark)
    load(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id").write.parquet(f"{root}/in")
    source = streaming.source(spark, f"{root}/in", "ts timestamp, user_id long")
    out = streaming.drain(streaming.sessions(source, "ts", "6 hours", "1 day", "user_id"), f"{root}/out", f"{root}/cp", "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events_n"))


def stream_replay(spark, sf):
    from .. import streaming

    root = _root(spark)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("source_ts", T.LongType())])
    table = VersionedTable.create(spark, root, "replayed", schema, ["key"])
    rows = load(spark, sf, "events").selectExpr("user_id AS key", "value", "event_id AS source_ts")
    for n in (2, 0, 1):
        rows.where(f"source_ts % 3 = {n}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streaming.replay(source, table, f"{root}/cp")
    return table.snapshot()


def wal_replay(spark, sf):
    from ..sources import wal

    root = _root(spark)
    rows = load(spark, sf, "events").select(F.col("event_id").alias("commit_ts"), F.map_from_arrays(F.array(F.concat(F.lit("k"), F.col("user_id").cast("string"))), F.array(F.when(F.col("event_type") != "error", F.col("event_id").cast("string")))).alias("ops"))
    wal.append(spark, rows, f"{root}/wal")
    spark.createDataFrame([("garbage",), ('{"ts": "x", "ops": {"evil": "1"}}',), ('{"ts": 99999999, "ops": [1]}',), ('{"ts": 99999999, "ops": {"torn"',)], "value string").write.mode("append").text(f"{root}/wal")
    return versions.snapshot(wal.entries(spark, f"{root}/wal"), ["key"], "commit_ts", "deleted")


#: name: (function, DuckDB SQL).
FRAMES = {
    "dml_insert": (dml_insert, f"SELECT * FROM ({_BASE}) WHERE id <> 0 UNION ALL SELECT -1, 'N', 1.5, NULL UNION ALL SELECT 0, 'N', 2.5, 'x'"),
    "dml_insert_select": (dml_insert_select, f"{_BASE} UNION ALL SELECT -id - 1, status, price, prio FROM ({_BASE}) WHERE status = 'P'"),
    "dml_update_case": (dml_update_case, f"SELECT id, status, CASE WHEN status = 'F' THEN CASE WHEN prio IS NULL THEN 0e0 ELSE price * 2e0 END ELSE price END AS price, CASE WHEN status = 'F' THEN status ELSE prio END AS prio FROM ({_BASE})"),
    "dml_delete": (dml_delete, f"SELECT * FROM ({_BASE}) WHERE NOT coalesce(prio NOT IN ('1-URGENT', '2-HIGH'), false)"),
    "dml_time_travel": (dml_time_travel, _BASE),
    "dml_compact": (dml_compact, f"SELECT * FROM ({_BASE}) WHERE status <> 'F'"),
    "mvcc_snapshot": (mvcc_snapshot, f"SELECT key, arg_max(value, commit_ts) AS value FROM ({_LOG}) WHERE commit_ts <= 5000 GROUP BY key HAVING NOT arg_max(deleted, commit_ts)"),
    "mvcc_compact": (mvcc_compact, f"SELECT key, commit_ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS r FROM ({_LOG})) WHERE r <= 3"),
    "occ_conflicts": (occ_conflicts, "SELECT event_id AS txn, user_id AS key, event_id AS read_ts, last_ts FROM events JOIN (SELECT user_id AS k, max(event_id) AS last_ts FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = k WHERE event_type = 'view' AND last_ts > event_id"),
    "range_conflicts": (range_conflicts, "SELECT r.event_id AS txn, c.user_id AS key, r.event_id AS read_ts, c.event_id AS commit_ts FROM events r JOIN events c ON c.user_id >= r.user_id AND c.user_id < r.user_id + 5 AND c.event_id > r.event_id WHERE r.event_type = 'signup' AND c.event_type = 'error'"),
    "overlay_reads": (overlay_reads, "SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT s_acctbal < 2000"),
    "aria_ww": (aria_ww, "SELECT event_id AS txn, user_id AS key FROM events e WHERE event_type IN ('purchase', 'signup') AND event_id < (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type IN ('purchase', 'signup'))"),
    "aria_rw": (aria_rw, "SELECT DISTINCT event_id AS txn, user_id AS key FROM events WHERE event_type NOT IN ('purchase', 'signup') AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup'))"),
    "aria_apply": (aria_apply, "SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS ord FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1"),
    "epoch_merge": (epoch_merge, "SELECT event_id AS txn, CAST(floor(event_id / 100) AS BIGINT) AS epoch, row_number() OVER (PARTITION BY floor(event_id / 100) ORDER BY user_id % 4, event_id) AS position FROM events"),
    "epoch_of_time": (epoch_of_time, "SELECT event_id, CAST(floor(epoch_us(ts) / 10000) AS BIGINT) AS epoch FROM events"),
    "shard_mod": (shard_mod, "SELECT c_custkey, CAST(('0x' || substr(md5(c_name), 1, 8)) AS BIGINT) % 8 AS shard FROM customer"),
    "shard_skew": (shard_skew, "SELECT round(stddev_pop(n) / avg(n) * 100, 4) AS cv_percent, count(*) AS shards FROM (SELECT CAST(('0x' || substr(md5(c_name), 1, 8)) AS BIGINT) % 8 AS s, count(*) AS n FROM customer GROUP BY 1)"),
    "bloom_exact": (bloom_exact, "SELECT event_id AS txn, user_id AS key FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND epoch_us(ts) - epoch_us(b) < 3600000000"),
    "ring_route": (ring_route, f"WITH r AS ({_RING}), k AS (SELECT c_name AS key, CAST(('0x' || substr(md5(c_name), 25, 8)) AS BIGINT) AS h FROM customer), f AS (SELECT key, h, min(pos) AS pos FROM k LEFT JOIN r ON pos > h GROUP BY key, h) SELECT key, node FROM f JOIN r ON r.pos = coalesce(f.pos, (SELECT min(pos) FROM r))"),
    "vclock_compare": (vclock_compare, f"SELECT id, CASE WHEN node <> p THEN 'CONCURRENT' WHEN n = pn THEN 'EQUAL' WHEN pn < n THEN 'BEFORE' ELSE 'AFTER' END AS rel, CASE WHEN node = p THEN '{{\"' || node || '\":' || greatest(n, pn) || '}}' WHEN p < node THEN '{{\"' || p || '\":' || pn || ',\"' || node || '\":' || n || '}}' ELSE '{{\"' || node || '\":' || n || ',\"' || p || '\":' || pn || '}}' END AS merged, CASE WHEN node = 'view' THEN '{{\"view\":' || (n + 1) || '}}' WHEN node < 'view' THEN '{{\"' || node || '\":' || n || ',\"view\":1}}' ELSE '{{\"view\":1,\"' || node || '\":' || n || '}}' END AS bumped FROM (SELECT *, lag(node) OVER w AS p, lag(n) OVER w AS pn FROM ({_VERSIONS}) WINDOW w AS (PARTITION BY key ORDER BY id)) WHERE p IS NOT NULL"),
    "vclock_lww": (vclock_lww, f"SELECT key, arg_max(s.id, (ts, s.id)) AS id, count(*) AS n_siblings FROM ({_SIBLINGS}) s JOIN events ON event_id = s.id GROUP BY key"),
    "siblings": (siblings, f"SELECT key, id FROM ({_SIBLINGS})"),
    "sql_dynamic_values": (sql_dynamic_values, f"SELECT id, balance / nullif(id % 3, 0) AS share, CAST(round(balance) AS BIGINT) AS whole, name AS bare, CAST(floor(code) AS BIGINT) AS number, CAST(code * 2 AS DOUBLE) AS twice FROM ({_PARTIES}) WHERE code > 3 OR code IS NULL"),
    "sql_any_value": (sql_any_value, f"SELECT id, CASE WHEN id < 9 AND id <> 3 THEN true END AS among, id > 4 AS above FROM ({_PARTIES})"),
    "sql_bound_update": (sql_bound_update, f"SELECT id, CASE WHEN id % 3 = 1 THEN 'it''s' ELSE name END AS name, CASE WHEN id % 3 = 1 THEN balance * 2 ELSE balance END AS balance FROM ({_PARTIES}) WHERE code IS NOT NULL"),
    "sql_last_wins": (sql_last_wins, f"SELECT id, CASE id WHEN 1 THEN 'third' WHEN 2 THEN 'only' ELSE name END AS name, CASE WHEN id NOT IN (1, 2) THEN balance END AS balance FROM ({_PARTIES})"),
    "analyze_row_size": (analyze_row_size, f"SELECT count(*) AS n, round(avg(length(CAST(id AS VARCHAR)) + length(name) + length(CAST(balance AS VARCHAR)) + length(coalesce(CAST(code AS VARCHAR), 'none'))), 6) AS row_bytes FROM ({_PARTIES})"),
    "quorum": (quorum, "SELECT op, acks, acks >= 1 AS one, acks >= 2 AS quorum, acks >= 3 AS all_of FROM (SELECT CAST(floor(event_id / 3) AS BIGINT) AS op, count(*) FILTER (event_type <> 'error') AS acks FROM events GROUP BY 1)"),
    "gossip_state": (gossip_state, "SELECT node, heartbeat, CASE WHEN 100 - heartbeat / 100 > 10 THEN 'DEAD' WHEN 100 - heartbeat / 100 > 5 THEN 'SUSPECT' ELSE 'ALIVE' END AS state FROM (SELECT user_id AS node, max(event_id) AS heartbeat FROM events GROUP BY 1)"),
    "read_repair": (read_repair, "SELECT n.key, node, version, wanted FROM (SELECT user_id AS key, event_type AS node, max(event_id) AS version FROM events GROUP BY 1, 2) n JOIN (SELECT user_id AS key, max(event_id) AS wanted FROM events GROUP BY 1) w USING (key) WHERE version <> wanted"),
    "hints": (hints, "SELECT event_id FROM events WHERE 9000 - event_id <= 3600"),
    "an_yoy": (an_yoy, f"WITH {_MONTHLY} SELECT series, strftime(day, '%Y-%m-%d') AS day, round((value / b - 1) * 100, 4) AS pct FROM (SELECT *, lag(value, 12) OVER (PARTITION BY series ORDER BY day) AS b FROM m) WHERE b IS NOT NULL"),
    "an_diff": (an_diff, f"WITH {_MONTHLY} SELECT series, strftime(day, '%Y-%m-%d') AS day, round(value - lag(value) OVER (PARTITION BY series ORDER BY day), 2) AS diff FROM m"),
    "an_trend": (an_trend, f"WITH {_MONTHLY}, d AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY day) AS diff, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM m) SELECT series, round(sum(diff), 2) AS change, CASE WHEN sum(diff) > 0 THEN 'up' WHEN sum(diff) < 0 THEN 'down' ELSE 'flat' END AS trend FROM d WHERE r <= 12 GROUP BY series"),
    "an_latest_prev": (an_latest_prev, f"WITH {_MONTHLY} SELECT series, value AS latest, b AS previous, round(value - b, 2) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY day) AS b, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM m) WHERE r = 1"),
    "an_normalized": (an_normalized, f"WITH {_MONTHLY} SELECT series, strftime(day, '%Y-%m-%d') AS day, round(value / first_value(value) OVER (PARTITION BY series ORDER BY day) * 100, 4) AS index_value FROM m"),
    "an_url_domain": (an_url_domain, r"SELECT coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1), 'www\.', '', 'g'), ''), 'self') AS domain, count(*) AS n FROM pages GROUP BY 1"),
    "fn_trim_ws": (fn_trim_ws, "SELECT p_partkey, p_name AS t FROM part"),
    "fn_numeric": (fn_numeric, "SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f FROM supplier"),
    "fn_round": (fn_round, "SELECT s_suppkey, s_suppkey + 1 AS r, -s_suppkey - 1 AS n, CAST(floor((s_suppkey + 50.5) / 100) * 100 AS BIGINT) AS h FROM supplier"),
    "fn_cast": (fn_cast, "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS i, CAST(NULL AS BIGINT) AS bad, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM supplier"),
    "compat_distinct": (compat_distinct, "SELECT count(DISTINCT p_size) AS n FROM part"),
    "compat_order": (compat_order, "SELECT p_partkey, CAST(p_size AS VARCHAR) AS code FROM part ORDER BY p_size, p_partkey LIMIT 40"),
    "compat_compare": (compat_compare, "SELECT p_partkey FROM part WHERE p_size > 30"),
    "upsert_newest": (upsert_newest, "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS ingested_at FROM events GROUP BY 1, 2"),
    "incremental_load": (incremental_load, "SELECT o_orderkey FROM orders LEFT JOIN (SELECT o_orderstatus AS s, max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderkey % 50 = 0 AND o_orderstatus <> 'P' GROUP BY 1) ON o_orderstatus = s WHERE d IS NULL OR CAST(o_orderdate AS DATE) >= d"),
    "thread_levels": (thread_levels, "WITH RECURSIVE t(root, id, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey < 200 UNION ALL SELECT root, o_orderkey, depth + 1 FROM t JOIN orders ON o_orderkey >= 200 AND CAST(floor(o_orderkey / 3) AS BIGINT) = t.id WHERE depth < 10) SELECT root, id, CAST(depth AS INTEGER) AS depth FROM t WHERE depth > 0"),
    "analyze_table": (analyze_table, f"SELECT 'status' AS column_name, count(*) AS n, count(*) FILTER (status IS NULL) AS nulls, min(status) AS lo, max(status) AS hi FROM ({_BASE}) UNION ALL SELECT 'prio', count(*), count(*) FILTER (prio IS NULL), min(prio), max(prio) FROM ({_BASE})"),
    "stream_tumbling": (stream_tumbling, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sliding": (stream_sliding, "SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM events) GROUP BY 1"),
    "stream_sessions": (stream_sessions, "SELECT user_id, CAST(sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS events_n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) GROUP BY 1"),
    "stream_replay": (stream_replay, "SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS source_ts FROM events GROUP BY 1"),
    "wal_replay": (wal_replay, "SELECT 'k' || user_id AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"),
}
