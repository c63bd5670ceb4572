"""Versions, logs, clocks, ingest and queries on small inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import compat
from lakeloom.operators import clocks, versions
from lakeloom.sources import landing, wal
from lakeloom.sources.versioned import Conflict, VersionedTable


def test_snapshot_reads_versions_in_any_order(spark):
    log = spark.createDataFrame([("k", "newest", 6, False), ("k", "older", 5, False), ("a", "x", 1, False), ("a", None, 4, True)], "key string, value string, ts long, gone boolean")
    at = lambda t: sorted(map(tuple, versions.snapshot(log, ["key"], "ts", "gone", t).collect()))
    assert at(10) == [("k", "newest")] and at(5) == [("k", "older")] and at(4) == [] and at(3) == [("a", "x")] and at(0) == []


def test_versioned_table_publishes_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    t = VersionedTable.create(spark, f"file://{tmp_path}", "t", schema, ["id"])
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], schema))
    with pytest.raises(Conflict):
        t.commit(t.snapshot().withColumn("deleted", F.lit(True)), read_version=0)
    with pytest.raises(ValueError):
        VersionedTable.create(spark, f"file://{tmp_path}", "t", schema, ["id"])
    os.makedirs(tmp_path / "t/data/orphan")  # a crash before its manifest leaves no trace
    assert t.update({"v": "concat(v, '!')"}, "id = 1") == 1 and t.delete("v = 'b'") == 1
    assert [tuple(r) for r in t.snapshot().collect()] == [(1, "a!")]
    assert sorted(map(tuple, t.snapshot(1).collect())) == [(1, "a"), (2, "b")]
    t.create_index("by_v", "v")
    t.compact()
    assert t.vacuum() >= 3 and [tuple(r) for r in t.snapshot().collect()] == [(1, "a!")]
    assert t.analyze()["rows"] == 1


def test_broken_log_lines_are_left_out(spark, tmp_path):
    lines = ['{"ts": 4, "ops": {"oar": "n4"}}', '{"ts": 3, "ops": {"rudder": "n3", "keel": "k"}}', '{"ts": true, "ops": {"hole": 1}}', '{"ts": 6, "ops": "hole"}', '{"ops": {"hole": 2}}', "# rust", '{"ts": 71, "ops": {"sail": "up", "keel": null}}', '{"ts": 80, "ops": {"rope"']
    (tmp_path / "wal.txt").write_text("\n".join(lines))
    got = versions.snapshot(wal.entries(spark, f"file://{tmp_path}/wal.txt"), ["key"], "commit_ts", "deleted")
    assert sorted(map(tuple, got.collect())) == [("oar", "n4"), ("rudder", "n3"), ("sail", "up")]
    assert wal.entries(spark, f"file://{tmp_path}/wal.txt", after=4).count() == 2


def test_half_a_manifest_is_never_seen(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    t = VersionedTable.create(spark, f"file://{tmp_path}", "t", schema, ["id"])
    (tmp_path / "t/_manifest/00000000000000000001.json.abc.tmp").write_text('{"version"')  # a crash while it was written aside
    t.upsert(spark.createDataFrame([(3,)], schema))
    assert t.versions() == [0, 1] and [r.id for r in t.snapshot().collect()] == [3]
    with pytest.raises(Conflict):
        t.folder.create("_manifest/00000000000000000001.json", "{}")
    assert len(list((tmp_path / "t/_manifest").glob("*.tmp"))) == 1


def test_ring_is_even(spark):
    nodes = spark.createDataFrame([(f"node-{i}",) for i in range(5)], "node string")
    keys = spark.range(10000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    counts = [r["count"] for r in clocks.route(keys, nodes, 150).groupBy("node").count().collect()]
    assert sum(counts) == 10000 and len(counts) == 5 and (max(counts) - min(counts)) / 10000 < 0.15


def test_landed_payloads(spark, tmp_path):
    folder = tmp_path / "obs/series_id=GDP"
    folder.mkdir(parents=True)
    rows = [{"date": "2024-01-01", "value": v, "realtime_start": "2024-01-01", "realtime_end": "2024-01-01"} for v in ("3.4", ".", "", "abc")]
    (folder / "a.json").write_text(json.dumps({"observations": rows, "count": 4}))
    good, bad = landing.observations(spark, f"file://{tmp_path}/obs")
    assert [(r.series_id, r.value) for r in good.collect()] == [("GDP", 3.4)] and bad.count() == 1
    items = [{"id": 1, "type": "story", "kids": [2, 3], "time": 5}] + [{"id": i, "type": "comment", "parent": i - 1, "time": i} for i in range(2, 15)]
    (tmp_path / "items").mkdir()
    (tmp_path / "items/a.json").write_text(json.dumps(items))
    got = landing.items(spark, f"file://{tmp_path}/items")
    assert sorted(map(tuple, landing.kids(got).collect())) == [(1, 2, 0), (1, 3, 1)]
    assert landing.thread(got).agg(F.max("depth"), F.count("id")).first() == (10, 10)
    twice = landing.upsert(good.withColumn("ingested_at", F.lit(1)), good.withColumn("ingested_at", F.lit(2)), ["series_id", "observation_date"])
    assert [r.ingested_at for r in twice.collect()] == [2]


def test_number_like_strings(spark):
    v = spark.createDataFrame([("10",), ("9",), ("1.0",), ("1",), ("abc",), ("NaN",), ("1d",), (" 2 ",), (None,)], "v string")
    assert v.select(compat.num(F.col("v")).alias("n")).where("n IS NOT NULL").count() == 5
    assert v.agg(F.count_distinct(compat.identity(F.col("v")))).first()[0] == 7
    assert [r.v for r in v.where("v IN ('10', '9', '1')").orderBy(*compat.order_key(F.col("v"))).collect()] == ["1", "9", "10"]


def test_streams_put_out_files(spark, tmp_path):
    """all rows of a stream's result went to the driver's memory."""
    from lakeloom import queries, streaming

    assert queries.queries()["stream_sessions"](spark, "/root/testdata/sf0.001").inputFiles()
    for n, hours in enumerate(([0, 1], [2, 20], [21, 40])):  # three batches, in order of time
        rows = spark.createDataFrame([(7, h) for h in hours], "user_id long, h int").selectExpr("user_id", "timestamp_seconds(h * 3600) AS ts")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    ordered = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = streaming.drain(streaming.sessions(ordered, "ts", "6 hours", "10 days", "user_id"), f"file://{tmp_path}/all", f"file://{tmp_path}/cp1", "complete")
    assert sorted(r.n for r in found.collect()) == [1, 2, 3]  # the last batch alone: earlier ones had parts of these
    plain = streaming.drain(ordered, f"file://{tmp_path}/plain", f"file://{tmp_path}/cp2")
    assert plain.columns == ["user_id", "ts"] and plain.count() == 6
    os.makedirs(f"{tmp_path}/none")
    nothing = spark.readStream.schema("user_id long").parquet(f"{tmp_path}/none")
    assert streaming.drain(nothing, f"file://{tmp_path}/no", f"file://{tmp_path}/cp3").collect() == []
