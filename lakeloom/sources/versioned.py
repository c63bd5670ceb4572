"""Versioned tables on immutable Parquet files.

A table is a folder.  Each commit adds a folder of changed rows (with ``commit_ts`` and ``deleted``) and then
a manifest file whose name is the next version.  The manifest is written aside and then named, which fails
if the name is taken: of two writers one wins, and no reader sees half a manifest.  (Naming is a hard link on
a local file system and a rename without overwrite elsewhere, which is atomic on HDFS; an object store needs a
committer that refuses to overwrite.)  Data folders without a manifest are never read: a crash leaves no
trace.  A snapshot is the newest row of each key at or before a version, without deleted ones.  Only changed
rows are written; ``compact`` leaves the newest row of each key, with the version that wrote it, and
``vacuum`` drops versions that nobody may read any more.
"""

from __future__ import annotations

import json
import operator
import time
import uuid
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import versions

TS, GONE = "commit_ts", "deleted"


class Conflict(RuntimeError):
    """Another commit came first."""


class Folder:
    """Small files of any Hadoop file system, through the driver's JVM."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, name: str, text: str) -> None:
        """A new file with this text, all at once; Conflict if the name is taken."""
        path, aside = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs = path.getFileSystem(self.conf)
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                files, paths = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Paths
                files.createLink(paths.get(path.toUri().getPath(), self._strings()), paths.get(aside.toUri().getPath(), self._strings()))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
                context.rename(aside, path, self._options())
        except Exception as error:
            if fs.exists(path):
                raise Conflict(f"{name} is there already") from error
            raise
        finally:
            fs.delete(aside, False)

    def _strings(self):
        return SparkContext._active_spark_context._gateway.new_array(self.jvm.java.lang.String, 0)

    def _options(self):
        return SparkContext._active_spark_context._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def read(self, name: str) -> str:
        path = self._path(name)
        stream = path.getFileSystem(self.conf).open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self.conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.conf).delete(path, True)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self.folder = Folder(spark, self.path)

    # --- manifests --------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("_manifest") if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        there = self.versions()
        if not there:
            raise ValueError(f"no table {self.name}")
        wanted = max((v for v in there if version is None or v <= version), default=None)
        if wanted is None:
            raise ValueError(f"{self.name} has no version {version}")
        return json.loads(self.folder.read(f"_manifest/{wanted:020d}.json"))

    def _publish(self, manifest: dict) -> int:
        self.folder.create(f"_manifest/{manifest['version']:020d}.json", json.dumps(manifest))
        return manifest["version"]

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, schema: T.StructType, key: list[str]) -> VersionedTable:
        table = cls(spark, root, name)
        if table.exists():
            raise ValueError(f"table {name} exists")
        if missing := set(key) - set(schema.names):
            raise ValueError(f"unknown key columns {sorted(missing)}")
        table._publish({"version": 0, "schema": schema.jsonValue(), "key": key, "data": [], "indexes": {}, "at": time.time()})
        return table

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()["schema"])

    @property
    def key(self) -> list[str]:
        return self.manifest()["key"]

    # --- reading ----------------------------------------------------------------------------

    def log(self, version: int | None = None, after: int = -1) -> DataFrame:
        """All versions of rows, with commit_ts and deleted."""
        m = self.manifest(version)
        schema = T.StructType([*T.StructType.fromJson(m["schema"]).fields, T.StructField(TS, T.LongType()), T.StructField(GONE, T.BooleanType())])
        paths = [f"{self.path}/{d['path']}" for d in m["data"] if d["last"] > after]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        rows = rows.where(F.col(TS) > after) if after >= 0 else rows
        return rows if version is None else rows.where(F.col(TS) <= version)

    def snapshot(self, version: int | None = None) -> DataFrame:
        return versions.snapshot(self.log(version), self.key, TS, GONE, version)

    # --- writing ----------------------------------------------------------------------------

    def commit(self, changes: DataFrame, read_version: int | None = None) -> int:
        """Add changed rows (the schema's columns and ``deleted``) as the next version."""
        m = self.manifest()
        if read_version is not None and m["version"] != read_version:
            raise Conflict(f"{self.name} moved from version {read_version} to {m['version']}")
        version = m["version"] + 1
        path = f"data/{version:020d}-{uuid.uuid4().hex}"
        names = [*T.StructType.fromJson(m["schema"]).names]
        changes.select(*names, F.lit(version).cast("long").alias(TS), GONE).write.parquet(f"{self.path}/{path}")
        return self._publish(m | {"version": version, "data": [*m["data"], {"path": path, "last": version}], "at": time.time()})

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def upsert(self, rows: DataFrame) -> int:
        """Insert; a row with a key that is there replaces the old one.  Of equal keys in ``rows`` the last is taken."""
        typed = self._typed(rows)
        if typed.where(" OR ".join(f"`{k}` IS NULL" for k in self.key)).limit(1).count():
            raise ValueError("a key column is null")
        changes = versions.last_of(typed, self.key).withColumn(GONE, F.lit(False))
        while True:  # what it writes does not depend on what is there, so it only has to come after the others
            try:
                return self.commit(changes)
            except Conflict:
                continue

    def update(self, assignments: dict[str, str], where: str = "true") -> int:
        """SET from one state of each row; returns the number of rows.  Keys can't change."""
        if bad := set(assignments) & set(self.key):
            raise ValueError(f"key columns {sorted(bad)} can't be updated")
        if bad := set(assignments) - set(self.schema.names):
            raise ValueError(f"unknown columns {sorted(bad)}")
        version = self.manifest()["version"]
        hit = self.snapshot(version).where(where)
        changed = hit.select(*[(F.expr(assignments[f.name]).cast(f.dataType) if f.name in assignments else F.col(f.name)).alias(f.name) for f in self.schema.fields])
        count = hit.count()
        if count:
            self.commit(changed.withColumn(GONE, F.lit(False)), version)
        return count

    def delete(self, where: str = "true") -> int:
        """Only rows for which the condition is definitely true go."""
        version = self.manifest()["version"]
        hit = self.snapshot(version).where(where)
        count = hit.count()
        if count:
            self.commit(hit.withColumn(GONE, F.lit(True)), version)
        return count

    def create_index(self, name: str, column: str) -> None:
        """Recorded; scans prune by Parquet statistics, and ``compact`` sorts files by indexed columns."""
        m = self.manifest()
        if name in m["indexes"]:
            raise ValueError(f"index {name} exists")
        if column not in self.schema.names:
            raise ValueError(f"unknown column {column}")
        self._publish(m | {"version": m["version"] + 1, "indexes": m["indexes"] | {name: column}})

    def compact(self, forget: int = -1) -> int:
        """Rewrite as one folder the newest row of each key, with its own version; earlier versions can't be
        read from the new manifest on.  Deleted rows stay marked, so that open transactions see them go, but
        for those deleted at or before version ``forget``."""
        m = self.manifest()
        version, path = m["version"] + 1, f"data/{m['version'] + 1:020d}-{uuid.uuid4().hex}"
        rows = versions.newest(self.log(m["version"]), m["key"], TS).where(~F.col(GONE) | (F.col(TS) > forget))
        if m["indexes"]:
            rows = rows.sortWithinPartitions(*m["indexes"].values())
        rows.write.parquet(f"{self.path}/{path}")
        return self._publish(m | {"version": version, "data": [{"path": path, "last": version}], "at": time.time()})

    def vacuum(self) -> int:
        """Delete data folders that the newest manifest does not name, and older manifests."""
        m = self.manifest()
        named = {d["path"].split("/")[1] for d in m["data"]}
        gone = [n for n in self.folder.names("data") if n not in named]
        for n in gone:
            self.folder.delete(f"data/{n}")
        for v in self.versions():
            if v < m["version"]:
                self.folder.delete(f"_manifest/{v:020d}.json")
        return len(gone)

    def drop(self) -> None:
        self.folder.delete("")

    def analyze(self) -> dict:
        """Rows, their average bytes as text and, for each column, distinct values, nulls, least and greatest, in one pass."""
        names = self.schema.names
        exprs = [F.count(F.lit(1)).alias("rows")]
        for n in names:
            c = F.col(f"`{n}`")
            exprs += [F.approx_count_distinct(c).alias(f"{n}.ndv"), F.count_if(c.isNull()).alias(f"{n}.nulls"), F.min(c.cast("string")).alias(f"{n}.min"), F.max(c.cast("string")).alias(f"{n}.max")]
        sizes = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(0)) for n in names]
        exprs.append(F.avg(reduce(operator.add, sizes)).alias("row_bytes"))
        row = self.snapshot().agg(*exprs).first()
        return {"rows": row["rows"], "row_bytes": row["row_bytes"], "columns": {n: {k: row[f"{n}.{k}"] for k in ("ndv", "nulls", "min", "max")} for n in names}}
