"""The SQL front end: Spark SQL plus quantified comparisons and statements on versioned tables.

Queries go to Catalyst as they are.  CREATE TABLE, CREATE INDEX, DROP, INSERT, UPDATE, DELETE and ANALYZE
are carried out on versioned tables.  What Spark cannot analyse raises; nothing is dropped silently.

An engine has a session of its own, so its views are not seen by others, in which values follow the rules of
dynamically typed SQL: strings that look like numbers count as numbers, division by zero and casts of other
strings give NULL, TRIM takes all white space, and ROUND without digits gives a whole number.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import versions
from ..sources.versioned import GONE, Conflict, Folder, VersionedTable
from .quantified import closing, rewrite, tokens
from .strict import SqlError, UnsupportedSql, check_names, check_strict, engine_error

_TYPES = {"INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "TEXT": T.StringType(), "STRING": T.StringType(), "VARCHAR": T.StringType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


#: Functions whose names in a query stand for these; they are inlined, so they run like built-in ones.
_FUNCTIONS = (
    r"lakeloom_trim(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')",
    "lakeloom_round(x DOUBLE) RETURNS BIGINT RETURN CAST(round(x) AS BIGINT)",
)


def dynamic(sql: str) -> str:
    """TRIM without a side and ROUND without digits by the functions above."""
    toks = tokens(sql)
    for i, t in enumerate(toks):
        at = next((k for k in range(i + 1, len(toks)) if not toks[k].isspace()), None)
        if t.lower() not in ("trim", "round") or at is None or toks[at] != "(":
            continue
        inner = toks[at + 1 : closing(toks, at)]
        words = [x.upper() for x in inner if not x.isspace()]
        if len(_split(inner)) == 1 and not (t.lower() == "trim" and (words[:1] and words[0] in ("LEADING", "TRAILING", "BOTH") or "FROM" in words)):
            toks[i] = f"lakeloom_{t.lower()}"
    return "".join(toks)


def _sums_text(df: DataFrame, text: str) -> bool:
    """Whether SUM or AVG of strings is asked for: the analysed plan has casts there that the text has not."""
    made = re.findall(r"(?i)\b(?:sum|avg)\((?:distinct )?cast\(\S+ as double\)", df._jdf.queryExecution().analyzed().toString())
    return len(made) > len(re.findall(r"(?i)\b(?:sum|avg)\s*\(\s*(?:distinct\s+)?cast\s*\(", text))


def _starred(df: DataFrame, text: str) -> DataFrame:
    """The result of SELECT * over a join, in which names that collide are qualified by their table."""
    if len({c.lower() for c in df.columns}) == len(df.columns) or not re.match(r"(?is)\s*SELECT\s+\*\s+FROM\b", text):
        return df
    names = [c.lower() for c in df.columns]
    output = df._jdf.queryExecution().analyzed().output()
    made = []
    for n, name in enumerate(df.columns):
        qualifier = output.apply(n).qualifier()
        made.append(f"{qualifier.last()}.{name}" if names.count(name.lower()) > 1 and qualifier.size() else name)
    return df.toDF(*made)


def _split(toks: list[str]) -> list[str]:
    """Texts between the commas of the outermost level."""
    parts, depth, current = [], 0, []
    for t in toks:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            parts.append("".join(current).strip())
            current = []
        else:
            current.append(t)
    return [*parts, "".join(current).strip()]


class Engine:
    def __init__(self, spark: SparkSession, root: str, strict: bool = False):
        self.root, self.strict = root, strict
        self.spark = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                self.spark.conf.set(name, value)
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self._named: set[str] = set()
        for made in _FUNCTIONS:
            self.spark.sql(f"CREATE TEMPORARY FUNCTION {made}")

    # --- tables -----------------------------------------------------------------------------

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.root, name)

    def _own(self, name: str) -> VersionedTable:
        t = self.table(name)
        if not t.exists():
            raise SqlError(f"unknown table {name}")
        return t

    def create_table(self, name: str, schema: T.StructType, key: list[str]) -> VersionedTable:
        return VersionedTable.create(self.spark, self.root, name, schema, key)

    def create_index(self, table: str, name: str, column: str) -> None:
        self._own(table).create_index(name, column)

    def analyze(self, table: str) -> dict:
        return self._own(table).analyze()

    def _views(self, sql: str, txn: Txn | None = None) -> None:
        """Views of the tables that a statement can name; one listing says which there are."""
        there = set(Folder(self.spark, self.root).names(""))
        for name in set(re.findall(r"[A-Za-z_]\w*", sql)):
            if name in there and self.table(name).exists():
                (txn.read(name) if txn else self.table(name).snapshot()).createOrReplaceTempView(name)
            elif name in self._named:
                self.spark.catalog.dropTempView(name)
            self._named.add(name) if name in there else self._named.discard(name)

    # --- queries ----------------------------------------------------------------------------

    def sql(self, text: str, txn: Txn | None = None, **bound) -> DataFrame:
        """A query as a DataFrame; ``bound`` are named parameters (:name)."""
        if self.strict:
            check_strict(text)
        try:
            ready = dynamic(rewrite(text.strip().rstrip(";")))
            self._views(ready, txn)
            out = self.spark.sql(ready, args=bound or None)
            if _sums_text(out, ready):  # which must fail where a string is no number
                self.spark.conf.set("spark.sql.ansi.enabled", "true")
                try:
                    out = self.spark.sql(ready, args=bound or None)
                finally:
                    self.spark.conf.set("spark.sql.ansi.enabled", "false")
            if self.strict and "outer(" in out._jdf.queryExecution().analyzed().toString():
                raise UnsupportedSql("a correlated subquery is not supported")
            return check_names(_starred(out, ready))
        except (PySparkException, Py4JJavaError) as error:
            raise engine_error(error) from error

    def execute(self, text: str, txn: Txn | None = None, **bound) -> list[dict]:
        """Rows of a query, or the count of a change, as dicts."""
        toks = [t for t in tokens(text.strip().rstrip(";")) if not t.isspace()]
        verb = " ".join(toks[:2]).upper()
        if verb.startswith(("SELECT", "WITH", "( ", "VALUES", "FROM")):
            try:
                return [r.asDict() for r in self.sql(text, txn, **bound).collect()]
            except (PySparkException, Py4JJavaError) as error:
                raise engine_error(error) from error
        if self.strict:
            check_strict(text)
        text = text.strip().rstrip(";")
        for start, act in (("INSERT INTO", self._insert), ("UPDATE", self._update), ("DELETE FROM", self._delete), ("CREATE TABLE", self._create), ("CREATE INDEX", self._index), ("DROP TABLE", self._drop), ("ANALYZE", self._analyze)):
            if verb.startswith(start):
                try:
                    return act(text, txn, bound)
                except (PySparkException, Py4JJavaError) as error:
                    raise engine_error(error) from error
        raise UnsupportedSql(f"unsupported statement {verb}")

    def _create(self, text: str, txn, bound) -> list[dict]:
        m = re.match(r"(?is)CREATE\s+TABLE\s+(\w+)\s*\((.*)\)\s*$", text)
        if not m:
            raise SqlError("CREATE TABLE needs a column list")
        fields, key = [], []
        for part in _split(tokens(m[2])):
            if k := re.match(r"(?is)PRIMARY\s+KEY\s*\((.*)\)$", part):
                key = [c.strip() for c in k[1].split(",")]
                continue
            name, kind, rest = re.match(r"(?s)(\w+)\s+(\w+(?:\s*\([^)]*\))?)(.*)$", part).groups()
            base = re.sub(r"\s*\(.*", "", kind).upper()
            if base in ("DECIMAL", "NUMERIC"):
                digits = [int(x) for x in re.findall(r"\d+", kind)] or [38, 0]
                made: T.DataType = T.DecimalType(*digits)
            elif base in _TYPES:
                made = _TYPES[base]
            else:
                raise SqlError(f"unknown type {kind}")
            fields.append(T.StructField(name, made))
            if re.search(r"(?i)PRIMARY\s+KEY", rest):
                key.append(name)
        if not key:
            raise SqlError("a table needs a primary key")
        self.create_table(m[1], T.StructType(fields), key)
        return [{"count": 0}]

    def _index(self, text: str, txn, bound) -> list[dict]:
        m = re.match(r"(?is)CREATE\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)$", text)
        if not m:
            raise UnsupportedSql("an index has one column")
        self.create_index(m[2], m[1], m[3])
        return [{"count": 0}]

    def _drop(self, text: str, txn, bound) -> list[dict]:
        name = text.split()[-1]
        self._own(name).drop()
        self.spark.catalog.dropTempView(name)
        return [{"count": 0}]

    def _analyze(self, text: str, txn, bound) -> list[dict]:
        return [self.analyze(text.split()[-1])]

    def _insert(self, text: str, txn, bound) -> list[dict]:
        m = re.match(r"(?is)INSERT\s+INTO\s+(\w+)\s*(.*)$", text)
        table, rest = self._own(m[1]), m[2]
        toks = tokens(rest)
        columns = table.schema.names
        if toks[0] == "(":
            end = closing(toks, 0)
            inner = "".join(toks[1:end])
            if not re.match(r"(?is)\s*(SELECT|WITH|\()", inner):
                columns, rest = [c.strip() for c in inner.split(",")], "".join(toks[end + 1 :])
        if bad := set(columns) - set(table.schema.names):
            raise SqlError(f"unknown columns {sorted(bad)}")
        rest = dynamic(rewrite(rest))
        self._views(rest, txn)
        try:
            rows = self.spark.sql(rest, args=bound or None)
        except (PySparkException, Py4JJavaError) as error:
            raise engine_error(error) from error
        if len(rows.columns) != len(columns):
            raise SqlError(f"{len(columns)} columns, {len(rows.columns)} values")
        rows = rows.toDF(*columns)
        if missing := set(table.key) - set(columns):
            raise SqlError(f"key columns {sorted(missing)} are missing")
        return [{"count": self._write(table, table._typed(rows).withColumn(GONE, F.lit(False)), txn)}]

    def _write(self, table: VersionedTable, changes: DataFrame, txn: Txn | None) -> int:
        if txn:
            return txn.buffer(table.name, changes)
        own = Txn(self)
        count = own.buffer(table.name, changes)
        own.commit()
        return count

    def _target(self, name: str, txn: Txn | None) -> DataFrame:
        return txn.read(name) if txn else self._own(name).snapshot()

    def _hit(self, name: str, where: str | None, txn: Txn | None, bound: dict) -> DataFrame:
        condition = dynamic(rewrite(where)) if where else "true"
        self._views(condition + " " + name, txn)
        return self.spark.sql(f"SELECT * FROM {name} WHERE {condition}", args=bound or None)

    def _update(self, text: str, txn, bound) -> list[dict]:
        m = re.match(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*)$", text)
        if not m:
            raise SqlError("UPDATE needs a table and SET")
        table = self._own(m[1])
        names = {n.lower(): n for n in table.schema.names}
        toks, depth, at = tokens(m[2]), 0, None
        for i, t in enumerate(toks):
            depth += (t == "(") - (t == ")")
            if depth == 0 and t.upper() == "WHERE":
                at = i
                break
        where = "".join(toks[at + 1 :]) if at is not None else None
        assigned = {}
        for part in _split(toks[:at]):
            name, _, value = part.partition("=")
            assigned[names.get(name.strip().lower(), name.strip())] = dynamic(rewrite(value.strip()))
        if bad := set(assigned) - set(table.schema.names):
            raise SqlError(f"unknown columns {sorted(bad)}")
        if bad := set(assigned) & set(table.key):
            raise SqlError(f"key columns {sorted(bad)} can't be updated")
        hit = self._hit(m[1], where, txn, bound)
        self._views(" ".join(assigned.values()), txn)
        hit.createOrReplaceTempView("lakeloom_hit")
        columns = ", ".join(f"CAST({assigned.get(f.name, f'`{f.name}`')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in table.schema.fields)
        changed = self.spark.sql(f"SELECT {columns} FROM lakeloom_hit AS {m[1]}", args=bound or None)
        return [{"count": self._write(table, changed.withColumn(GONE, F.lit(False)), txn)}]

    def _delete(self, text: str, txn, bound) -> list[dict]:
        m = re.match(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text)
        if not m:
            raise SqlError("DELETE FROM needs a table, without an alias, and WHERE")
        table = self._own(m[1])
        return [{"count": self._write(table, self._hit(m[1], m[2], txn, bound).withColumn(GONE, F.lit(True)), txn)}]

    # --- transactions and conveniences ------------------------------------------------------

    def begin(self) -> Txn:
        return Txn(self)

    def insert(self, table: str, rows: list[dict]) -> int:
        t = self._own(table)
        made = self.spark.createDataFrame([[r.get(f.name) for f in t.schema.fields] for r in rows], t.schema)
        return self._write(t, made.withColumn(GONE, F.lit(False)), None)

    def select(self, table: str, where: str | None = None, **bound) -> list[dict]:
        return self.execute(f"SELECT * FROM {table}" + (f" WHERE {where}" if where else ""), **bound)

    def update(self, table: str, values: dict[str, str], where: str | None = None, **bound) -> int:
        """Set columns to expressions; ``bound`` are the values of :name in them and in ``where``."""
        sets = ", ".join(f"{c} = {e}" for c, e in values.items())
        return self.execute(f"UPDATE {table} SET {sets}" + (f" WHERE {where}" if where else ""), **bound)[0]["count"]

    def delete(self, table: str, where: str | None = None, **bound) -> int:
        return self.execute(f"DELETE FROM {table}" + (f" WHERE {where}" if where else ""), **bound)[0]["count"]

    def get_many(self, table: str, keys: list) -> DataFrame:
        """The rows of some keys (of a table with one key column)."""
        t = self._own(table)
        return t.snapshot().where(F.col(t.key[0]).isin(list(keys)))

    def exists(self, table: str, key) -> bool:
        return bool(self.get_many(table, [key]).limit(1).count())

    def execute_many(self, statements: list[str]) -> list[list[dict]]:
        return [self.execute(s) for s in statements]


class Txn:
    """Reads at fixed versions, sees its own writes, and commits if nothing it read has changed.

    A read of a table, or of a key range of it (``scan``), is validated against rows committed since; so are
    the keys it writes.  Read-only transactions always commit.
    """

    def __init__(self, engine: Engine):
        self.engine = engine
        self.at: dict[str, int] = {}
        self.buffers: dict[str, DataFrame] = {}
        self.whole: set[str] = set()
        self.ranges: dict[str, list[tuple]] = {}

    def _table(self, name: str) -> VersionedTable:
        t = self.engine._own(name)
        self.at.setdefault(name, t.manifest()["version"])
        return t

    def _state(self, name: str) -> DataFrame:
        t = self._table(name)
        base = t.snapshot(self.at[name])
        return versions.overlay(base, self.buffers[name], t.key, GONE) if name in self.buffers else base

    def read(self, name: str) -> DataFrame:
        self.whole.add(name)
        return self._state(name)

    def scan(self, name: str, low, high) -> DataFrame:
        """Rows whose (single) key is in [low, high)."""
        key = self._table(name).key[0]
        self.ranges.setdefault(name, []).append((low, high))
        return self._state(name).where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))

    def sql(self, text: str, **bound) -> DataFrame:
        return self.engine.sql(text, self, **bound)

    def execute(self, text: str, **bound) -> list[dict]:
        return self.engine.execute(text, self, **bound)

    def buffer(self, name: str, changes: DataFrame) -> int:
        t = self._table(name)
        if changes.where(" OR ".join(f"`{k}` IS NULL" for k in t.key)).limit(1).count():
            raise SqlError("a key column is null")
        path = f"{t.path}/data/pending-{uuid.uuid4().hex}"
        versions.last_of(changes, t.key).write.parquet(path)  # a fixed copy: later statements read what this one saw
        fixed = self.engine.spark.read.schema(changes.schema).parquet(path)
        if name in self.buffers:
            fixed_all = self.buffers[name].join(fixed.select(*t.key), t.key, "left_anti").unionByName(fixed)
        else:
            fixed_all = fixed
        self.buffers[name] = fixed_all
        return fixed.count()

    def _validate(self, name: str) -> int:
        """The version up to which nothing that was read or is written has changed; raises Conflict otherwise."""
        t, version = self.engine.table(name), self.at[name]
        now = t.manifest()["version"]
        if now == version:
            return now
        since = t.log(now, after=version)
        if name in self.whole:
            clash = since
        elif name in self.buffers:
            clash = since.join(self.buffers[name].select(*t.key), t.key, "left_semi")
        else:
            clash = since.limit(0)
        if clash.limit(1).count():
            raise Conflict(f"{name} changed after version {version}")
        for low, high in self.ranges.get(name, []):
            key = t.key[0]
            if since.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high))).limit(1).count():
                raise Conflict(f"{name}: a row in [{low}, {high}) changed after version {version}")
        return now

    def commit(self) -> bool:
        """Validate and publish; raises Conflict if a commit in between touched what this one read or writes.

        A table is published on the version that was validated; where another commit has taken the next one
        meanwhile, it is validated again.
        """
        if not self.buffers:
            return True
        valid = {name: self._validate(name) for name in self.at}
        for name, rows in self.buffers.items():
            while True:
                try:
                    self.engine.table(name).commit(rows, read_version=valid[name])
                    break
                except Conflict:
                    if self.engine.table(name).manifest()["version"] == valid[name]:
                        raise
                    valid[name] = self._validate(name)
        self.buffers = {}
        return True

    def rollback(self) -> None:
        self.buffers = {}
