"""What the training-data operators share: staged tables, batches of bounded size, words."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the control characters 0x09 to 0x0D (a fixed value of the contract).
SEPARATORS = r"[\x20\x09-\x0D]+"
_ROOT = Path(__file__).resolve().parents[2]
BATCH = 8 << 20  # a batch stands several times in memory: in the JVM, on its way, in Python
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where neither is set, a new folder on this machine will do in local mode (tests) only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; ``release`` deletes what is there."""
    path = f"{shared_dir(spark)}/lakeloom-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for t in tables:
        if getattr(t, "staged_at", None) in _made:
            _delete(t.sparkSession, t.staged_at)


def made() -> list[str]:
    """Places of tables and files that operators have left in the shared folder."""
    return list(_made)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these (all) tables and files that operators left; results that need them can't be read any more."""
    for path in made() if paths is None else paths:
        if path in _made:
            _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not on their path already, and get batches of ``BATCH`` bytes.

    Spark's own limit is kept where somebody has set one.
    """
    if spark.conf.get(_BATCH_LIMIT, "64MB") in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(_BATCH_LIMIT, f"{BATCH}b")
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if app in _shipped or str(_ROOT) in on_path:
        return
    folder = tempfile.mkdtemp(prefix="lakeloom-zip-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lakeloom", "zip", _ROOT, "lakeloom"))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that a lambda does not evaluate it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """Let a task's Python worker, which Spark keeps for later tasks, give free memory back when its part is done."""

    @wraps(work)
    def run(*args, **more) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())  # keeps less of what is free than Arrow's own
        try:
            yield from work(*args, **more)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return run


def hold_memory() -> None:
    """Let this process keep up to 256 MB of free memory between allocations, instead of fetching pages anew for every array.

    ``tidy`` still gives it back at the end of a task.
    """
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):  # glibc only
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece hold about ``limit`` bytes (one row at least)."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        values = batch.column(column_at)
        per_row = max(1, values.nbytes // max(1, len(values)))
        step = max(1, limit // per_row)
        for start in range(0, len(values), step):
            yield batch.slice(start, step)
