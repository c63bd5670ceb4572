"""Best-fit packing of token pieces into sequences, planned on a histogram of lengths.

1. Documents are encoded once; a document longer than a sequence is cut into full pieces, the first
   one taking the remainder.  Only lengths, places and checksums are kept, in a table in the shared
   folder, where each piece also has the writing task and its rank among that task's pieces of the
   same length.
2. The histogram (at most ``capacity`` lengths, whatever the size of the input) goes to the driver,
   which packs counts: lengths from long to short, each to the fullest open sequences it fits in, as
   many at a time as there are.  The plan says, for ranges of ranks within a length, which sequences
   and which offset they get.
3. A piece's rank within its length is its rank in its task plus the counts of earlier tasks, so no
   task ever holds all pieces of one length.  The plan's ranges are unfolded into slots on the executors,
   and pieces take slots by a join on length and rank, of which each pair occurs once on either side.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
RANGE = 4096  # ranks that one row of the plan unfolds to at most
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity
    starts = [0] * (first > 0) + list(range(first, n, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n], strict=True)], strict=True))


@common.tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, task = tokens.encoder(path).encode, TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    names = [f.split(" ")[0] for f in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in common.slices(batches, "text", 1 << 20):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
            data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            for n, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                rank = seen.get(length, 0)
                seen[length] = rank + 1
                rows.append((doc_id, n, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, rank))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): these ranks take sequences from there on, one each.

    Best fit, decreasing: of the open sequences with room for a length, those with the least room.
    """
    rooms: list[int] = []  # sorted rooms of open sequences
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
    rows, sequences = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # new sequences, filled with this length alone
                full = max(1, left // each)
                used = min(each, left)
                for n in range(used):
                    rows.append((length, rank, full, sequences, n * length))
                    rank += full
                left -= full * used
                leave(capacity - used * length, sequences, full)
                sequences += full
                continue
            room = rooms[at]
            first, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            take = min(left, count)
            rows.append((length, rank, take, first, capacity - room))
            rank, left = rank + take, left - take
            leave(room - length, first, take)
            if take < count:
                leave(room, first + take, count - take)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def slots(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    """(length, rank, sequence_id, offset): one row for each place of the plan."""
    names = ["length", "first", "n", "sequence", "offset"]
    ranges = spark.createDataFrame(pa.table({name: rows[:, at] for at, name in enumerate(names)}))
    starts = ranges.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RANGE))).alias("from"))
    dealt = starts.repartition("length", "first", "from")  # a range of any size spreads over tasks
    each = dealt.select("*", F.explode(F.sequence("from", F.least(F.col("from") + RANGE, "n") - 1)).alias("at"))
    return each.select("length", (F.col("first") + F.col("at")).alias("rank"), (F.col("sequence") + F.col("at")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null and empty texts are documents of the end id alone.  Rows that repeat a doc_id, or have none,
    are documents each.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    # no shuffle: pieces are made where the texts are read, and only their lengths travel
    pieces = common.stage(docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, tokenizer, end_id, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    offsets = counts.withColumn("earlier", earlier).drop("count")
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank_in_task") + F.col("earlier"))
    placed = ranked.join(slots(spark, plan(histogram, capacity)), ["length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


SQL = None
