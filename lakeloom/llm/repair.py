"""Token-id files compressed by a Re-Pair grammar, with random access by document.

A shard is a run of documents in ascending id order.  Its ids are compressed by repeatedly replacing
the most frequent pairs of ids by new symbols (nonterminals), until no pair pays: a rule costs three
numbers and each replacement saves one, so a pair pays from ``PAYS`` places on.  Pairs never cross a
document's end, and a pair of equal symbols counts every second place of a run.

Pairs are replaced many at a time.  All with at least ``level`` places are candidates, and where two
overlap, the more frequent one wins; a candidate that keeps fewer than ``PAYS`` places waits.  The most
frequent one always keeps all of its own, so each pass makes a rule as long as some pair pays.  ``level``
falls by ``STEP`` when a pass gains less than a hundredth of the sequence, and at ``PAYS`` passes go on to the end.

Rules and the length of each nonterminal's expansion are stored next to the shortened sequence, so one
document is decoded from its own range of symbols alone, and a part of it by going down the grammar by
lengths, without decoding what stands before.

One shard is one row of a Parquet table; the grammar is one binary value in the format below (little
endian).  Spark writes and reads it, on any file system, under its commit protocol.

    magic "RPG2", u32 first nonterminal, u32 rules, u32 documents, u32 documents without id, u32 symbols
    rules: u32 left, u32 right; u32 expansion length
    documents, those without id last: i64 doc_id; u32 symbols before it; u32 tokens
    symbols: u32
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SHARD_BYTES = 4 << 20  # text bytes of one shard
PAYS = 4
STEP = 4  # how much fewer places the next candidates need; a smaller step takes more passes and saves under one per cent
SHORT = 64  # expansions up to this length are kept decoded while a shard is read
_MAGIC = b"RPG2"
_HALF = np.uint64(32)
_RIGHT = np.uint64(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _counted(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least ``least`` places, and their counts."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(keys)))
    enough = counts >= least
    return keys[starts[enough]], counts[enough]


def _counting(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the pair at each of these places counts; of a run of equal symbols all places are given, or none."""
    counts = np.ones(len(at), dtype=bool)
    equal = np.flatnonzero(keys >> _HALF == keys & _RIGHT)
    if len(equal):
        place = np.arange(len(equal))
        run = np.maximum.accumulate(np.where(np.diff(at[equal], prepend=-2) > 1, place, 0))
        counts[equal[(place - run) % 2 == 1]] = False
    return counts


def _pairs_of(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair at each place, and whether it counts there."""
    keys, inside = symbols[:-1] << _HALF | symbols[1:], np.ones(len(symbols) - 1, dtype=bool)
    inside[ends[(ends > 0) & (ends < len(symbols))] - 1] = False
    at = np.flatnonzero(inside)
    inside[at] = _counting(keys[at], at)
    return keys, inside


def _slots(keys: np.ndarray, pairs: int) -> np.ndarray:
    """A place for each key in a table for so many pairs."""
    return (keys * _MIX >> np.uint64(64 - _bits(pairs))).view(np.int64)


def _bits(pairs: int) -> int:
    return pairs.bit_length() + 3


def _winners(at: np.ndarray, keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of ``at``, which has ``keys``) where one of the pairs (the first is the strongest) stands and beats its neighbours, and which one."""
    table = np.full(1 << _bits(len(pairs)), -1, dtype=np.int32)
    table[_slots(pairs, len(pairs))[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)  # of two pairs of one slot the weaker one waits
    rule = table[_slots(keys, len(pairs))]
    some = np.flatnonzero(rule >= 0)
    rule = rule[some]
    real = pairs[rule] == keys[some]
    at, rule = at[some[real]], rule[real]
    if not len(at):
        return at, rule
    apart = np.diff(at) > 1  # from the next place with a pair
    stronger = rule[:-1] < rule[1:]
    wins = np.ones(len(at), dtype=bool)
    wins[1:] &= apart | ~stronger
    wins[:-1] &= apart | stronger
    return at[wins], rule[wins]


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol ends of documents, rules) of the ids of documents that end at ``ends``.

    A pair of two symbols that were there before a pass has no more places after it.  So once it has too few
    to pay it never pays again, and its places are ``open`` no longer: each pass looks at open places alone.
    """
    ends = ends.astype(np.int64)
    pairs_at = ids.astype(np.uint64) << _HALF  # a symbol and the next one; behind a document's last symbol any
    pairs_at[:-1] |= pairs_at[1:] >> _HALF
    rules, made, level = [np.empty(0, np.uint64)], first, 0
    open_ = np.ones(len(ids), dtype=bool)
    while len(pairs_at) > 1:
        open_[ends[ends > 0] - 1] = False  # pairs never cross a document's end
        at = np.flatnonzero(open_)
        keys = pairs_at[at]
        counts = _counting(keys, at)
        every, found = _counted(keys[counts], PAYS)
        if not len(every):
            break
        level = min(level or int(found.max()), int(found.max()))
        chosen = found >= level
        pairs = every[chosen][np.argsort(-found[chosen], kind="stable")]
        paying = np.zeros(1 << _bits(len(every)), dtype=bool)
        paying[_slots(every, len(every))] = True
        still = paying[_slots(keys, len(every))]
        open_[at[~still]] = False
        counts &= still
        at, rule = _winners(at[counts], keys[counts], pairs)
        pays = np.bincount(rule, minlength=len(pairs)) >= PAYS
        won = pays[rule]
        at, rule = at[won], rule[won]
        symbols = (np.cumsum(pays) + (made - 1)).astype(np.uint64)[rule]
        keep = np.ones(len(pairs_at), dtype=bool)
        keep[at + 1] = False
        pairs_at[at] = symbols << _HALF | pairs_at[at + 1] & _RIGHT
        inner = at > 0
        before = at[inner] - 1
        before -= ~keep[before]  # the next one to the left that stays
        pairs_at[before] = pairs_at[before] & ~_RIGHT | symbols[inner]
        open_[at] = open_[before] = True
        ends = ends - np.searchsorted(at + 1, ends)
        pairs_at, open_ = pairs_at[keep], open_[keep]
        rules.append(pairs[pays])
        made += int(pays.sum())
        if len(at) * 100 < len(pairs_at):
            level = max(PAYS, level // STEP)
    every = np.concatenate(rules)
    return (pairs_at >> _HALF).astype("<u4"), ends, np.stack((every >> _HALF, every & _RIGHT), axis=1).astype("<u4")


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    lengths = [1] * first
    for left, right in rules.tolist():
        lengths.append(lengths[left] + lengths[right])
    return np.array(lengths, dtype=np.int64)


def pack(doc_ids: list[int | None], parts: list[np.ndarray], first: int) -> bytes:
    """One shard; documents without id come last."""
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    symbols, ends, rules = compress(ids, np.cumsum(counts), first)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = _MAGIC + struct.pack("<5I", first, len(rules), len(parts), sum(d is None for d in doc_ids), len(symbols))
    lengths = expansion_lengths(rules, first)[first:]
    return head + b"".join(x.tobytes() for x in (rules, lengths.astype("<u4"), named, starts.astype("<u4"), counts.astype("<u4"), symbols))


class Shard:
    """A packed shard: decodes any document, or part of one, on its own."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token shard")
        self.first, n_rules, n_docs, n_null, n_symbols = struct.unpack_from("<5I", data, 4)
        at = 24
        taken = []
        for kind, n in (("<u4", 2 * n_rules), ("<u4", n_rules), ("<i8", n_docs), ("<u4", n_docs), ("<u4", n_docs), ("<u4", n_symbols)):
            taken.append(np.frombuffer(data, kind, n, at))
            at += taken[-1].nbytes
        if at != len(data):
            raise ValueError("token shard is cut short or too long")
        rules, lengths, self._ids, starts, self.counts, self.symbols = taken
        self.named = n_docs - n_null
        self.bounds = np.append(starts.astype(np.int64), n_symbols)
        self.rules = rules.reshape(-1, 2)
        self.lengths = np.concatenate((np.ones(self.first, np.int64), lengths.astype(np.int64)))
        self._pool: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def doc_ids(self) -> pa.Array:
        return pa.array(self._ids, mask=np.arange(len(self._ids)) >= self.named)

    def _split(self, symbols: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Each of the symbols at ``which`` replaced by the two of its rule."""
        at = np.flatnonzero(which)
        out = np.repeat(symbols, 1 + which)
        places = at + np.arange(len(at))
        out[places], out[places + 1] = self.rules[symbols[at] - self.first].T
        return out

    def _short(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of rules up to ``SHORT`` ids, and where each starts."""
        if self._pool is None:
            own = np.where(self.lengths[self.first :] <= SHORT, self.lengths[self.first :], 0)
            pool = (np.flatnonzero(own) + self.first).astype("<u4")
            while (grown := pool >= self.first).any():
                pool = self._split(pool, grown)
            self._pool = np.cumsum(own) - own, pool
        return self._pool

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while (long := self.lengths[symbols] > SHORT).any():
            symbols = self._split(symbols, long)
        each = self.lengths[symbols]
        out = np.repeat(symbols, each).astype("<u4")
        ruled = np.flatnonzero(symbols >= self.first)
        if len(ruled):
            pool_at, pool = self._short()
            own = each[ruled]
            from_pool = np.repeat(pool_at[symbols[ruled] - self.first] - np.cumsum(own) + own, own)
            out[out >= self.first] = pool[from_pool + np.arange(len(from_pool))]
        return out

    def document(self, at: int) -> np.ndarray:
        return self.expand(self.symbols[self.bounds[at] : self.bounds[at + 1]])

    def part(self, at: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive) of a document, found by expansion lengths."""
        symbols = self.symbols[self.bounds[at] : self.bounds[at + 1]]
        ends = np.cumsum(self.lengths[symbols])
        start, stop = max(0, start), min(stop, int(self.counts[at]))
        if start >= stop:
            return np.empty(0, "<u4")
        low, high = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        todo = [(int(symbols[n]), int(ends[n] - self.lengths[symbols[n]])) for n in range(high, low - 1, -1)]
        whole: list[int] = []
        while todo:  # symbols that reach out of the range are replaced by those of their rules
            symbol, begin = todo.pop()
            end = begin + int(self.lengths[symbol])
            if end <= start or begin >= stop:
                continue
            if start <= begin and end <= stop:
                whole.append(symbol)
                continue
            left, right = (int(x) for x in self.rules[symbol - self.first])
            todo += [(right, begin + int(self.lengths[left])), (left, begin)]
        return self.expand(np.array(whole, dtype="<u4"))

    def documents(self) -> Iterator[np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum(self.counts.astype(np.int64))))
        ids = self.expand(self.symbols)
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]


_SHARDS = "part int, number int, first_doc long, last_doc long, n_docs long, n_symbols long, n_tokens long, grammar binary"
_DOCS = "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


@common.tidy
def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, first: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    common.hold_memory()
    encode, part, number = tokens.encoder(path).encode, TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    parts: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch:
        named = [d for d in doc_ids if d is not None]
        data = pack(doc_ids, parts, first)
        n_symbols = struct.unpack_from("<I", data, 20)[0]
        return _batch(_SHARDS, [[part], [number], [named[0] if named else None], [named[-1] if named else None], [len(parts)], [n_symbols], [sum(map(len, parts))], [data]])

    for whole in common.slices(batches, "text", SHARD_BYTES):  # the more text at once, the fewer different words
        found = iter(encode(whole.column("text")))
        for piece in common.slices(iter([whole]), "text", SHARD_BYTES // 4):
            doc_ids += piece.column("doc_id").to_pylist()
            parts += [np.append(x, np.uint32(end_id)) for x in islice(found, len(piece))]
            size += piece.column("text").nbytes
            if size >= SHARD_BYTES:
                yield shard()
                doc_ids, parts, size, number = [], [], 0, number + 1
    if doc_ids:
        yield shard()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, first: int) -> None:
    """Encode ``docs`` and write shards in ascending doc_id order.

    Null texts are empty; every document ends with ``end_id``.  Rows that repeat a doc_id are documents
    each, next to each other; those without one come last.  ``first`` is the first nonterminal: any
    number above all token ids.  Other columns are ignored; an empty table gives no shard.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("body"), F.col("row")]  # a hot id, or none, spreads by text and row
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("body"), F.monotonically_increasing_id().alias("row"))
    dealt = named.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(lambda b: _write(b, tokenizer, end_id, first), _SHARDS).write.option("compression", "zstd").parquet(path)


@common.tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.hold_memory()
    for batch in batches:
        for part, number, data in zip(*(batch.column(c) for c in ("part", "number", "grammar")), strict=True):
            shard = Shard(data.as_py())
            n = len(shard.counts)
            sums = [zlib.crc32(ids.tobytes()) for ids in shard.documents()]
            counts = shard.counts.astype(np.int64)
            yield _batch(_DOCS, [np.full(n, part.as_py()), np.full(n, number.as_py()), shard.doc_ids, np.cumsum(counts) - counts, counts, sums])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, decoded from the files.

    ``start`` needs the tokens of each part, one number for each task of the writer, and sums over the
    shards of a part.
    """
    common.ship(spark)
    shards = spark.read.schema(_SHARDS).parquet(path)
    before, sums = 0, []
    for row in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # as many rows as the writer had tasks
        sums.append((row["part"], before))
        before += row["n"]
    parts = F.broadcast(spark.createDataFrame(sums, "part int, before long"))
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select("part", "number", earlier.alias("earlier")).join(parts, "part").select("part", "number", (F.col("earlier") + F.col("before")).alias("before"))
    docs = shards.select("part", "number", "grammar").mapInArrow(_read, _DOCS)
    return docs.join(offsets, ["part", "number"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int], start: int = 0, stop: int = 1 << 31) -> DataFrame:
    """(doc_id, ids): ids ``start`` to ``stop`` of some documents; only shards that can hold them are read."""
    common.ship(spark)
    asked = sorted(set(doc_ids))
    near = F.exists(F.array(*[F.lit(d) for d in asked]).cast("array<bigint>"), lambda d: (d >= F.col("first_doc")) & (d <= F.col("last_doc")))
    shards = spark.read.schema(_SHARDS).parquet(path)
    held = shards.where((F.col("first_doc") <= asked[-1]) & (F.col("last_doc") >= asked[0]) & near) if asked else shards.where(F.lit(False))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("grammar"):
                shard = Shard(data.as_py())
                at = np.flatnonzero(np.isin(shard._ids[: shard.named], asked))
                ids = pa.array([shard.part(n, start, stop).tolist() for n in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard._ids[at]), ids], names=["doc_id", "ids"])

    return held.select("grammar").mapInArrow(found, "doc_id long, ids array<long>")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "ids")
    write_shards(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("word_bpe_49k.json"), end_id=1, first=1 << 16)
    return read_shards(spark, path)


SQL = None
