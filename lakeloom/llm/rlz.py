"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A word is removed if a window of 20 words around it also starts earlier in the corpus.

Index.  Each window has an anchor: the least hash among its 4-word grams.  Consecutive windows with
the same anchor form a block, about nine windows long.  Where a passage occurs again, its windows have
the same anchors there, so blocks can be looked up by content, whatever the offset.  The earliest
occurrence of a block's content is its reference: the index has its document and place.

Parsing.  A document is factored from left to right: a block that the index has at an earlier place starts
a factor with that place as its source, and the factor goes on as long as the next window's source is the
next place of the same document.  A factor is (start, words, source document, source start); it has 20
words or more by construction and becomes a duplicate span.  At a factor's ends a block may be copied in
part: it has the anchor of a reference but other words around it, so its content is new.  Anchors with
more than one content are therefore checked at that boundary: windows of the earliest block of each such
content are compared one by one, and those that start earlier make factors too, whose source is not kept.
Windows are equal if the 64-bit hashes of their words and of their anchors both are.

What travels: one row of fixed size for each block, references of copied blocks, windows of blocks at
factor ends, and each text once, packed.  Copies among the texts that a task holds at a time are found
there, so a passage that many documents share is a row for each such batch, not for each document.  A row is named by its number in the table, so rows that repeat a
doc_id, or have none, are told apart.  The table must give its rows in the same order when it is read
again, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 20
GRAM = 4
_SLICE = 1 << 20  # bytes of text at a time; hashing takes some fifty times as much memory


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64))
_PLACE = mixed(np.arange(1000, 1000 + WINDOW, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts, in order; words are runs of bytes other than 0x20 and 0x09 to 0x0D."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starting = inside.copy()
    starting[1:] &= ~inside[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    starting[heads] = inside[heads]  # a text's first byte starts a word even if the byte before is part of one
    starts = np.flatnonzero(starting)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    number = np.cumsum(starting) - 1
    place = np.arange(len(raw)) - starts[np.maximum(number, 0)]
    terms = _BYTE[raw] * (mixed(place.astype(np.uint64)) | np.uint64(1))
    terms[~inside] = 0
    return mixed(np.add.reduceat(terms, starts)), np.searchsorted(bounds, starts, side="right") - 1


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += values[k : k + n] * _PLACE[k]
    return mixed(out)


class Blocks:
    """Windows and blocks of a batch of texts."""

    def __init__(self, texts: pa.Array):
        words, self.text_of_word = word_hashes(texts)
        self.first_word = np.searchsorted(self.text_of_word, np.arange(len(texts) + 1))
        n = max(0, len(words) - WINDOW + 1)
        whole = self.text_of_word[:n] == self.text_of_word[WINDOW - 1 : WINDOW - 1 + n]
        self.at = np.flatnonzero(whole)  # word numbers where a window starts
        least = _rolled(words, GRAM)
        have, want = 1, WINDOW - GRAM + 1
        while 2 * have <= want:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < want and len(least) > want - have:
            least = np.minimum(least[: -(want - have)], least[want - have :])
        self.anchors = least[self.at] if len(self.at) else np.empty(0, np.uint64)
        self.windows = _rolled(words, WINDOW)[self.at] if len(self.at) else np.empty(0, np.uint64)
        self.text = self.text_of_word[self.at]
        self.start = self.at - self.first_word[self.text]  # within its text
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (np.diff(self.at) > 1) | (np.diff(self.text) > 0) | (self.anchors[1:] != self.anchors[:-1])
        self.heads = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.heads, len(self.at)))
        if len(self.heads):
            block = np.cumsum(new) - 1
            place = np.arange(len(self.at)) - self.heads[block]
            self.contents = mixed(np.add.reduceat(self.windows * (mixed(place.astype(np.uint64)) | np.uint64(1)), self.heads) + self.sizes.astype(np.uint64))
            self.block = block
        else:
            self.contents, self.block = np.empty(0, np.uint64), np.empty(0, np.int64)

    def repeating(self) -> np.ndarray:
        """Blocks that hold one of their windows twice, as periodic text does."""
        keys = self.windows ^ mixed(self.block.astype(np.uint64))
        order = np.sort(keys)
        again = order[1:][order[1:] == order[:-1]]
        return np.unique(self.block[np.isin(keys, again)]) if len(again) else np.empty(0, np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


@common.tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, which travel in two thirds of the space."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for piece in (p for b in batches for p in common.slices(iter([b]), "text")):
        packed = pa.array([None if t is None else pack(t.encode()) for t in piece.column("text").to_pylist()], pa.binary())
        at = piece.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([packed if n == at else c for n, c in enumerate(piece.columns)], names=piece.schema.names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for piece in (p for b in batches for p in common.slices(iter([b]), "text", _SLICE // 2)):
        texts = pa.array([None if t is None else unpack(t) for t in piece.column("text").to_pylist()], pa.large_binary()).cast(pa.large_string())
        at = piece.schema.get_field_index("text")
        whole = pa.RecordBatch.from_arrays([texts if n == at else c for n, c in enumerate(piece.columns)], names=piece.schema.names)
        yield from common.slices(iter([whole]), "text", _SLICE)


def _nearest(anchors: np.ndarray, contents: np.ndarray, docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each block, the earliest of these blocks with its anchor and content."""
    out = np.arange(len(anchors))
    name = contents ^ mixed(anchors)
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    several = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    if len(several):
        several = several[np.lexsort((starts[several], rows[several], docs[several], contents[several], anchors[several]))]
        new = np.ones(len(several), dtype=bool)
        new[1:] = (np.diff(anchors[several]) != 0) | (np.diff(contents[several]) != 0)
        out[several] = several[np.maximum.accumulate(np.where(new, np.arange(len(several)), 0))]
    return out


_BLOCKS = "anchor long, content long, doc_id long, row long, start int, source_id long, source_start int"


@common.tidy
def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to look up.  One that stands earlier among the texts at hand has its source already: it is named
    by its own place instead of its anchor, so that a passage in every document is no hot key."""
    for piece in _unpacked(batches):
        b = Blocks(piece.column("text"))
        docs, rows = (np.asarray(piece.column(c), dtype=np.int64) for c in ("doc_id", "row"))
        # a block that repeats inside gets a second content, so that it is looked at window by window
        twice = b.repeating()
        h = np.concatenate((b.heads, b.heads[twice]))
        contents = np.concatenate((b.contents, ~b.contents[twice]))
        anchors, docs, rows, start = b.anchors[h], docs[b.text[h]], rows[b.text[h]], b.start[h]
        source = _nearest(anchors, contents, docs, rows, start)
        own = source == np.arange(len(source))
        anchors = np.where(own, anchors, mixed(mixed(rows.astype(np.uint64)) ^ start.astype(np.uint64)))
        contents[~own] = 0
        made = [_signed(anchors), _signed(contents), pa.array(docs), pa.array(rows), pa.array(start.astype(np.int32)), pa.array(docs[source], mask=own), pa.array(start[source].astype(np.int32), mask=own)]
        yield pa.RecordBatch.from_arrays(made, names=[f.split(" ")[0] for f in _BLOCKS.split(", ")])


@common.tidy
def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the blocks that a text's list of starts names."""
    for piece in _unpacked(batches):
        b = Blocks(piece.column("text"))
        docs, rows = (np.asarray(piece.column(c), dtype=np.int64) for c in ("doc_id", "row"))
        if not len(piece.column("mixed").flatten()):
            continue
        named = _marked(b, piece.column("mixed"), b.start[b.heads], b.text[b.heads])
        pick = np.repeat(named, b.sizes)
        yield pa.RecordBatch.from_arrays([_signed(b.anchors[pick]), _signed(b.windows[pick]), pa.array(docs[b.text[pick]]), pa.array(rows[b.text[pick]]), pa.array(b.start[pick].astype(np.int32))], names=["anchor", "window", "doc_id", "row", "start"])


def _marked(b: Blocks, lists: pa.ListArray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which (text, start) pairs are in the texts' lists."""
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    keys = np.repeat(np.arange(len(lengths)), lengths) << 32 | np.asarray(lists.flatten(), dtype=np.int64)
    return np.isin(text << 32 | start, keys)


def _sources(b: Blocks, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """For each block, the document and start of its reference; a start of -1 where there is no earlier one."""
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = lists.flatten()
    start, source, place = (np.asarray(flat.field(n), dtype=np.int64) for n in ("start", "source_id", "source_start"))
    keys = np.repeat(np.arange(len(lengths)), lengths) << 32 | start
    order = np.argsort(keys)
    keys, source, place = keys[order], source[order], place[order]
    own = b.text[b.heads] << 32 | b.start[b.heads]
    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
    if not len(keys):
        return np.zeros(len(own), np.int64), np.full(len(own), -1)
    found = keys[at] == own
    return np.where(found, source[at], 0), np.where(found, place[at], -1)


def factors(b: Blocks, copied_blocks: pa.ListArray, mixed: pa.ListArray, firsts: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(text, start, words, source document, source start) of each factor, texts in order, from left to right.

    Factors overlap where sources change, since a window of the next source begins before the last one
    of the source before has ended.  A source start of -1: found window by window.
    """
    document, place = _sources(b, copied_blocks)
    partial = np.repeat(_marked(b, mixed, b.start[b.heads], b.text[b.heads]), b.sizes)
    first = _marked(b, firsts, b.start, b.text)
    within = b.start - np.repeat(b.start[b.heads], b.sizes)
    place, document = np.repeat(place, b.sizes), np.repeat(document, b.sizes)
    copied = np.where(partial, ~first, place >= 0)
    known = copied & ~partial
    place = np.where(known, place + within, -1)
    document = np.where(known, document, 0)
    at = np.flatnonzero(copied)
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    text, start, source, origin = b.text[at], b.start[at], document[at], place[at]
    goes_on = (np.diff(start) == 1) & (np.diff(text) == 0) & (np.diff(source) == 0) & np.where(origin[1:] < 0, origin[:-1] < 0, (origin[:-1] >= 0) & (np.diff(origin) == 1))
    heads = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    sizes = np.diff(np.append(heads, len(at)))
    return text[heads], start[heads], sizes + WINDOW - 1, source[heads], origin[heads]


@common.tidy
def _parse(batches: Iterator[pa.RecordBatch], digest: bool, carried: bool, spans: bool) -> Iterator[pa.RecordBatch]:
    """Factor each text, and leave out the words that factors cover."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))
    for piece in _unpacked(batches):
        b = Blocks(piece.column("text"))
        text, start, words, source, origin = factors(b, *(piece.column(c) for c in ("copied", "mixed", "firsts")))
        change = np.zeros(len(b.text_of_word) + 1, dtype=np.int64)
        np.add.at(change, b.first_word[text] + start, 1)
        np.add.at(change, b.first_word[text] + start + words, -1)
        kept = np.cumsum(change[:-1]) == 0
        rows = []
        for n, (doc_id, own) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("text"), strict=True)):
            mask = kept[b.first_word[n] : b.first_word[n + 1]]
            removed = len(mask) - int(mask.sum())
            parts = (own.as_py() or "").encode().split()
            left = b" ".join(compress(parts, mask.tolist()) if removed else parts)
            rows.append((doc_id, len(mask), removed, hashlib.sha256(left).hexdigest() if digest else None if carried and not removed else left.decode()))
        if rows:
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            if spans:
                bounds = np.searchsorted(text, np.arange(len(rows) + 1))
                found = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(words, pa.int32()), pa.array(source, mask=origin < 0), pa.array(origin, pa.int32(), mask=origin < 0)], fields=list(span.value_type))
                made, names = [*made, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)], [*names, "factors"]
            if carried:  # the row as it was, its text too
                made, names = [*made, piece.column("text"), piece.column("rest")], [*names, "text", "rest"]
            yield pa.RecordBatch.from_arrays(made, names=names)


def deduplicate(docs: DataFrame, digest: bool = False, carry: bool = False, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or their digest.

    With ``spans`` also factors: (start, words, source_id, source_start) of each.  Null and empty texts
    have no words.  Documents are ordered by doc_id, rows without one come last; rows that repeat a doc_id,
    or have none, are documents each, in the order of the table.  Other columns are ignored, or with ``carry``
    kept in ``rest``, with the text as it was, and kept is null where nothing goes; an empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    rest = [F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")] if carry else []
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text", *rest)
    packed = named.mapInArrow(_pack, ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in named.schema))
    # (every step reads all columns of these texts and lists, so that all share one shuffle of each)
    texts = packed.repartition("row")
    blocks = texts.mapInArrow(_emit_blocks, _BLOCKS)
    place = F.struct("doc_id", "row", "start")
    by_anchor, by_content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    indexed = blocks.select("*", F.min(place).over(by_content).alias("first"), (F.min("content").over(by_anchor) < F.max("content").over(by_anchor)).alias("several"))
    reference = (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))
    # copied blocks; and where an anchor has several contents, the earliest block of each, which is looked at window by window
    kind = F.when(F.col("source_id").isNotNull() | ~reference, "copied").when(F.col("several"), "mixed")
    marks = indexed.select("row", "start", kind.alias("kind"), F.coalesce("source_id", "first.doc_id").alias("source_id"), F.coalesce("source_start", "first.start").alias("source_start")).where("kind IS NOT NULL")
    found = lambda kind, what: F.collect_list(F.when(F.col("kind") == kind, what)).alias(kind)
    lists = marks.groupBy("row").agg(found("copied", F.struct("start", "source_id", "source_start")), found("mixed", F.col("start")))  # at most the blocks of one text
    windows = texts.join(lists, "row").mapInArrow(_emit_windows, "anchor long, window long, doc_id long, row long, start int")
    firsts = windows.groupBy("anchor", "window").agg(F.min(place).alias("place")).select("place.row", "place.start")
    firsts = firsts.groupBy("row").agg(F.collect_list("start").alias("firsts"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    schema += ", factors array<struct<start: int, words: int, source_id: long, source_start: int>>" if spans else ""
    schema += f", text string, rest {named.schema['rest'].dataType.simpleString()}" if carry else ""
    out = texts.join(lists, "row", "left").join(firsts, "row", "left").mapInArrow(lambda b: _parse(b, digest, carry, spans), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != last, F.col("doc_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents without the words that repeat earlier passages; untouched texts stay as they are.

    A document of which nothing is left goes.  n_chars, if there, is counted anew.
    """
    parsed = deduplicate(docs, carry=True).where("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest")["n_chars"]) if "n_chars" in docs.columns else None
    own = {"text": text, "n_chars": chars}
    return parsed.select(*[own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns])


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM p) WHERE k > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM d
), g AS (
  SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id
), r AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
         list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: js IS NULL OR NOT list_contains(js, z[2])) AS kz
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(kz, lambda z: z[1]), ' '), '')) AS kept_sha256
FROM r
"""
