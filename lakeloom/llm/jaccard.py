"""N-gram Jaccard join: near copies by word shingles, with Bayesian pruning of candidate pairs.

1. A document is its set of five-word shingles (a shorter one is a single shingle of all its words).
   Documents with equal sets form a class of copies, kept as one node with a count.
2. Each node has ``HASHES`` MinHash values in bands; nodes that share a band's values in some bucket are
   candidates.  A pair at the threshold shares none of the bands with probability (1 - 0.8**4)**32,
   under one in ten million.
3. Nodes with company are dealt into blocks of about ``BLOCK`` nodes, those of one neighbourhood next to
   each other, and each pair of blocks that meets in some bucket is one unit of work.  So a group of any
   size is spread over many tasks, no pair of documents is ever a row, and each pair is seen once.
4. In a unit, MinHash values are compared step by step.  After each step a pair is dropped if the
   posterior probability of reaching the threshold, with a uniform prior, is below ``TOLERANCE``.  The rest
   is verified exactly on whole shingle sets.
5. A unit gives each node its number of links and the least node of its local component.  Components
   over all units are found by star contraction in the shared folder.

Links are counted over documents, copies included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rlz

SHINGLE = 5
HASHES, ROWS = 128, 4
NUMERATOR, DENOMINATOR = 4, 5  # threshold 0.8
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-7
BLOCK = 256
SLICE = 1 << 19  # bytes of text at a time; hashing takes some fifty times as much memory
_A = rlz.mixed(np.arange(7000, 7000 + HASHES, dtype=np.uint64)) | np.uint64(1)
_B = rlz.mixed(np.arange(9000, 9000 + HASHES, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order."""
    words, text_of = rlz.word_hashes(texts)
    first = np.searchsorted(text_of, np.arange(len(texts) + 1))
    grams = rlz._rolled(words, SHINGLE)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(rlz.mixed(words[a:b].sum(keepdims=True) * np.uint64(31) + rlz._rolled(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (unsigned 32-bit) of sets that are not empty."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((every * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def buckets_of(values: np.ndarray) -> np.ndarray:
    """One hash for each band of the values of each row."""
    bands = values.astype(np.uint64).reshape(len(values), HASHES // ROWS, ROWS)
    out = np.arange(1, HASHES // ROWS + 1, dtype=np.uint64)[None, :].repeat(len(values), axis=0)
    for r in range(ROWS):
        out = rlz.mixed(out ^ rlz.mixed(bands[:, :, r]))
    return out


@common.tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in common.slices(batches, "text", SLICE):
        sets = shingle_sets(piece.column("text"))
        full = [n for n, s in enumerate(sets) if len(s)]
        made = buckets_of(signatures([sets[n] for n in full])).view(np.int64)
        at = dict(zip(full, range(len(full)), strict=True))
        buckets = pa.array([made[at[n]] if n in at else None for n in range(len(sets))], pa.list_(pa.int64()))
        digests = pa.array([digest(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("body"), digests, buckets], names=["doc_id", "body", "node", "buckets"])


@common.tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and MinHash values of the texts whose digest is that of the node they are taken for."""
    for piece in common.slices(batches, "text", SLICE):
        sets = shingle_sets(piece.column("text"))
        right = [n for n, (s, node) in enumerate(zip(sets, piece.column("node").to_pylist(), strict=True)) if len(s) and digest(s) == node]
        taken = piece.take(pa.array(right, pa.int64()))
        values = pa.array(list(signatures([sets[n] for n in right]).view(np.int32)), pa.list_(pa.int32()))
        shingles = pa.array([sets[n].tobytes() for n in right], pa.binary())
        yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("node", "block", "copies")), values, shingles], names=["node", "block", "copies", "values", "shingles"])


def least_matches(steps: int = STEP) -> dict[int, int]:
    """After n compared values, the matches below which a pair is dropped.

    With a uniform prior and m matches of n, the similarity is Beta(m + 1, n - m + 1), and the probability
    that it reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    t, out = NUMERATOR / DENOMINATOR, {}
    for n in range(steps, HASHES + 1, steps):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


def similar_pairs(values_a: np.ndarray, values_b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows of a and b) whose sets reach the threshold; of one block, each pair once."""
    matches = np.zeros((len(values_a), len(values_b)), dtype=np.int16)
    for k in range(STEP):
        matches += values_a[:, k, None] == values_b[None, :, k]
    alive = matches >= _LEAST[STEP]
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    x, y = np.nonzero(alive)
    got = matches[x, y].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        for at in range(0, len(x), 1 << 16):
            piece = slice(at, at + (1 << 16))
            got[piece] += (values_a[x[piece], n - STEP : n] == values_b[y[piece], n - STEP : n]).sum(axis=1)
        keep = got >= _LEAST[n]
        x, y, got = x[keep], y[keep], got[keep]
    if not len(x):
        return x, y
    rows_a, rows_b = np.unique(x), np.unique(y)
    if len(x) * 8 < len(rows_a) * len(rows_b):
        shared = np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(x, y, strict=True)])
    else:
        shared = _overlaps([sets_a[i] for i in rows_a], [sets_b[j] for j in rows_b])[np.searchsorted(rows_a, x), np.searchsorted(rows_b, y)]
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    # shared / (a + b - shared) >= p / q
    enough = shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (sizes_a[x] + sizes_b[y])
    return x[enough], y[enough]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over pieces of the common shingles."""
    every_a, every_b = np.concatenate(a), np.concatenate(b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    common_ones = np.intersect1d(np.unique(every_a), np.unique(every_b), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.int64)

    def incidence(every: np.ndarray, rows: np.ndarray, n: int, part: np.ndarray) -> np.ndarray:
        at = np.searchsorted(part, every)
        hit = part[np.minimum(at, len(part) - 1)] == every
        m = np.zeros((n, len(part)), dtype=np.float32)
        m[rows[hit], at[hit]] = 1
        return m

    for start in range(0, len(common_ones), width):
        part = common_ones[start : start + width]
        out += np.rint(incidence(every_a, rows_a, len(a), part) @ incidence(every_b, rows_b, len(b), part).T).astype(np.int64)
    return out


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Links and local components of one pair of blocks."""
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)  # a repeated row brings its node twice
    blocks = rows["block"].to_numpy()
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    values = np.stack([np.asarray(v) for v in rows["values"]])
    sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
    x, y = similar_pairs(values[a], values[b], [sets[i] for i in a], [sets[i] for i in b], low == high)
    x, y = a[x], b[y]
    copies = rows["copies"].to_numpy(dtype=np.int64)
    links = np.bincount(x, copies[y], minlength=len(rows)) + np.bincount(y, copies[x], minlength=len(rows))
    lead = np.arange(len(rows))
    while len(x):  # least label over links until nothing changes
        least = np.minimum(lead[x], lead[y])
        before = lead.copy()
        np.minimum.at(lead, x, least)
        np.minimum.at(lead, y, least)
        lead = lead[lead]
        if np.array_equal(before, lead):
            break
    linked = np.flatnonzero(links > 0)
    nodes = rows["node"].to_numpy()
    return pd.DataFrame({"node": nodes[linked], "lead": nodes[lead[linked]], "links": links[linked].astype(np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (node, lead): root is the least node of the component.

    Alternating large-star and small-star steps; each node's neighbours are only ever reduced to their
    least, so large components cost no task more than others.  Each step is a table in the shared folder.
    """
    current = common.stage(edges.where("node <> lead").distinct(), "edges")
    while True:
        # settled: every node hangs on one lead, and no lead hangs on another
        hanging = current.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        loose = hanging.where("n > 1").limit(1).count() or current.join(hanging.select(F.col("node").alias("lead")), "lead", "left_semi").limit(1).count()
        if not loose:
            return current.select("node", F.col("lead").alias("root"))
        both = current.unionByName(current.select(F.col("lead").alias("node"), F.col("node").alias("lead")))
        # (written, so that the join reads two plain shuffles, of which adaptive execution can split a hot node's)
        least = common.stage(both.groupBy("node").agg(F.least(F.min("lead"), F.first("node")).alias("least")), "least")
        large = both.join(least, "node").where("lead > node").select(F.col("lead").alias("node"), F.col("least").alias("lead")).where("node <> lead").distinct()
        large = common.stage(large, "edges")
        lower = common.stage(large.groupBy("node").agg(F.min("lead").alias("least")), "least")
        small = large.join(lower, "node")
        moved = small.select(F.col("lead").alias("node"), F.col("least").alias("lead")).unionByName(small.select("node", F.col("least").alias("lead")))
        before, current = current, common.stage(moved.where("node <> lead").distinct(), "edges")
        common.drop(before, least, large, lower)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, node, root, class_id, n_links) of each row: the hash of its text, the digest of its
    shingles, the class's least digest, and what ``join`` gives.  Without words, node and root are null."""
    common.ship(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    rows = common.stage(texts.mapInArrow(_sketch, "doc_id long, body long, node binary, buckets array<long>"), "sketch")
    real = rows.where("node IS NOT NULL")
    # candidates go by eight bytes of a node's digest; two nodes of one short name only make more candidates
    short = F.xxhash64("node").alias("short")
    nodes = common.stage(real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")

    # (what many rows are joined to is written first: adaptive execution splits a hot key where both sides are plain shuffles)
    bands = real.select(short, F.explode("buckets").alias("bucket"))
    shared = common.stage(bands.groupBy("bucket").agg(F.min("short").alias("lead"), F.max("short").alias("last")).where("lead <> last").drop("last"), "shared")
    met = common.stage(bands.join(shared, "bucket").distinct(), "met")
    near = common.stage(met.groupBy("short").agg(F.min("lead").alias("near")), "near")
    sizes = common.stage(near.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "sizes")
    block = F.xxhash64("near", F.pmod(F.xxhash64("short", F.lit(1)), F.col("parts")))
    placed = common.stage(near.join(sizes, "near").select("short", block.alias("block")), "blocks")

    # units: a block by itself, and blocks that meet in a bucket
    meeting = met.join(placed, "short").select("bucket", "block").distinct()
    other = meeting.select("bucket", F.col("block").alias("high"))
    pairs = meeting.join(other, "bucket").where("block < high").select(F.col("block").alias("low"), "high").distinct()
    own = placed.groupBy("block").count().select(F.col("block").alias("low"), F.col("block").alias("high"))
    units = common.stage(own.unionByName(pairs), "units")
    sides = units.select(F.col("low").alias("block"), "low", "high").unionByName(units.where("low < high").select(F.col("high").alias("block"), "low", "high"))

    # shingle sets of the nodes' representatives, once for each unit
    chosen = nodes.withColumn("short", F.xxhash64("node")).join(placed, "short").select("node", "rep", "block", "copies")
    same_id = F.coalesce(F.col("doc_id"), F.lit(-1)) == F.coalesce(F.col("rep"), F.lit(-1))
    with_text = texts.join(chosen, same_id)
    sets = with_text.select("text", "node", "block", "copies").mapInArrow(_sets, "node binary, block long, copies long, values array<int>, shingles binary")
    found = common.stage(sets.join(sides, "block").groupBy("low", "high").applyInPandas(_unit, "node binary, lead binary, links long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "lead"))
    rooted = nodes.select("node", "rep", "copies").join(links, "node", "left").join(roots, "node", "left")
    rooted = common.stage(rooted.select("node", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
    least = common.stage(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    classed = common.stage(rooted.join(least, "root").select("node", "root", "class_id", "n_links"), "classed")
    out = rows.select("doc_id", "body", "node").join(classed, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "body", "node", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): the least doc_id of each document's component, and its near copies.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least 0.8; a component
    is what links connect.  Documents without words (null, empty, blank) have no links and are their own
    class.  Rows that repeat a doc_id, or have none, are documents each and count as copies; a class of
    such rows alone has a null class_id.  Other columns are ignored; an empty table gives no rows.
    """
    return classes(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class with its columns: that of the least doc_id (rows without one come last) and text hash.

    So rows that repeat a doc_id with texts of different classes all stay.  Of rows that have the doc_id and
    the text in common one stays.  Rows without words are classes of their own and stay.
    """
    last = F.lit((1 << 63) - 1)
    place = F.struct(F.coalesce("doc_id", last).alias("_id"), F.col("body").alias("_body"))
    chosen = common.stage(classes(docs).where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("p")).select("p.*"), "chosen")
    named = docs.select(F.coalesce("doc_id", last).alias("_id"), F.xxhash64("text").alias("_body"), F.struct(*docs.columns).alias("_row"))
    worded = lambda text: F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    one = named.where(worded(F.col("_row")["text"])).join(chosen, ["_id", "_body"]).dropDuplicates(["_id", "_body"])
    return one.select("_row.*").unionByName(docs.where(~worded(F.col("text"))))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.x, p.y FROM p JOIN c cx ON cx.doc_id = p.x JOIN c cy ON cy.doc_id = p.y WHERE p.n * 9 >= 4 * (cx.n + cy.n)
), r(x, y) AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), m AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
), k AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT d.doc_id, least(d.doc_id, coalesce(m.y, d.doc_id)) AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN m ON m.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
