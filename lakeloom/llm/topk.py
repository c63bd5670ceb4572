"""Exact top-k search by inner product, term at a time.

Every component of a vector is a term; a vector's non-zero components are that term's weighted
postings.  A block of candidates keeps its postings by term.  Each query row is sparse: only its
non-zero terms are visited, and each visit scatters ``query weight x posting weight`` into a dense
score array over the block.  A partition selection keeps the k best of the block, and the partial
lists of all blocks are merged by rank.

Candidates and queries are dealt into blocks, and each pair of blocks is one unit of work: a grid, in
which a candidate is sent once for each block of queries and a query once for each block of candidates.
Blocks are bounded in rows, so a task's memory is too, and nothing passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 16384
CANDIDATE_BLOCK = 65536  # at most; small tables get smaller blocks, so that all tasks have some
PIECE = 8192  # candidates that are scored at a time
_SCHEMA = "query_id long, vec_id long, score long"
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms): floor(scale * x) for each component.

    Rows with a null id, a null vector or a null or non-finite component take no part.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    terms = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", terms.alias("terms"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of possibly different lengths as a dense int64 matrix; absent components count as 0."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), width or 0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _scores(query: np.ndarray, postings: list, n: int, exact: bool) -> np.ndarray:
    """Inner products of one query with a block; beyond the range of a long, the range's end."""
    scores = np.zeros(n, dtype=np.int64 if exact else object)
    for term in np.flatnonzero(query[: len(postings)]):
        at, weights = postings[term]
        weight = query[term] if exact else int(query[term])
        if len(at) == n:
            scores += weight * weights
        else:
            scores[at] += weight * weights
    return scores if exact else np.clip(scores, -_LONG - 1, _LONG).astype(np.int64)


def _unit(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one block for each query of one block."""
    query_ids = np.asarray(queries.column("vec_id").combine_chunks(), dtype=np.int64)
    rows = _matrix(queries.column("terms").combine_chunks())
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
    for start in range(0, candidates.num_rows, PIECE):
        piece = candidates.slice(start, PIECE).combine_chunks()
        ids = np.asarray(piece.column("vec_id").combine_chunks(), dtype=np.int64)
        block = _matrix(piece.column("terms").combine_chunks()).T.copy()
        largest = max(1, *(abs(int(f(m))) for m in (rows, block) if m.size for f in (np.min, np.max)))
        exact = largest**2 * max(1, len(block)) <= _LONG
        postings = [(at, row[at] if exact else row[at].astype(object)) for row in block for at in (np.flatnonzero(row),)]
        for q, (query_id, query) in enumerate(zip(query_ids, rows, strict=True)):
            scores = _scores(query, postings, len(ids), exact)
            others = np.flatnonzero(ids != query_id)
            own, ranked = kept[q]
            mine = others[best(scores[others], ids[others], k)]
            all_scores, all_ids = np.concatenate((ranked, scores[mine])), np.concatenate((own, ids[mine]))
            top = best(all_scores, all_ids, k)
            kept[q] = (all_ids[top], all_scores[top])
    found = [np.repeat(query_ids, [len(ids) for ids, _ in kept]), *(np.concatenate([x[n] for x in kept]) if kept else np.empty(0, np.int64) for n in (0, 1))]
    return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, its own id left out.

    Both inputs have ``vec_id`` and ``terms`` (see ``quantised``).  Rows that repeat a query's id
    count as one query, that of the smallest vector; repeated candidates are candidates each.  Shorter
    vectors count as padded with zeros.  Scores beyond a long are the end of its range.  Empty inputs
    give no rows; further columns are ignored.
    """
    spark = candidates.sparkSession
    common.ship(spark)
    asked = common.stage(queries.groupBy("vec_id").agg(F.min("terms").alias("terms")), "asked")
    held = common.stage(candidates.select("vec_id", "terms", F.monotonically_increasing_id().alias("row")), "candidates")
    n_queries, n_candidates, tasks = asked.count(), held.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = max(1, -(-n_queries // query_block))
    long = max(1, -(-n_candidates // candidate_block), min(tasks, -(-n_candidates // PIECE)))
    # dealt by row number, so that an id that many rows repeat spreads
    left = held.select("vec_id", "terms", F.pmod(F.xxhash64("row"), F.lit(long)).cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("q"))
    right = asked.select("vec_id", "terms", F.pmod(F.xxhash64("vec_id"), F.lit(wide)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(long - 1).cast("long"))).alias("c"))
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(lambda a, b: _unit(a, b, k), _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(common.table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
