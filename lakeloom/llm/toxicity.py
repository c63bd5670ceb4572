"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Training.  Labelled texts become sets of hashed features: words, and their beginnings, so that unseen
inflections count too.  Features that tell the classes apart no better than chance are dropped; the others
weigh their smoothed log-odds, and a logistic regression is fitted on top.  Where a labelled text names a group of people
(``IDENTITIES``), each such term is swapped for the next of its kind and the squared change of the
score is added to the loss: the score of a sentence must not depend on which group it names.

The fit uses at most ``SAMPLE`` labelled rows, those of the smallest hashed id; scoring covers every
document, where its text is read, without a shuffle.  Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 8000  # labelled rows of a fit, at most
BITS = 20  # hashed features
STEPS = 80
BEGINNINGS = (3, 4, 5, 6, 7)  # letters of a word's beginning that are features, where the word is longer
LEAST_G = 10.0  # log-likelihood ratio of a feature's class counts below which it is dropped
L2 = 2e-4
COUNTERFACTUAL = 1.0  # weight of squared score changes
#: Terms that name groups of people, by kind; a swap takes the next of the kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("mexican", "american", "chinese", "indian", "russian", "german", "french"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_LETTERS = re.compile(r"[^\W\d_]+")
_NEXT = {t: group[(i + 1) % len(group)] for group in IDENTITIES for i, t in enumerate(group)}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)


def swapped(text: str) -> str | None:
    """The text with every identity term swapped, or None if it has none."""
    out, n = _TERM.subn(lambda m: _NEXT[m[0].lower()], text)
    return out if n else None


def _hashed(word: str) -> list[int]:
    """Features of a word; a beginning that it has no letters for repeats the word's own feature."""
    mask, own = (1 << BITS) - 1, zlib.crc32(b"w" + word.encode())
    return [own & mask, *((zlib.crc32(b"%d" % n + word[:n].encode()) if len(word) > n else own) & mask for n in BEGINNINGS)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: the hashed features that a text has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}]+")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = np.array([_hashed(w) for w in words], dtype=np.int64)
    codes = np.asarray(coded.indices, dtype=np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    each = np.unique(rows * len(words) + codes)  # a word counts once for each text
    rows, codes = each // len(words), each % len(words)
    real = np.array([bool(w) for w in words])[codes]
    rows, codes = rows[real], codes[real]
    pairs = np.unique(np.concatenate([rows << BITS | table[codes, k] for k in range(table.shape[1])]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


Table = tuple[int, pa.Array, np.ndarray]  # letters of a beginning (0: whole words), strings, their features


@dataclass
class Model:
    weights: np.ndarray  # one for each hashed feature, log-odds included
    bias: float
    tables: tuple[Table, ...] = ()  # the strings behind the features that have a weight

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, columns = known_features(texts, self.tables)
        logits = self.bias + np.bincount(rows, self.weights[columns], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def known_features(texts: pa.Array, tables: tuple[Table, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Like ``features``, for the features whose strings are in the tables: strings are looked up, not hashed."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}]+")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = []
    lengths = np.asarray(pc.utf8_length(words))
    for n, strings, ids in tables:
        at = pc.index_in(words if n == 0 else pc.utf8_slice_codeunits(words, 0, n), value_set=strings)
        feature = np.where(np.asarray(at.is_valid()) & (lengths > n), ids[np.asarray(at.fill_null(0))], -1) if len(ids) else np.full(len(words), -1)
        found = np.flatnonzero((feature >= 0)[codes])
        pairs.append(rows[found] << BITS | feature[codes[found]])
    every = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return every >> BITS, every & ((1 << BITS) - 1)


@common.tidy
def _strings(batches: Iterator[pa.RecordBatch], strong: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(letters, string, feature) of the strong features that the texts have."""
    seen: dict[tuple[int, str], int] = {}
    for piece in common.slices(batches, "text"):
        for text in piece.column("text").to_pylist():
            for word in set(_LETTERS.findall((text or "").lower())):
                for size, feature in zip((0, *BEGINNINGS), _hashed(word), strict=True):
                    if len(word) > size and strong[feature]:
                        seen[size, word[:size] if size else word] = feature
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["letters", "string", "feature"])


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, other: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Model:
    """Fit on (row, feature) pairs of labelled texts.

    ``other``: (text, feature, text's own row) of the swapped texts.  With one class only, the score is
    that class's smoothed share.
    """
    size, n, positive = 1 << BITS, len(labels), float(labels.sum())
    if n == 0 or positive in (0.0, float(n)):
        share = (positive + 1) / (n + 2)
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    mine = np.bincount(columns, labels[rows], minlength=size)
    every = np.bincount(columns, minlength=size)
    odds = np.log((mine + 0.5) / (positive + 1)) - np.log((every - mine + 0.5) / (n - positive + 1))
    expected = every * positive / n
    term = lambda seen, due: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9))
    told = 2 * (term(mine, expected) + term(every - mine, every - expected))
    odds[told < LEAST_G] = 0
    strong = odds[columns] != 0
    rows, columns = rows[strong], columns[strong]
    values = odds[columns]
    pairs = None
    if other is not None and len(other[0]):
        extra, extra_columns, own = other
        pairs = (extra, extra_columns, odds[extra_columns], own, int(extra.max()) + 1)
    w, b = np.zeros(size), float(np.log(positive / (n - positive)))
    sums_w, sums_b = np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):  # full-batch Adagrad
        z = b + np.bincount(rows, w[columns] * values, minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
        gradient = np.bincount(columns, error[rows] * values, minlength=size) + L2 * w
        if pairs is not None:
            extra, extra_columns, extra_values, own, count = pairs
            moved = np.bincount(extra, w[extra_columns] * extra_values, minlength=count) - (z - b)[own]
            push = 2 * COUNTERFACTUAL * moved / n
            back = np.zeros(n)
            np.add.at(back, own, push)
            gradient += np.bincount(extra_columns, push[extra] * extra_values, minlength=size) - np.bincount(columns, back[rows] * values, minlength=size)
        sums_w += gradient**2
        sums_b += error.sum() ** 2
        w -= 0.1 * gradient / np.sqrt(sums_w)
        b -= 0.1 * error.sum() / np.sqrt(sums_b)
    return Model(w * odds, float(b))


@common.tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lists(rows: np.ndarray, columns: np.ndarray, n: int) -> pa.Array:
        bounds = np.searchsorted(rows, np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(columns, pa.int32()))

    for piece in common.slices(batches, "text"):
        texts = piece.column("text").to_pylist()
        others = [swapped(t or "") for t in texts]
        own = lists(*features(piece.column("text")), len(texts))
        swap = lists(*features(pa.array([o or "" for o in others], pa.string())), len(texts))
        has = pa.array([o is not None for o in others])
        yield pa.RecordBatch.from_arrays([piece.column("label"), own, has, swap], names=["label", "own", "has_swap", "swap"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents outside the held-out fold; rows without a label or id take no part."""
    spark = docs.sparkSession
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    sample = labelled.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")  # SAMPLE rows of 16 bytes
    got = texts.mapInArrow(_extract, "label double, own array<int>, has_swap boolean, swap array<int>").toArrow()
    if not got.num_rows:
        return fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def pairs(column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = got.column(column).combine_chunks()
        lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
        return np.repeat(np.arange(len(lengths)), lengths), np.asarray(lists.flatten(), dtype=np.int64)

    rows, columns = pairs("own")
    extra, extra_columns = pairs("swap")
    with_swap = np.flatnonzero(np.asarray(got.column("has_swap").combine_chunks()))
    number = np.full(got.num_rows, -1)
    number[with_swap] = np.arange(len(with_swap))
    keep = number[extra] >= 0
    other = (number[extra][keep], extra_columns[keep], with_swap) if keep.any() else None
    labels_of = np.asarray(got.column("label").combine_chunks(), dtype=float)
    del got
    model = fit(rows, columns, labels_of, other)
    # the strings behind the strong features, from the sample's texts once more
    strong = spark.sparkContext.broadcast(model.weights != 0)
    named = texts.select("text").mapInArrow(lambda b: _strings(b, strong.value), "letters int, string string, feature long").distinct().toArrow()
    tables = []
    for n in (0, *BEGINNINGS):
        mine = named.filter(pc.equal(named.column("letters"), n)).combine_chunks()
        tables.append((n, mine.column("string").combine_chunks().cast(pa.large_string()), np.asarray(mine.column("feature"), dtype=np.int64)))
    return Model(model.weights.astype(np.float32), model.bias, tuple(tables))


def held_out():
    """The fold that no label is learnt from; rows without an id are in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@common.tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for piece in common.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "held_out")), pa.array(model.score(piece.column("text")))], names=["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts get the score of no feature.

    Rows that repeat a doc_id are scored each; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each of 2**BITS features
    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lambda b: _score(b, shared.value), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


SQL = None
