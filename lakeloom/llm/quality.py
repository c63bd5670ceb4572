"""Quality rules: structural limits, then a hashed n-gram log-likelihood ratio.

The verdict compares two multinomials over hashed n-grams: one counted over trusted documents, one over
all documents.  A document's score is the mean of its n-grams' log ratios; below a fixed threshold it is
rejected.  Trusted documents are those that meet strict structural limits, so no second table is joined
and every document is counted.

N-grams are pairs of neighbouring word shapes: a run of letters or digits is one sign, all else stands as
it is, and two equal words are an n-gram of their own.  Words themselves won't do: most are rare, so their ratios tell what a table holds by chance, and shrink as it grows and hash
buckets fill.  Shapes are few.  Their shares, and so the ratios, are the same at every size of a corpus:
a ratio is log((1 - FLOOR) * share in trusted / share in all + FLOOR), whose floor is a constant too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = -0.4  # mean log ratio below which a document is rejected
BUCKETS = 1 << 16  # of hashed n-grams: far more than there are pairs of shapes
FLOOR = 0.01
UNIT = 10_000  # ratios are whole numbers of 1 / UNIT, so that sums do not depend on their order
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOLS = "[#*$%&|<>]"
AGAIN = 0  # the bucket of two equal words
_RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _neighbours(values: Column, by: int, body) -> Column:
    """``body`` of each value and the one ``by`` places on, which is null behind the last."""
    return common.let(values, lambda v: F.zip_with(v, F.slice(v, by + 1, F.size(v)), body))


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows that are found twice or more in the text.

    Windows are compared by 64-bit hashes: two different ones of a text of a thousand words have equal
    ones in fewer than one of 10**13 texts.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(o: Column) -> Column:
            same = lambda x, at: x["h"] == F.get(o, at)["h"]
            return F.array_sort(F.transform(F.filter(o, lambda x, at: F.coalesce(same(x, at - 1), F.lit(False)) | F.coalesce(same(x, at + 1), F.lit(False))), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(common.let(ordered, twice), start, step, lambda a: a["n"])

    # hashes of windows of 2, 4 and 8 words, each from two of the size before; those that reach over the end are cut off
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    for by in (1, 2, 4):
        hashes = _neighbours(hashes, by, lambda a, b: F.xxhash64(a, b))
    whole = common.let(hashes, lambda h: F.slice(h, 1, F.size(h) - (WINDOW - 1)))
    found = common.let(whole, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(found).cast("long")


def shapes_of(text: Column) -> Column:
    """The words of a text as shapes: a for letters, 0 for digits, other signs as they are."""
    return common.words_of(F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{M}]+", "a"), r"\p{N}+", "0"))


def ngrams(text: Column, words: Column) -> Column:
    """Buckets of all pairs of neighbouring shapes; the last shape is one by itself, two equal words are ``AGAIN``."""
    pairs = _neighbours(shapes_of(text), 1, lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    equal = _neighbours(words, 1, lambda a, b: a.eqNullSafe(b))
    return F.zip_with(pairs, equal, lambda p, e: F.when(e, F.lit(AGAIN)).otherwise(p))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with all counts and n-gram buckets, each text read once, in the shared folder."""
    names = ("words", "buckets", *_RESULT, "score")
    full = docs.select(*[c for c in keep if c not in names], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = (
        full.withColumn("words", common.words_of(F.col("_text")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).cast("long"))
        .withColumn("n_symbols", (F.size(F.split("_text", _SYMBOLS, -1)) - 1).cast("long"))
        .withColumn("n_dup_lines", common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("words")))
        .withColumn("buckets", ngrams(F.col("_text"), F.col("words")))
    )
    return common.stage(counted.drop("words", "_text"), "quality")


def log_ratios(measures: DataFrame) -> list[int]:
    """The log ratio of each bucket in UNITs; 0 for those that no document has."""
    n = F.col("n_words")
    repeats = n - F.size(F.array_remove("buckets", AGAIN))
    trusted = (n >= LEAST_WORDS) & (F.col("n_dup_lines") == 0) & (F.col("n_symbols") * 50 <= n) & (repeats * 50 <= n)
    # two projections: next to the generator, the condition would be worked out again for each n-gram
    grams = measures.select(trusted.alias("trusted"), "buckets").select("trusted", F.explode("buckets").alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target")).collect()  # BUCKETS rows at most
    out, raw, target = [0] * BUCKETS, sum(r["raw"] for r in counted), sum(r["target"] for r in counted)
    for r in counted if target else ():
        out[r["bucket"]] = round(UNIT * math.log((1 - FLOOR) * (r["target"] / target) / (r["raw"] / raw) + FLOOR))
    return out


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null and empty texts have no words and fail.  Rows that repeat a doc_id are judged each.  Columns of
    ``docs`` with one of these names are replaced.  Where no document is trusted, all scores are 0.
    """
    m = measured(docs, docs.columns if keep is None else keep)
    ratios = F.split(F.lit(",".join(map(str, log_ratios(m)))), ",").cast("array<int>")  # folded to one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(ratios, b))
    m = m.withColumn("score", F.round(total / F.greatest(F.col("n_words"), F.lit(1)) / UNIT, 6))
    m = m.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    return m.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)).drop("buckets")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *_RESULT, "score")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their columns as they were."""
    return judge(docs.select("text", F.struct(*docs.columns).alias("_row")), ["_row"]).where("kept").select("_row.*")


SQL = None  # DuckDB has no xxhash64 as Spark seeds it; tests compare with a brute-force version
