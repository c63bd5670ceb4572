"""Secret scan over a trigram inverted index.

1. Each rule's regular expression is turned into a Boolean trigram query in disjunctive form: every
   match holds all trigrams of at least one clause.  Case is folded, which only adds candidates.
2. The index has the trigrams that some rule asks for: one posting (trigram, document) where the folded
   text holds it.  Postings of a clause are intersected by counting a document's postings in it.
3. Only (document, rule) pairs that pass some clause are verified with the rule's expression.  Rules
   without mandatory trigrams, such as plain hex runs, scan every text, before the join.

Texts travel once, and only those in which some clause is whole.  Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import operator
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1024
_MOST = 64  # strings of one exact set, or clauses of one rule


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``pattern`` is common to Java, RE2 and Python; group ``measured`` has ``least`` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


#: The three base kinds, in their order.  A run that is long enough is matched whole and a
#: shorter one not at all, so the least length of access and hex can stand in the pattern.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds; their spans come after the base ones at the same start.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# --- regular expression to trigram query ------------------------------------------------------


def _exact(node) -> set[str] | None:
    """All strings that a node can match, folded, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _MOST:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 5 else None
    if op is sre.SUBPATTERN:
        return _exact_run(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_run(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _exact_run(inner) if high <= 4 else None
        if one is None:
            return None
        out, run = set(), {""}
        for n in range(high + 1):
            out |= run if n >= low else set()
            run = {a + b for a in run for b in one}
            if len(run) > _MOST:
                return None
        return out
    return None


def _exact_run(nodes) -> set[str] | None:
    run = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(run) * len(one) > _MOST:
            return None
        run = {a + b for a in run for b in one}
    return run


def _absorbed(clauses: set[frozenset]) -> set[frozenset]:
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    made = _absorbed({x | y for x in a for y in b})
    return made if len(made) <= _MOST else min(a, b, key=len)


def _query(nodes) -> set[frozenset]:
    """Clauses of which every match fulfils one; {frozenset()} asks for nothing."""
    asked, run = {frozenset()}, {""}

    def literal(strings: set[str]) -> set[frozenset]:
        return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})

    for op, arg in nodes:
        one = _exact((op, arg))
        if one is not None and len(run) * len(one) <= _MOST:
            run = {a + b for a in run for b in one}
            continue
        asked, run = _both(asked, literal(run)), one or {""}
        if one is None and op is sre.BRANCH:
            asked = _both(asked, _absorbed(set().union(*(_query(b) for b in arg[1]))))
        elif one is None and op is sre.SUBPATTERN:
            asked = _both(asked, _query(arg[-1]))
        elif one is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            asked = _both(asked, _query(arg[2]))
    return _both(asked, literal(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The clauses of a regular expression; none if it has a match without any trigram in common."""
    clauses = _query(sre_parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


# --- index and verification -------------------------------------------------------------------


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(doc_id, gram): where a folded text holds a trigram, for the trigrams that rules ask for."""
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    return folded.select("doc_id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, rules): the rules of which some clause has all its postings in the document."""
    spark = index.sparkSession
    rows = [(g, kind, n, len(c)) for kind, clauses in queries.items() for n, c in enumerate(clauses) for g in c]
    asked = spark.createDataFrame(rows, "gram string, kind string, clause int, need int")  # as many rows as the rules have
    met = index.distinct().join(F.broadcast(asked), "gram").groupBy("doc_id", "kind", "clause").agg(F.count(F.lit(1)).alias("held"), F.first("need").alias("need"))
    return met.where("held = need").groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def scanned(values: Column, op) -> Column:
    """For each element, ``op`` over it and all before it (a prefix scan) in passes of doubled reach.

    A fold that keeps a list would copy it at each step, and one sum for each element starts anew; this
    takes as many operations as elements times the passes that their number needs.
    """

    def grown(by: int):
        # zip_with fills up at the end, so the scan runs from the end of the reversed array
        both = lambda v: F.zip_with(v, F.slice(v, by + 1, F.size(v)), lambda x, y: F.coalesce(op(x, y), x))
        return lambda v: F.when(F.size(v) > by, both(v)).otherwise(v)

    out = F.reverse(values)
    for n in range(27):  # a text of 2 GB has fewer matches than 2 ** 27
        out = common.let(out, grown(1 << n))
    return F.reverse(out)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, in code points, from the lengths of matches and of the gaps between them."""
    pattern = F.lit(rule.pattern)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.measured)), lambda m: F.length(m)) if rule.measured else None
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda gap, match: gap + match)
        span = lambda n, end: F.struct((end - n).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        every = F.zip_with(m, scanned(steps, lambda x, y: x + y), span)
        if not rule.least:
            return every
        if measured is None:
            return F.filter(every, lambda s: s["end"] - s["start"] >= rule.least)
        enough = F.zip_with(every, measured, lambda s, n: F.when(n >= rule.least, s))
        return F.filter(enough, lambda s: s.isNotNull())

    return common.let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """(doc_id, found): for each row, its spans (start, rank, kind, end), sorted by start and rank.

    Null texts are empty.  Rows that repeat a doc_id, or have none, are scanned each; their postings
    are put together, which only adds candidates.  Other columns are ignored, or with ``carry`` kept in
    ``row``, next to the text.  An empty table gives no rows.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *row)
    rest = ["row"] if carry else []
    full = [spans(F.col("text"), r, n) for n, r in enumerate(rules) if r.kind not in queries]
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    if not grams:
        return texts.select("doc_id", F.array_sort(F.concat(none, *full)).alias("found"), *rest)
    # texts in which no clause is whole can't be candidates and stay behind
    clauses = [c for q in queries.values() for c in q]
    some = reduce(operator.or_, [reduce(operator.and_, [F.contains("folded", F.lit(g)) for g in c]) for c in clauses])
    # (the column has another name: in a lambda, "text" would mean a column of that name made in the same select)
    left = texts.withColumn("folded", F.lower("text")).select("doc_id", F.when(some, F.col("text")).alias("held_text"), F.concat(none, *full).alias("always"), *rest)
    met = candidates(postings(texts, grams), queries).withColumnRenamed("doc_id", "met_id")
    joined = left.join(met, left["doc_id"].eqNullSafe(met["met_id"]), "left")
    verified = [F.when(F.array_contains("rules", r.kind), spans(F.coalesce("held_text", F.lit("")), r, n)).otherwise(none) for n, r in enumerate(rules) if r.kind in queries]
    return joined.select("doc_id", F.array_sort(F.concat("always", *verified)).alias("found"), *rest)


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with each secret replaced by its kind in brackets; overlapping spans are one, named by the first.

    Texts without a secret stay as they are, null ones too; n_chars, if there, is counted anew for the others.
    """
    found = scan(docs, rules, carry=True)
    text = F.col("row")["text"]

    def cleaned(chunks: Column, spans: Column) -> Column:
        # pieces of CHUNK code points: a cut looks at its own pieces only, not at all that stands before
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / CHUNK).cast("int")
            part = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(part, start - first * CHUNK + 1, end - start)).otherwise("")

        def joined(reached: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reached, i - 1), F.lit(0))
            piece = lambda s, i: F.when(s["start"] < before(i), "").otherwise(F.concat(cut(before(i), s["start"]), F.lit("["), s["kind"], F.lit("]")))
            return F.concat(F.array_join(F.transform(spans, piece), ""), cut(F.element_at(reached, -1), F.length(text)))

        return common.let(scanned(F.transform(spans, lambda s: s["end"]), F.greatest), joined)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = common.let(chunks, lambda c: cleaned(c, F.col("found")))
    out = found.withColumn("clean", F.when(F.size("found") == 0, text).otherwise(clean))
    own = {"text": F.col("clean"), "n_chars": F.when(F.size("found") == 0, F.col("row")["n_chars"]).otherwise(F.length("clean").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def _sql() -> str:
    parts, columns = [], []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        columns.append(f"regexp_extract_all(t, '{p}') AS m{n}, string_split_regex(t, '{p}') AS g{n}" + (f", regexp_extract_all(t, '{p}', {r.measured}) AS x{n}" if r.measured else ""))
        start = f"coalesce(list_sum(list_transform(g{n}[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda s: length(s))), 0)"
        every = f"list_transform(range(1, len(m{n}) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'k': {n}, 'n': '{r.kind}', 'e': CAST({start} + length(m{n}[i]) AS BIGINT), 'w': CAST(length({'x' if r.measured else 'm'}{n}[i]) AS BIGINT)}})"
        parts.append(f"list_filter({every}, lambda s: s.w >= {r.least})")
    join = "coalesce(array_to_string(list_transform({0}, lambda s: s.n || ':' || s.s || ':' || s.e), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(columns)} FROM d),
l AS (SELECT doc_id, list_sort({" || ".join(parts)}) AS a FROM f)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(a, lambda s: s.k = {n})) AS BIGINT) AS n_{r.kind}" for n, r in enumerate(BASE))},
  sha256({join.format(f"list_filter(a, lambda s: s.k < {len(BASE)})")}) AS base_sha256, {join.format("a")} AS spans
FROM l
"""


SQL = _sql()
