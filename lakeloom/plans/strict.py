"""Checks on statements: always that output names differ; on demand the narrow dialect.

Strict mode refuses what the narrow dialect does not have, so that a statement accepted there means the
same thing here.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .quantified import tokens


class SqlError(ValueError):
    """A statement that is wrong: unknown or ambiguous names, bad grouping, arity, types."""


class UnsupportedSql(NotImplementedError):
    """A statement that strict mode does not take."""


_SCALARS = {"coalesce", "nullif", "upper", "lower", "length", "trim", "abs", "ceil", "ceiling", "floor", "round", "concat", "cast"}
_AGGREGATES = {"count", "sum", "avg", "min", "max"}
_WORDS_BEFORE_BRACKET = {"in", "and", "or", "not", "values", "exists", "any", "some", "all", "from", "join", "on", "where", "select", "by", "then", "when", "else", "union", "intersect", "except", "having", "as", "into", "case", "like", "ilike", "between", "limit", "offset", "varchar", "decimal", "key", "set", "distinct"}


def check_strict(sql: str) -> None:
    words = [t for t in tokens(sql) if not t.isspace()]
    lower = [w.lower() for w in words]
    if lower and lower[0] == "with":
        raise UnsupportedSql("WITH is not supported")
    if lower[:1] == ["create"] and "select" in lower:
        raise UnsupportedSql("CREATE TABLE AS is not supported")
    setops = {"union", "intersect", "except"}
    depth, seen = 0, {0: set()}
    for i, w in enumerate(lower):
        after = lower[i + 1] if i + 1 < len(lower) else ""
        if w == "(":
            depth += 1
            seen[depth] = set()
            if i and lower[i - 1] in ("from", "join") and after == "select":
                raise UnsupportedSql("a derived table is not supported")
        elif w == ")":
            depth -= 1
        elif w == "over" and after == "(":
            raise UnsupportedSql("window functions are not supported")
        elif w == "similar":
            raise UnsupportedSql("SIMILAR TO is not supported")
        elif w in ("rollup", "cube", "grouping"):
            raise UnsupportedSql("grouping sets are not supported")
        elif w in setops:
            seen[depth].add(w)
            if len(seen[depth]) > 1 and "intersect" in seen[depth]:
                raise SqlError("mixed set operations need parentheses")
            if after == "by":
                raise UnsupportedSql("UNION BY NAME is not supported")
        elif after == "(" and w.isidentifier() and w not in _SCALARS | _AGGREGATES | _WORDS_BEFORE_BRACKET and lower[0] == "select":
            raise UnsupportedSql(f"function {w} is not supported")
        elif w == "trim" and after == "(" and i + 2 < len(lower) and lower[i + 2] in ("leading", "trailing", "both"):
            raise UnsupportedSql("TRIM with a side is not supported")


def check_names(df: DataFrame) -> DataFrame:
    seen: set[str] = set()
    for name in df.columns:
        if name.lower() in seen:
            raise SqlError(f"duplicate output name {name}")
        seen.add(name.lower())
    return df


def engine_error(error: Exception) -> Exception:
    """The engine's own error for one of Spark's, of analysis or of execution."""
    kind = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    text = str(error).split("\n")[0]
    return UnsupportedSql(text) if kind.startswith("UNSUPPORTED") or kind.startswith("NOT_IMPLEMENTED") else SqlError(text)
