"""Value rules of dynamically typed SQL as column expressions.

Strings that look like numbers compare, sort and count as numbers; a string that does not is unknown next
to a number.  Arithmetic on such strings, division by zero and casts give NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num(c: Column) -> Column:
    """The number that a string looks like, or NULL; 'NaN', 'inf' and '1d' are no numbers."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def identity(c: Column) -> Column:
    """One value for what counts as the same: '10', '10.0' and 10."""
    return F.coalesce(F.concat(F.lit("n:"), num(c).cast("string")), F.concat(F.lit("s:"), c.cast("string")))


def order_key(c: Column) -> list[Column]:
    """Sort keys: numbers by value, then the rest as text (an approximation for mixed columns)."""
    return [num(c).asc_nulls_last(), c.cast("string").asc_nulls_first()]


def divide(a: Column, b: Column) -> Column:
    """True division; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"^\s+", ""), r"\s+$", "")


def length(c: Column) -> Column:
    return F.char_length(c.cast("string")).cast("bigint")


def rounded(c: Column, digits: int = 0) -> Column:
    """Half away from zero; a whole number if no digits are asked for."""
    out = F.round(c.cast("double"), digits)
    return out.cast("bigint") if digits <= 0 else out


def ceil(c: Column) -> Column:
    return F.ceil(c.cast("double")).cast("bigint")


def floor(c: Column) -> Column:
    return F.floor(c.cast("double")).cast("bigint")


def to_int(c: Column) -> Column:
    """Towards zero."""
    return num(c).cast("bigint")


def to_bool(c: Column) -> Column:
    text = F.lower(trim(c))
    return F.when(text.isin("true", "t", "yes", "y", "1"), True).when(text.isin("false", "f", "no", "n", "0"), False)


def concat(*parts: Column) -> Column:
    """NULL if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def years_between(a: Column, b: Column) -> Column:
    """Calendar-year boundaries between two dates."""
    return (F.year(b) - F.year(a)).cast("bigint")


def url_domain(url: Column) -> Column:
    """Host without www., or 'self' for no URL."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    bare = F.regexp_replace(host, r"www\.", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "self").otherwise(bare)
