"""Column expressions that fold spelling variants of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Text with outer white space off."""
    return F.btrim(as_col(c), F.lit(WHITE))


def blank_to_null(c: str | Column) -> Column:
    """Null for null, empty or all-white-space text, else the text unchanged."""
    return F.when(F.length(trimmed(c)) > 0, as_col(c))


def folded_name(c: str | Column) -> Column:
    """Lower case, outer white space off, runs of white space or hyphens as one underscore; blank is null."""
    low = trimmed(F.lower(as_col(c)))
    return F.when(F.length(low) > 0, F.regexp_replace(low, r"(?U)[\s\-]+", "_"))


def trimmed_lower(c: str | Column) -> Column:
    """Lower case with outer white space off; blank is null."""
    low = trimmed(F.lower(as_col(c)))
    return F.when(F.length(low) > 0, low)


def folded_sentence(c: str | Column) -> Column:
    """A key that ignores case and all white space; null stays null."""
    return F.regexp_replace(F.lower(as_col(c)), r"(?U)\s+", "")


def is_finite(c: str | Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    c = as_col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
