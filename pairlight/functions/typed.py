"""Reading typed values out of unevenly written text: null means that the text holds no usable value of the type.

The readers other than ``to_text`` take text that went through ``to_text``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight.functions.names import as_col, trimmed

#: Spellings of truth.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
_NUMBER = r"[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?"


def to_text(c: str | Column) -> Column:
    """Text without outer white space; blank text is not usable."""
    text = trimmed(c)
    return F.when(F.length(text) > 0, text)


def _number(text: Column) -> Column:
    """Plain, signed, exponent or decimal-comma number; null for anything else and for what is not finite."""
    value = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text.rlike(rf"^{_NUMBER}$") & (F.abs(value) < float("inf")), value)


def to_double(c: str | Column) -> Column:
    """Numbers, percentages (``12.5 %`` is 0.125) and fractions (``3/8``); a fraction over 0 is not usable."""
    t = as_col(c)
    percent = _number(F.regexp_extract(t, rf"^({_NUMBER})\s*%$", 1)) / 100
    over, under = (_number(F.regexp_extract(t, rf"^({_NUMBER})\s*/\s*({_NUMBER})$", i)) for i in (1, 2))
    return F.when(t.contains("%"), percent).when(t.contains("/"), F.when(under != 0, over / under)).otherwise(_number(t))


def to_int(c: str | Column) -> Column:
    """A whole number that fits 32 bits, also written ``016``, ``+16``, ``16.0`` or ``1.6e+01``."""
    value = _number(as_col(c))
    return F.when((value == F.floor(value)) & (F.abs(value) <= 2**31 - 1), value.cast("int"))


def to_bool(c: str | Column) -> Column:
    t = F.lower(as_col(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def to_date_any(c: str | Column) -> Column:
    """Dates that exist, as 2025-06-19, 2025/06/19, 20250619, 19.06.2025, 19 Jun 2025 or with a time after the day."""
    t = as_col(c)
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[T ].*)?$", 1)
    read = lambda form, text=t: F.try_to_timestamp(text, F.lit(form)).cast("date")
    # a failed attempt is dear, so the form is told by its marks first
    day = (
        F.when(F.length(iso) > 0, read("yyyy-M-d", iso))
        .when(t.contains("/"), read("yyyy/M/d"))
        .when(t.contains("."), read("d.M.yyyy"))
        .when(t.contains(" "), F.coalesce(read("d MMM yyyy"), read("d MMMM yyyy")))
        .when(F.length(t) == 8, read("yyyyMMdd"))
    )
    return F.when(F.year(day) >= 1, day)


#: How a catalogue's type names are read, and the Spark type of the column.
READERS = {"double": (to_double, "double"), "int": (to_int, "int"), "boolean": (to_bool, "boolean"), "date": (to_date_any, "date"), "string": (to_text, "string")}
