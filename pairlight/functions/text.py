"""Tokens and the deterministic length scorer, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight.functions.names import as_col


def missing(c: str | Column) -> Column:
    """Null or blank after trimming."""
    c = as_col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def first_present(*cols: str | Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(~missing(c), as_col(c).cast("string")) for c in cols])


def whitespace_tokens(c: str | Column) -> Column:
    return F.filter(F.split(as_col(c), r"(?U)\s+"), lambda t: t != "")


def sentence_tokens(c: str | Column) -> Column:
    """White-space tokens after all final full stops are taken off."""
    return whitespace_tokens(F.regexp_replace(as_col(c), r"\.+$", ""))


def alphabetic_tokens(c: str | Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.transform(F.regexp_extract_all(as_col(c), F.lit("([A-Za-z]+)"), 1), F.lower)


def length_score(c: str | Column) -> Column:
    """Mean token length in characters; 0.0 for blank or null text."""
    t = whitespace_tokens(F.coalesce(as_col(c), F.lit("")))
    return F.when(F.size(t) > 0, F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x)) / F.size(t)).otherwise(F.lit(0.0))


def log_prob_score(total: str | Column, tokens: str | Column, normalize: bool = True) -> Column:
    """Mean (or sum) of token log probabilities from their total; 0.0 without tokens."""
    total, tokens = as_col(total), as_col(tokens)
    return F.when(tokens > 0, total / tokens if normalize else total).otherwise(F.lit(0.0))


def parse_judgement(c: str | Column) -> Column:
    """A score in [0, 1] out of a judge's answer: the JSON field ``score``, else the first number; null if there is none."""
    c = as_col(c)
    named = F.get_json_object(c, "$.score").try_cast("double")
    first = F.nullif(F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    value = F.coalesce(named, first)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def md5_number(*parts: str | Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by a bar, as a whole number; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def distance_bucket(c: str | Column) -> Column:
    """Named range of a dependency distance; null for null or blank."""
    v = as_col(c).cast("string").try_cast("int")
    return F.when(v <= 1, "short_1").when(v <= 4, "medium_2_4").when(v.isNotNull(), "long_5_plus")


def distance_bucket_strict(c: str | Column) -> Column:
    """``distance_bucket``, with an error where the distance is not a number."""
    b = distance_bucket(c)
    return F.when(b.isNotNull(), b).otherwise(F.raise_error(F.lit("dependency distance is missing or not an integer")))


def parse_bool(c: str | Column) -> Column:
    """True only for the text ``true`` in any case; null is false."""
    return F.coalesce(F.lower(as_col(c).cast("string")) == "true", F.lit(False))


def next_value(values: list[str], c: str | Column) -> Column:
    """The value after ``c`` in a list, the first after the last one and for an unknown or null one."""
    listed = F.array(*[F.lit(v) for v in values])
    return F.get(listed, F.coalesce(F.array_position(listed, as_col(c)), F.lit(0)).cast("int") % len(values))


def model_key(model_id: str | Column, name: str | Column) -> Column:
    """The id of a model: its own, else its name with slashes and colons replaced, else ``model``."""
    return F.coalesce(first_present(model_id), F.translate(first_present(name), "/:", "__"), F.lit("model"))
