"""How often, and in how many records, every distinct term occurs."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.functions.names import as_col, trimmed
from pairlight.storage import materialize

ENTRIES = T.ArrayType(T.StringType())


def list_entries(cell: str | None) -> list[str] | None:
    """The terms of one list cell, in order; None for a cell that is cut off or otherwise not a list.

    Read are JSON lists, JSON lists held in a JSON string (to any depth), Python literals, and as entries: ``[term, n]``,
    ``{"term": term, ...}`` or a plain term; a mapping counts as its keys. Null, blank and ``null`` cells have no terms.
    """
    value = cell
    while True:
        if value is None:
            return []
        if not isinstance(value, str):
            break
        text = value.strip()
        if not text or text.lower() in ("null", "none"):
            return []
        try:
            value = json.loads(text)
        except ValueError:
            try:
                value = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                return None
        if isinstance(value, str) and len(value) >= len(text):
            return None
    if isinstance(value, dict):
        return [str(k) for k in value]
    if not isinstance(value, list | tuple):
        return None
    terms = []
    for entry in value:
        if isinstance(entry, dict):
            entry = entry.get("term")
        elif isinstance(entry, list | tuple):
            entry = entry[0] if entry else None
        if entry is not None:
            terms.append(str(entry))
    return terms


@F.pandas_udf(ENTRIES)
def entries_of(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in cells:
        yield s.map(list_entries)


#: One entry ``["term"]`` or ``["term", count]`` in plain JSON, without escapes.
_ENTRY = r"""\["[^"\\\x00-\x1f]*"(?:, *(?:"[^"\\\x00-\x1f]*"|-?(?:0|[1-9]\d{0,17})))? *\]"""


def terms_of(cell: str | Column) -> Column:
    """``list_entries`` as a column: cells in plain JSON are read by Spark itself, only the others in Python."""
    cell = as_col(cell)
    # every entry becomes one mark, so a plain list is marks and commas; cells that hold the mark themselves are not plain
    marks = F.regexp_replace(F.regexp_replace(cell, _ENTRY, "\u0001"), "\u0001, *", "")
    plain = (marks == "[\u0001]") & ~F.contains(cell, F.lit("\u0001"))
    read = F.transform(F.from_json(F.when(plain, cell), "array<array<string>>"), lambda e: e[0])
    return F.when(plain, read).otherwise(entries_of(F.when(~plain, cell)))


def term_occurrences(cells: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """``field_name, term, record_id, at``: one row per term of the list cells ``fields``; terms trimmed and lower-cased.

    Repeated rows of a record count once, before any cell is read.
    """
    once = cells.select(F.col(record).alias("record_id"), *[F.col(f"`{f}`").alias(f"_cell{i}") for i, f in enumerate(fields)]).where("record_id is not null").distinct()
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_cell{i}").alias("cell")) for i, f in enumerate(fields)])).alias("p")
    long = once.select("record_id", parts).select("record_id", "p.*").where("cell is not null")
    each = long.select("record_id", "field_name", terms_of("cell").alias("terms")).select("record_id", "field_name", F.posexplode("terms").alias("at", "raw"))
    return each.select("field_name", trimmed(F.lower("raw")).alias("term"), "record_id", "at").where("length(term) > 0")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run lengths over sorted rows; the last row of a batch is carried, so that a run may go over batches."""
    last: tuple | None = None
    for rows in batches:
        if not len(rows):
            continue
        cols = [rows[c].to_numpy() for c in ("field_name", "term", "record_id", "at")]
        new = np.zeros(len(rows), dtype=bool)
        changed = []
        for i, c in enumerate(cols):
            new[1:] |= c[1:] != c[:-1]
            new[0] = new[0] or last is None or last[i] != c[0]
            changed.append(new.copy())
        starts = changed[1].copy()
        starts[0] = True
        at = np.flatnonzero(starts)
        yield pd.DataFrame(
            {
                "field_name": cols[0][at],
                "term": cols[1][at],
                "occurrences": np.add.reduceat(changed[3].astype(np.int64), at),
                "records": np.add.reduceat(changed[2].astype(np.int64), at),
            }
        )
        last = tuple(c[-1] for c in cols)


def count_terms(occurrences: DataFrame, total_records: int, rare_below: int = 3, common_percent: int = 40) -> DataFrame:
    """``field_name, term, occurrences, records, mark`` from rows ``field_name, term, record_id, at``.

    An external sort over ranges of (field, term, record) and a scan of run lengths. As the record is part of the range
    key, a term that a third of all records hold is split over many ranges; the place is not, so that all places of a term
    in a record share a range and the record counts once. The partial counts of a term's ranges are added up at the end.
    The rows are written to the shared folder first, as ranges are found by a pass of their own. Marks: ``rare`` in fewer
    than ``rare_below`` records, ``common`` in at least ``common_percent`` percent of ``total_records``, else null; a
    term that is both (few records in all) is ``common``. Repeated rows count once. Empty input gives an empty result;
    null terms are left out.
    """
    keys = ["field_name", "term", "record_id"]
    rows = materialize(occurrences.select(*keys, F.col("at").cast("int").alias("at")).dropna())
    scanned = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "at").mapInPandas(_runs, "field_name string, term string, occurrences long, records long")
    counted = scanned.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    common = F.col("records") * 100 >= F.lit(total_records) * common_percent
    return counted.withColumn("mark", F.when(common, "common").when(F.col("records") < rare_below, "rare"))
