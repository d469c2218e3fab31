"""Attribute-value rows into one typed row per entity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight.functions.names import trimmed_lower
from pairlight.functions.typed import READERS, to_text
from pairlight.storage import materialize

#: A catalogue beyond this many attributes is refused: every one becomes a column and a register slot.
MAX_ATTRIBUTES = 10_000
#: Stands for a null time or record number: it ranks before all others.
NONE = -(2**63)


def read_catalog(catalog: DataFrame) -> dict[str, str]:
    """Attribute name (trimmed, lower case) to type, in name order. Unknown types are read as text; a name given twice
    takes the first type in alphabetical order. The size is checked, as the catalogue goes to the driver."""
    rows = catalog.select(trimmed_lower("attr_name").alias("a"), F.coalesce(trimmed_lower("val_type"), F.lit("string")).alias("t")).where("a is not null").groupBy("a").agg(F.min("t").alias("t")).limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"the catalogue has more than {MAX_ATTRIBUTES} attributes")
    return {r.a: r.t if r.t in READERS else "string" for r in sorted(rows, key=lambda r: r.a)}


# A register is a dict: slot number -> (time, record id, canonical text). All three functions below keep the winner of a
# slot, so merging is associative and commutative: the order of rows and partitions cannot change the result.


def _first(cell: tuple) -> dict:
    return {cell[0]: cell[1:]}


def _add(register: dict, cell: tuple) -> dict:
    old = register.get(cell[0])
    if old is None or cell[1:] > old:
        register[cell[0]] = cell[1:]
    return register


def _merge(a: dict, b: dict) -> dict:
    if len(b) > len(a):
        a, b = b, a
    for slot, value in b.items():
        if slot not in a or value > a[slot]:
            a[slot] = value
    return a


def resolve_cells(facts: DataFrame, catalog: dict[str, str], entity: Sequence[str], attr: str = "attr_name", value: str = "val_text", time: str = "recorded_at", record: str = "record_id") -> DataFrame:
    """One row per entity: ``entity, cells`` with cells a map from attribute to ``(record_id, text)``.

    A cell takes its latest usable value by ``time``, ties by the higher ``record``, then by the greater text. Usable:
    the text can be read as the catalogue's type. Null times rank before all others. Attributes outside the catalogue
    and rows with a null attribute, or with null in all entity columns, have no cell; an entity with no usable cell has
    no row. Nulls in some entity columns are values of their own. Empty facts give an empty result.

    The reading is done by Spark expressions; resolving is ``combineByKey``: each task first folds its rows into one
    register per entity, so an entity with a third of all rows sends one register a task. Partitions of the shuffle
    spill to disk when they outgrow Python's memory.
    """
    spark = facts.sparkSession
    # one scan of the attribute column: registers have slots only for catalogue attributes that occur
    a = trimmed_lower(attr)
    seen = {r[0] for r in facts.select(a.alias("a")).where(F.col("a").isin(*catalog)).distinct().collect()} if catalog else set()
    names = [n for n in catalog if n in seen]
    slots = {a: i for i, a in enumerate(names)}
    a = F.col("_attr")
    usable: Column = F.lit(None).cast("string")
    for kind in sorted({catalog[n] for n in names}):
        members = [n for n in names if catalog[n] == kind]
        read = F.col("_raw") if kind == "string" else READERS[kind][0]("_raw").cast("string")
        usable = F.when(a.isin(*members), read).otherwise(usable)
    slot = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])[a] if slots else F.lit(None).cast("int")
    micros = F.coalesce(F.unix_micros(time), F.lit(NONE))
    cells = facts.select(*entity, trimmed_lower(attr).alias("_attr"), micros.alias("_time"), F.coalesce(F.col(record), F.lit(NONE)).alias("_record"), to_text(value).alias("_raw"))
    cells = cells.where(F.coalesce(*[F.col(e).cast("string") for e in entity]).isNotNull())
    cells = cells.select(*entity, slot.alias("_slot"), "_time", "_record", usable.alias("_text"))
    width = len(entity)

    def keyed(row: tuple) -> list[tuple[tuple, tuple]]:
        return [(tuple(row[:width]), tuple(row[width:]))] if row[width] is not None and row[-1] is not None else []

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    registers = cells.rdd.flatMap(keyed).combineByKey(_first, _add, _merge, numPartitions=parts)

    def encoded(pair: tuple) -> tuple:
        key, register = pair
        return (*key, {names[s]: (None if r == NONE else r, text) for s, (_, r, text) in register.items()})

    cell_type = T.StructType([T.StructField("record_id", facts.schema[record].dataType), T.StructField("text", T.StringType())])
    schema = T.StructType([*[facts.schema[e] for e in entity], T.StructField("cells", T.MapType(T.StringType(), cell_type), False)])
    return spark.createDataFrame(registers.map(encoded), schema, verifySchema=False)


def widen(cells: DataFrame, catalog: dict[str, str], entity: Iterable[str]) -> DataFrame:
    """``entity`` and one typed column per catalogue attribute, null where the entity has no usable value.

    An attribute whose name is also an entity column gets ``attr_`` in front.
    """
    entity = list(entity)
    taken = {e.lower() for e in entity}
    columns = [F.col("cells")[n]["text"].cast(READERS[t][1]).alias(f"attr_{n}" if n in taken else n) for n, t in catalog.items()]
    return cells.select(*entity, *columns)


def wide_table(facts: DataFrame, catalog: DataFrame, entity: Sequence[str]) -> DataFrame:
    """``resolve_cells`` and ``widen`` in one, resolved once through the shared checkpoint folder."""
    listed = read_catalog(catalog)
    return widen(materialize(resolve_cells(facts, listed, entity)), listed, entity)
