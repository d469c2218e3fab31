"""The N lowest rows of every group, by simultaneous bisection of all groups' code ranges.

Each row gets one code: an order-preserving encoding of its score followed by its identifier, as hexadecimal text whose
text order is the wanted order. A pass cuts the open section of every unfinished group at many points at once (a
bisection with up to 65,536 midpoints that rows lie between), counts the rows of each part and keeps the part in which the
N-th row lies. Only
that part's rows go on to the next pass, which cuts behind the characters that all of them share. No group is ever
sorted or gathered as a whole: a pass is a map-side combined count with at most 65,536 counters a group, so a group with
a third of all rows costs what its rows cost to scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions.names import as_col
from pairlight.storage import materialize

#: Hexadecimal digits that one pass resolves: 16 bits, or 32 where a part holds too few rows for more counters than that.
DIGITS = 4
COUNTERS = 16**DIGITS


def double_code(c: str | Column) -> Column:
    """16 hexadecimal digits whose text order is the numeric order; -0.0 equals 0.0, NaN is last, null stays null."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), as_col(c).cast("double") + F.lit(0.0)).cast("long")
    flipped = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))
    return F.when(as_col(c).isNotNull(), F.lpad(F.hex(flipped), 16, "0"))


def text_code(c: str | Column) -> Column:
    """Hexadecimal UTF-8 bytes: text order is byte order, a prefix comes first; null counts as empty."""
    return F.hex(F.coalesce(as_col(c).cast("string"), F.lit("")))


def _shared_length(low: str, high: str) -> Column:
    """How many characters two texts share at their start."""
    differs = F.array_position(F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.length(low)).cast("int")


def cutoffs(coded: DataFrame, groups: Sequence[str], code: str, n: str, small_section: int = 0) -> DataFrame:
    """One row ``groups + cut_len, cut`` per group: the rows with ``left(code, cut_len) <= cut`` are exactly its N lowest.

    ``n`` names a column that holds the group's N, equal in all its rows. Codes should be distinct within a group: of rows
    with equal codes all pass or none, so a cut that falls among them lets more than N pass. A group with at most N rows
    gets the cut that lets all pass (``cut_len`` 0); N null or below 1 gives the group no row. An open section of at most
    ``small_section`` rows is ranked directly instead of being cut further; by default all are cut until they hold exactly N.
    ``coded`` is read twice: for the first count, and for the rows of the parts that stay open.
    """
    groups = list(groups)
    null_safe = F.expr(" AND ".join(f"r.{g} <=> o.{g}" for g in groups)) if groups else F.lit(True)
    rows = coded.select(*groups, F.col(code).alias("_code"), F.col(n).cast("long").alias("_n")).where("_n >= 1")
    part, first = rows.withColumn("_at", F.lit(0)).withColumn("_digits", F.lit(DIGITS)), True
    found: list[DataFrame] = []
    while True:
        digit = F.expr("substring(_code, _at + 1, _digits)").alias("_digit")
        # the first count is over all rows and keeps to sums; the ends of a part are looked for among the few rows of later ones
        ends = [] if first else [F.min("_code").alias("_low"), F.max("_code").alias("_high")]
        counted = part.groupBy(*groups, digit).agg(F.count("*").alias("_rows"), F.max("_n").alias("_n"), *ends)
        upto = F.sum("_rows").over(W.partitionBy(*groups).orderBy("_digit").rowsBetween(W.unboundedPreceding, 0))
        bins = counted.withColumn("_upto", upto).withColumn("_all", F.sum("_rows").over(W.partitionBy(*groups)))
        if first:
            bins = bins.withColumn("_low", F.col("_digit")).withColumn("_high", F.col("_digit"))
        # the part that holds the N-th row; the last part where the group has fewer
        edge = bins.where(
            ((F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("_rows") < F.col("_n")))
            | ((F.col("_all") < F.col("_n")) & (F.col("_upto") == F.col("_all")))
        )
        left = (F.col("_n") - (F.col("_upto") - F.col("_rows"))).alias("_n")
        edge = materialize(edge.select(*groups, "_low", "_high", left, "_rows", (F.col("_all") <= F.col("_n")).alias("_whole")))
        whole = F.col("_whole") & F.lit(first)
        full = (F.col("_n") >= F.col("_rows")) | F.col("_whole") | ((F.col("_low") == F.col("_high")) & F.lit(not first))
        cut_len = F.when(whole, 0).otherwise(DIGITS if first else 2**30)
        found.append(edge.where(full).select(*groups, cut_len.alias("cut_len"), F.when(whole, "").otherwise(F.col("_high")).alias("cut")))
        unfinished = edge.where(~full).drop("_whole")
        if unfinished.isEmpty():
            break
        # inner join on the group: the rows of a hot group are split by adaptive execution, the other side has one row a group
        inside = F.expr(f"left(r._code, {DIGITS}) = o._high" if first else "r._code BETWEEN o._low AND o._high")
        at = F.lit(DIGITS) if first else _shared_length("_low", "_high")
        joined = part.drop("_n", "_at", "_digits").alias("r").join(unfinished.withColumn("_at", at).alias("o"), null_safe).where(inside)
        part = materialize(joined.select(*[F.col(f"r.{g}") for g in groups], "r._code", "o._n", "o._rows", "o._at"))
        if small_section:
            ranked = part.where(F.col("_rows") <= small_section).withColumn("_rank", F.row_number().over(W.partitionBy(*groups).orderBy("_code")))
            found.append(ranked.where(F.col("_rank") == F.col("_n")).select(*groups, F.lit(2**30).alias("cut_len"), F.col("_code").alias("cut")))
            part = part.where(F.col("_rows") > small_section)
        digits = F.when(F.col("_rows") <= COUNTERS, 2 * DIGITS).otherwise(DIGITS)
        part, first = part.withColumn("_digits", digits).drop("_rows"), False
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return done


def lowest_n(df: DataFrame, groups: Sequence[str], code: Column, n: int | Column) -> DataFrame:
    """The rows of ``df`` that are among the N lowest codes of their group, with all columns.

    ``code`` should be distinct within a group: end it with an identifier (see ``double_code``, ``text_code``); of repeated
    rows all stay or none. Rows with a null code are left out; null group values form a group of their own. An empty ``df``
    gives an empty result. Columns named ``_code`` or ``_n`` in ``df`` are kept apart from the operator's own. ``df`` is
    computed once and written to the shared folder with its codes.
    """
    groups = list(groups)
    inner = [f"_g{i}" for i in range(len(groups))]
    own = [f"_c{i}" for i in range(len(df.columns))]
    coded = materialize(
        df.select(
            *[F.col(f"`{g}`").alias(i) for g, i in zip(groups, inner, strict=True)],
            code.alias("_code"),
            (F.lit(n) if isinstance(n, int) else n).cast("long").alias("_n"),
            *[F.col(f"`{c}`").alias(o) for c, o in zip(df.columns, own, strict=True)],
        ).where(F.col("_code").isNotNull())
    )
    cuts = cutoffs(coded.select(*inner, "_code", "_n"), inner, "_code", "_n")
    match = F.expr(" AND ".join(f"r.{g} <=> c.{g}" for g in inner)) if inner else F.lit(True)
    chosen = coded.alias("r").join(cuts.alias("c"), match).where(
        (F.col("c.cut_len") == 0) | (F.expr("left(r._code, c.cut_len)") <= F.col("c.cut"))
    )
    return chosen.select(*[F.col(f"r.{o}").alias(c) for c, o in zip(df.columns, own, strict=True)])
