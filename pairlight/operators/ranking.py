"""Numbering and cutting within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.storage import materialize


def first_of_each(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], limit: str | int, most: int | None = None) -> DataFrame:
    """Rows numbered ``rank`` 1, 2, ... in their group, up to ``limit`` (a number, or a column that is equal in a group).

    ``most`` bounds a column limit: Spark then keeps at most so many rows of a group in every task before the shuffle, so
    a group with a third of all rows reaches its one sorting task already cut. Ties need an order that ends in a key.
    """
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long")
    rows = df.withColumn("rank", rank)
    if isinstance(limit, int):
        return rows.where(F.col("rank") <= limit)
    return (rows.where(F.col("rank") <= most) if most is not None else rows).where(F.col("rank") <= F.col(limit))


def running_index(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """Adds 0, 1, 2, ... within each group in the given order, without sorting any group in one task.

    Rows are sorted over ranges of (group, order) and written to the shared folder; within a range a row's place is
    counted from the start of its group there, and each range adds the rows that its group has in the ranges before.
    Equal order keys within a group are numbered in any order, so the order should end in a key.
    """
    groups, order = list(groups), list(order)
    ranged = materialize(df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_range").alias("_o_range"), before.alias("_before"))
    match = F.col("_range") == F.col("_o_range")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    place = F.row_number().over(W.partitionBy("_range", *groups).orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(offsets, match)
    return joined.select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))
