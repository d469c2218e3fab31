"""Samples whose share of each category matches given targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.llm.topn import cutoffs, text_code
from pairlight.storage import materialize


def quotas(targets: DataFrame, pool: Sequence[str], category: str, total: str | None = None, keep_total: bool = False) -> DataFrame:
    """``pool + category, target_count, min_count, quota``: integer quotas by largest remainder with minimum floors.

    ``targets``: ``pool + category, target_count, min_count``, one row a category (``total``: a column with the wanted
    sample size of the pool; else the sum of its targets, which leaves every target as it is). Null or negative counts
    are 0. Ties of the remainder go to the smaller category name. A quota below its floor is raised to it: on top of the
    size, or with ``keep_total`` at the cost of the pool's other categories, which share in proportion what the floors
    leave (a floor then counts wherever the category's share of that is less); only floors that exceed the size by
    themselves exceed it then. A pool's targets are few, so one window holds them.
    """
    keys = [*pool, category]
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    every = W.partitionBy(*pool)
    t = targets.select(*keys, count("target_count").alias("target_count"), count("min_count").alias("min_count"), (F.greatest(F.col(total).cast("long"), F.lit(0)) if total else F.lit(None).cast("long")).alias("_size"))
    t = t.withColumn("_size", F.coalesce("_size", F.sum("target_count").over(every)))
    if keep_total:
        # Floors in falling order of floor per target: each is tested against what is left for it and those behind it.
        # The first that is not needed ends them, as what is left for the others only grows with it.
        ratio = F.when(F.col("target_count") > 0, F.col("min_count") / F.col("target_count")).otherwise(float("inf"))
        order = every.orderBy(F.desc("_ratio"), F.col(category))
        t = t.withColumn("_ratio", ratio)
        t = t.withColumn("_left", F.col("_size") - F.coalesce(F.sum("min_count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        t = t.withColumn("_behind", F.sum("target_count").over(order.rowsBetween(0, W.unboundedFollowing)))
        needed = (F.col("target_count") == 0) | (wide("min_count") * wide("_behind") > wide("target_count") * wide("_left"))
        t = t.withColumn("_fixed", F.min(needed).over(order.rowsBetween(W.unboundedPreceding, 0)))
    else:
        t = t.withColumn("_fixed", F.lit(False))
    free = lambda c: F.when(F.col("_fixed"), 0).otherwise(F.col(c))
    taken = F.sum(F.when(F.col("_fixed"), F.col("min_count")).otherwise(0)).over(every)
    t = t.withColumn("_sum", F.sum(free("target_count")).over(every)).withColumn("_share_of", F.greatest(F.col("_size") - taken, F.lit(0)))
    product = free("target_count").cast("decimal(19,0)") * wide("_share_of")
    t = t.withColumn("_base", F.when(F.col("_sum") > 0, F.floor(product / F.col("_sum"))).otherwise(0).cast("long"))
    t = t.withColumn("_rest", F.when(F.col("_sum") > 0, product - F.col("_base") * F.col("_sum")).otherwise(0))
    t = t.withColumn("_left", F.col("_share_of") - F.sum("_base").over(every))
    t = t.withColumn("_rank", F.row_number().over(every.orderBy(F.desc("_rest"), F.col(category))))
    quota = F.greatest(F.col("_base") + F.when((F.col("_rank") <= F.col("_left")) & (F.col("_rest") > 0), 1).otherwise(0), F.col("min_count"))
    return t.select(*keys, "target_count", "min_count", quota.alias("quota"))


def _report(wanted: DataFrame, achieved: DataFrame, pool: Sequence[str], category: str) -> DataFrame:
    """Joins ``achieved`` (``pool + category, available, achieved_count``) to the quotas; adds what is missing and shares."""
    every = W.partitionBy(*pool)
    zero = F.lit(0).cast("long")
    out = wanted.join(achieved, [*pool, category], "left").withColumn("available", F.coalesce("available", zero)).withColumn("achieved_count", F.coalesce("achieved_count", zero))
    share = lambda c: F.when(F.sum(c).over(every) > 0, F.col(c) / F.sum(c).over(every)).otherwise(0.0)
    out = out.withColumn("missing_count", F.col("quota") - F.col("achieved_count"))
    return out.withColumn("target_share", share("target_count")).withColumn("achieved_share", share("achieved_count"))


def allocate(targets: DataFrame, available: DataFrame, pool: Sequence[str], category: str, total: str | None = None, keep_total: bool = False) -> DataFrame:
    """A plan before anything is drawn: ``quotas``, capped by what is available.

    ``available``: ``pool + category, available``. Result: one row per target with ``quota`` (before caps), ``available``,
    ``achieved_count``, ``missing_count`` and both shares. A shortfall is reported, never filled from other categories, as
    that would move their shares away from the targets.
    """
    wanted = quotas(targets, pool, category, total, keep_total)
    keys = [*pool, category]
    capped = wanted.select(*keys, "quota").join(available, keys).select(*keys, "available", F.least("quota", "available").alias("achieved_count"))
    return _report(wanted, capped, pool, category)


def match_targets(items: DataFrame, targets: DataFrame, pool: Sequence[str], category: str, item: str, seed: int = 42, total: str | None = None, keep_total: bool = False) -> tuple[DataFrame, DataFrame]:
    """A sample of distinct items and its report, in which ``available`` and ``achieved_count`` are counted.

    ``items``: ``pool + category, item`` (a text key; repeated keys of a category count once; other columns are not
    carried, join them back by the keys). Rows with a null pool, category or key belong to no category and are left out,
    as are categories without a target. The sample takes, of every category, the ``quota`` items with the smallest
    pseudo-random keys (MD5 of seed, category and item), or all where there are fewer; the cut of each category is found
    by bisection (``topn.cutoffs``), so a category with a third of all rows is neither sorted nor gathered. The same seed
    gives the same sample however the data are split. A shortfall is reported, never filled from other categories. Empty
    items give an empty sample and a report of shortfalls; empty targets give two empty results.
    """
    keys = [*pool, category]
    wanted = materialize(quotas(targets, pool, category, total, keep_total))
    distinct = materialize(items.select(*keys, item).dropna().distinct())
    random = F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], item)), text_code(item))
    coded = distinct.join(wanted.select(*keys, "quota"), keys).withColumn("_code", random)
    cuts = cutoffs(coded, keys, "_code", "quota")
    sample = materialize(coded.join(cuts, keys).where((F.col("cut_len") == 0) | (F.expr("left(_code, cut_len)") <= F.col("cut"))).select(*keys, item))
    available = distinct.groupBy(*keys).agg(F.count("*").alias("available"))
    drawn = sample.groupBy(*keys).agg(F.count("*").alias("achieved_count"))
    return sample, materialize(_report(wanted, available.join(drawn, keys, "left"), pool, category))
