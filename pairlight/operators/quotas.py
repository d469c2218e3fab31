"""Quotas, matched samples and quota-bound selection of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions.text import md5_number
from pairlight.operators.ranking import first_of_each, running_index
from pairlight.operators.summaries import safe_ratio
from pairlight.storage import materialize


def scale_counts(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Largest-remainder scaling of counts to ``total``; equal remainders go to the greater key; zeros are left out.
    The groups are few (one a subtype), so one window holds them."""
    if total <= 0:
        raise ValueError("the total must be positive")
    every = W.partitionBy()
    raw = F.col(n) * F.lit(float(total)) / F.sum(n).over(every)
    rows = counts.select(key, raw.alias("_raw")).withColumn("_floor", F.floor("_raw").cast("long"))
    rows = rows.withColumn("_at", F.row_number().over(every.orderBy((F.col("_raw") - F.col("_floor")).desc(), F.desc(key)))).withColumn("_left", F.lit(total) - F.sum("_floor").over(every))
    return rows.select(key, (F.col("_floor") + F.when(F.col("_at") <= F.col("_left"), 1).otherwise(0)).alias("target_count")).where("target_count > 0")


def target_counts(counts: DataFrame, allowed: DataFrame, total: int | None = None) -> DataFrame:
    """Targets per subtype from observed counts, limited to ``allowed`` subtypes, scaled to ``total`` if one is given."""
    kept = counts.join(F.broadcast(allowed.select("subtype").distinct()), "subtype", "left_semi")
    return scale_counts(kept, "subtype", "n", total) if total else kept.select("subtype", F.col("n").alias("target_count")).where("target_count > 0")


def cap_counts(counts: DataFrame, key: str, n: str, cap: int) -> DataFrame:
    """Takes units off the largest group (ties: the greatest name) until the sum is at most ``cap``.

    By arithmetic on the groups' counts, so no unit is written out: with the groups in rising order, the level that those
    from a group on can share is what the smaller ones leave of ``cap``. The level is the first that is under its group's
    count; groups beyond it keep the level, and one more in name order as far as ``cap`` reaches. Groups left with none
    are left out. The groups are few (one a subtype), so one window holds them.
    """
    cap = max(cap, 0)
    every = W.partitionBy()
    rising = every.orderBy(n, key)
    rows = counts.where(F.col(n) > 0).select(key, F.col(n).cast("long").alias(n))
    before = F.coalesce(F.sum(n).over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    behind = F.count(F.lit(1)).over(rising.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_level", F.floor((F.lit(cap) - before) / behind))
    rows = rows.withColumn("_level", F.max(F.when(F.col("_level") < F.col(n), F.greatest("_level", F.lit(0)))).over(every))
    over = F.coalesce(F.col(n) > F.col("_level"), F.lit(False))
    rows = rows.withColumn("_over", over).withColumn("_kept", F.least(n, "_level"))
    rows = rows.withColumn("_rest", F.lit(cap) - F.sum("_kept").over(every)).withColumn("_at", F.row_number().over(W.partitionBy("_over").orderBy(key)))
    kept = F.col("_kept") + F.when(F.col("_over") & (F.col("_at") <= F.col("_rest")), 1).otherwise(0)
    return rows.select(key, kept.alias(n)).where(F.col(n) > 0)


def matched_plan(pairs: DataFrame, group: str, requested: int, cap: int | None = None) -> DataFrame:
    """Per group what each dataset has, how many are drawn from both, and why fewer than asked."""
    rows = pairs.where(F.col(group).isNotNull() & (F.col(group).cast("string") != ""))
    side = lambda d: F.count_if(F.col("dataset") == d)
    plan = rows.groupBy(F.col(group).cast("string").alias("group_name")).agg(side("benchmark").alias("benchmark_available"), side("rl").alias("rl_available"))
    plan = plan.withColumn("wanted", F.least(F.lit(requested), "benchmark_available", "rl_available").cast("long"))
    if cap is not None:
        capped = cap_counts(plan.where("wanted > 0").select("group_name", "wanted"), "group_name", "wanted", cap).withColumnRenamed("wanted", "sampled")
        plan = plan.join(capped, "group_name", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)).cast("long"))
    else:
        plan = plan.withColumn("sampled", F.col("wanted"))
    status = (
        F.when((F.col("sampled") <= 0) & (F.col("benchmark_available") > 0) & (F.col("rl_available") > 0), "dropped_by_total_cap")
        .when(F.col("sampled") <= 0, "insufficient_examples")
        .when(F.col("sampled") < requested, "limited_by_available_examples")
        .otherwise("matched")
    )
    return plan.select("group_name", "benchmark_available", "rl_available", "sampled", status.alias("status"))


def matched_sample(pairs: DataFrame, plan: DataFrame, group: str, seed: str = "42") -> DataFrame:
    """``sampled`` pairs of each dataset and group: those with the smallest MD5 of seed and id. The same rows at any
    partitioning; exact replay of a sequential generator needs that generator. The plan, one row a group, is computed once."""
    plan = materialize(plan.select(F.col("group_name").alias(group), "sampled"))
    rows = pairs.join(F.broadcast(plan), group)
    most = plan.agg(F.max("sampled")).first()[0] or 0
    return first_of_each(rows, ["dataset", group], [md5_number(F.lit(seed), "pair_id"), F.col("pair_id")], "sampled", most).drop("rank", "sampled")


def matched_groups(plan: DataFrame, requested: int) -> DataFrame:
    """The summary of a matched plan by group, in one row: both totals, whether the datasets match, the number of matched
    groups and their samples as a map, the dropped groups by reason, and the groups below the requested number."""
    some = F.col("sampled") > 0
    names = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("group_name"))))
    per_group = F.map_from_entries(F.sort_array(F.collect_list(F.when(some, F.struct("group_name", "sampled")))))
    return plan.agg(
        F.coalesce(F.sum("sampled"), F.lit(0)).alias("benchmark_total"), F.coalesce(F.sum("sampled"), F.lit(0)).alias("rl_total"),
        F.coalesce(F.bool_and((F.col("sampled") <= F.col("benchmark_available")) & (F.col("sampled") <= F.col("rl_available"))), F.lit(True)).alias("distribution_matched"),
        names(some).alias("matched_groups"), F.count_if(some).alias("matched_group_count"), per_group.alias("examples_per_matched_group"),
        names(F.col("status") == "insufficient_examples").alias("dropped_groups_due_to_insufficient_examples"), names(F.col("status") == "dropped_by_total_cap").alias("dropped_groups_due_to_total_cap"),
        F.sort_array(F.collect_list(F.when(some & (F.col("sampled") < requested), F.struct(F.col("group_name").alias("group"), F.col("sampled").alias("sampled_per_dataset"), F.lit(requested).alias("requested_per_group"))))).alias("limited_groups_below_requested_count"),
    )


def matched_plan_or_fallback(pairs: DataFrame, requested: int, cap: int | None = None, fields: Sequence[str] = ("subtype", "template_type")) -> tuple[DataFrame, str]:
    """The matched plan by the first of ``fields`` that gives any group a sample (the last one anyway), and that field."""
    for field in fields:
        plan = materialize(matched_plan(pairs, field, requested, cap))
        if field == fields[-1] or not plan.where("sampled > 0").isEmpty():
            return plan, field
    raise ValueError("no field")


def matched_summary(plan: DataFrame) -> DataFrame:
    names = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("group_name")))), ",")
    return plan.agg(F.sum("sampled").alias("sampled_per_dataset"), names("matched").alias("matched"), names("limited_by_available_examples").alias("limited"), names("dropped_by_total_cap").alias("dropped"), names("insufficient_examples").alias("insufficient"))


def compare_distribution(targets: DataFrame, achieved: DataFrame) -> DataFrame:
    """Target against achieved counts per subtype, from either side, with missing, extra and shares."""
    rows = targets.select("subtype", "target_count").join(achieved.select("subtype", "achieved_count"), "subtype", "full_outer").fillna(0, ["target_count", "achieved_count"])
    every = W.partitionBy()
    over = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0)).cast("long")
    return rows.select(
        "subtype", F.col("target_count").cast("long").alias("target_count"), F.col("achieved_count").cast("long").alias("achieved_count"), over("target_count", "achieved_count").alias("missing_count"), over("achieved_count", "target_count").alias("extra_count"),
        safe_ratio(F.col("target_count"), F.sum("target_count").over(every)).alias("target_share"), safe_ratio(F.col("achieved_count"), F.sum("achieved_count").over(every)).alias("achieved_share"),
    )


def candidate_hardness(candidates: DataFrame, quotas: DataFrame, order: Sequence[str], near: float = 0.01, failure: float = 1.0, boundary: float = 0.5, margin: float = 0.1, bonus: float = 0.25, penalty: float = 0.5) -> DataFrame:
    """Scores of distinct candidates (the first of each sentence pair by ``order``) in their pool's order.

    The place in the pool, counted before insertion, drives the bonus for thin pools and the penalty for full ones.
    """
    rows = first_of_each(candidates, ["subtype", "grammatical", "ungrammatical"], order, 1).drop("rank")
    rows = rows.join(F.broadcast(quotas.select("subtype", "target_count")), "subtype")  # one row a subtype
    rows = running_index(rows, ["subtype"], order, "pool_index")
    progress = F.col("pool_index") / F.greatest(F.col("target_count"), F.lit(1))
    m = F.col("preference_margin")
    edge = F.greatest(F.lit(0.0), near - F.abs(m)) / near if near > 0 else F.lit(0.0)
    rows = rows.withColumn("boundary_score", edge).withColumn("diversity_bonus", F.greatest(F.lit(0.0), 1.0 - progress) * bonus).withColumn("over_quota_penalty", F.greatest(F.lit(0.0), progress - 1.0) * penalty)
    hardness = failure * F.col("model_failed").cast("double") + boundary * F.col("boundary_score") - margin * m + F.col("diversity_bonus") - F.col("over_quota_penalty")
    return rows.withColumn("hardness_score", hardness)


def select_candidates(scored: DataFrame, quotas: DataFrame | None = None) -> DataFrame:
    """The ``target_count`` hardest candidates of each subtype; ties by lower margin, then sentence. ``quotas``, one row a
    subtype, tells the largest target without a pass over the candidates."""
    most = (scored if quotas is None else quotas).agg(F.max("target_count")).first()[0] or 0
    return first_of_each(scored, ["subtype"], [F.desc("hardness_score"), F.asc("preference_margin"), F.asc("grammatical")], "target_count", most)
