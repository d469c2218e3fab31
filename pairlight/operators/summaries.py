"""Grouped summaries of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0, negative or null."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _metrics(rates: bool) -> list[Column]:
    n = F.count(F.lit(1))
    out = [n.alias("total"), F.count_if("correct").alias("correct"), safe_ratio(F.count_if("correct"), n).alias("accuracy")]
    if rates:
        out += [safe_ratio(F.count_if("failure"), n).alias("failure_rate"), safe_ratio(F.count_if("near_failure"), n).alias("near_failure_rate")]
    return [*out, F.coalesce(F.avg("preference_margin"), F.lit(0.0)).alias("mean_preference_margin")]


def summarize(results: DataFrame, keys: Sequence[str] = (), rates: bool = True) -> DataFrame:
    """Total, correct, accuracy, (failure and near-failure rate,) mean margin by ``keys``.

    Without keys always one row, zeros for no results. Partial aggregation happens before the shuffle, so a key with a
    third of all rows costs no more than any other. Null margins are left out of the mean.
    """
    return results.groupBy(*keys).agg(*_metrics(rates)) if keys else results.agg(*_metrics(rates))


def summarize_fields(results: DataFrame, fields: Sequence[str], keys: Sequence[str] = (), nulls: str = "drop", rates: bool = True) -> DataFrame:
    """``summarize`` by each of ``fields`` on its own, as rows ``keys, group_by, group_name``, in one pass.

    Rows are exploded once into (field, value) and aggregated once. Values are text. ``nulls``: ``drop`` leaves null and
    blank values out, ``skip`` only nulls, ``literal`` counts nulls as the text ``None``.
    """
    value = {
        "drop": lambda f: F.when(F.col(f).cast("string") != "", F.col(f).cast("string")),
        "skip": lambda f: F.col(f).cast("string"),
        "literal": lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None")),
    }[nulls]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("group_by"), value(f).alias("group_name")) for f in fields]))
    needed = [c for c in ("correct", "failure", "near_failure", "preference_margin") if c in results.columns]
    long = results.select(*keys, *needed, each.alias("_g")).select(*keys, "_g.group_by", "_g.group_name", *needed)
    return summarize(long.where("group_name is not null"), [*keys, "group_by", "group_name"], rates)


def count_fields(rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts by each of ``fields`` on its own; nulls count as the text ``None``."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("group_by"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("group_name")) for f in fields]))
    return rows.select(*keys, each.alias("_g")).groupBy(*keys, "_g.group_by", "_g.group_name").agg(F.count(F.lit(1)).alias("n"))


def weighted_counts(targets: DataFrame, shapes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The distribution that target counts would give, without writing each row out: sums of the counts."""
    joined = targets.join(F.broadcast(shapes), "subtype")  # 15 shapes
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("group_by"), F.col(f).cast("string").alias("group_name")) for f in fields]))
    return joined.select("target_count", each.alias("_g")).groupBy("_g.group_by", "_g.group_name").agg(F.sum("target_count").alias("n"))


def policy_summary(results: DataFrame, policies: Sequence[str] = ("trained", "random")) -> DataFrame:
    """One row for each of ``policies``, zeros for one without results."""
    spark = results.sparkSession
    named = spark.createDataFrame([(p,) for p in policies], "policy string")
    joined = F.broadcast(named).join(summarize(results, ["policy"], rates=False), "policy", "left")
    return joined.fillna(0, ["total", "correct"]).fillna(0.0, ["accuracy", "mean_preference_margin"])


def trajectory_summary(trajectories: DataFrame) -> DataFrame:
    """Episodes, mean reward and length, mean margin, failure and near-failure rate by policy.

    A missing margin counts as 0.0, and so as a near failure (within 0.2); a missing failure flag as none.
    """
    m = F.coalesce("margin", F.lit(0.0))
    n = F.count(F.lit(1))
    return trajectories.groupBy("policy").agg(
        n.alias("episodes"), F.avg("total_reward").alias("average_reward"), F.avg("steps").alias("average_trajectory_length"),
        F.avg(m).alias("average_preference_margin"), (F.count_if(F.coalesce("model_failed", F.lit(False))) / n).alias("failure_rate"), (F.count_if(F.abs(m) <= 0.2) / n).alias("near_failure_rate"),
    )


def trajectory_histograms(trajectories: DataFrame) -> DataFrame:
    """``policy`` with the numbers of trajectories by template type and by subtype, as maps; without a final pair they
    count as ``missing``. Counted once by both fields together, so a policy with most rows is a few dozen counts."""
    name = lambda c: F.coalesce(F.col(c), F.lit("missing")).alias(c)
    counts = trajectories.select("policy", name("template_type"), name("subtype")).groupBy("policy", "template_type", "subtype").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("template_type", "subtype")]))
    long = counts.select("policy", "n", each.alias("f")).groupBy("policy", "f.field", "f.value").agg(F.sum("n").alias("n"))
    listed = lambda f: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("value", "n")))))
    return long.groupBy("policy").agg(listed("template_type").alias("template_type_distribution"), listed("subtype").alias("subtype_distribution"))


def dominance(rows: DataFrame, keys: Sequence[str], value: str, order: str, threshold: float = 0.8) -> DataFrame:
    """The most frequent value per ``keys`` with its share; ties go to the value that comes first by ``order``."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias("dominant"), F.max("n").alias("n"))
    share = safe_ratio(F.col("n"), F.col("total"))
    return best.select(*keys, "dominant", share.alias("share"), (share >= threshold).alias("collapsed"))


def incremental_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums from which ``from_counts`` makes the summary; those of several batches add up."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"), F.count_if("failure").alias("failures"), F.count_if("near_failure").alias("near_failures"), F.sum("preference_margin").alias("margin_sum"), F.count("preference_margin").alias("margins"))


def from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "correct", "failures", "near_failures", "margin_sum", "margins")])
    rate = lambda c: safe_ratio(F.col(c), F.col("total"))
    return s.select(*keys, "total", "correct", rate("correct").alias("accuracy"), rate("failures").alias("failure_rate"), rate("near_failures").alias("near_failure_rate"), F.coalesce(F.col("margin_sum") / F.nullif("margins", F.lit(0)), F.lit(0.0)).alias("mean_preference_margin"))
