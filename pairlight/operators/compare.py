"""Comparisons and rankings over grouped summaries (``model_id, dataset, group_by, group_name`` and metrics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.operators.summaries import safe_ratio

HARDEST = ("accuracy", "-failure_rate", "mean_preference_margin", "group_name")
EASIEST = ("-accuracy", "failure_rate", "-mean_preference_margin", "group_name")


def _order(keys: Sequence[str]) -> list[Column]:
    return [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def ranked(rows: DataFrame, partition: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each partition with ``rank``; Spark keeps only n of a partition before the shuffle."""
    r = F.row_number().over(W.partitionBy(*partition).orderBy(*_order(order))).cast("long")
    return rows.withColumn("rank", r).where(F.col("rank") <= n)


SIDE_METRICS = ("accuracy", "failure_rate", "mean_preference_margin", "total")


def _side_by_side(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    side = lambda d, m: F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d}_{m}")
    return rows.groupBy(*keys).agg(*[side(d, m) for d in ("benchmark", "rl") for m in metrics])


def two_sides(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = SIDE_METRICS) -> DataFrame:
    """Benchmark and rl metrics of the same keys side by side, by conditional aggregation: one shuffle, no self-join.
    Keys that only one side has are left out."""
    both = _side_by_side(rows.where(F.col("dataset").isin("benchmark", "rl")), keys, metrics)
    return both.where("benchmark_total is not null and rl_total is not null")


def with_deltas(both: DataFrame) -> DataFrame:
    """Adds rl minus benchmark, ``rl_harder`` (lower accuracy or higher failure rate) and ``rl_boundary_closer``."""
    delta = lambda m: (F.col(f"rl_{m}") - F.col(f"benchmark_{m}")).alias(f"{m}_delta")
    harder = (F.col("rl_accuracy") < F.col("benchmark_accuracy")) | (F.col("rl_failure_rate") > F.col("benchmark_failure_rate"))
    closer = F.abs("rl_mean_preference_margin") < F.abs("benchmark_mean_preference_margin")
    return both.select("*", *[delta(m) for m in ("accuracy", "failure_rate", "mean_preference_margin")], harder.alias("rl_harder"), closer.alias("rl_boundary_closer"))


def shared_subtypes(grouped: DataFrame) -> DataFrame:
    rows = grouped.where("group_by = 'subtype'").withColumnRenamed("group_name", "subtype")
    return with_deltas(two_sides(rows, ["model_id", "subtype"]))


def overall_deltas(overall: DataFrame) -> DataFrame:
    """As ``shared_subtypes`` over whole datasets; a model without one of the two datasets is an error."""
    both = _side_by_side(overall, ["model_id"], SIDE_METRICS)
    whole = F.assert_true(F.col("benchmark_total").isNotNull() & F.col("rl_total").isNotNull(), F.lit("a model lacks a dataset"))
    return with_deltas(both.where(whole.isNull()))


def harder_shared(grouped: DataFrame) -> DataFrame:
    rows = shared_subtypes(grouped).where("rl_harder")
    r = F.row_number().over(W.partitionBy("model_id").orderBy(F.asc("accuracy_delta"), F.desc("failure_rate_delta"), F.asc("subtype"))).cast("long")
    return rows.select("model_id", "subtype", "accuracy_delta", "failure_rate_delta", r.alias("rank"))


def with_model_metadata(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Left join to the model dimension; a column that both have is taken from the rows. The dimension is one row a
    model; Spark broadcasts it if its size allows."""
    extra = [c for c in models.columns if c not in rows.columns]
    return rows.join(models.select("model_id", *extra), "model_id", "left")


def failure_concentration(grouped: DataFrame, top: int = 3, threshold: float = 0.6) -> DataFrame:
    """Share of a model's rl failures in its ``top`` subtypes by failure rate, failures and name."""
    rows = grouped.where("group_by = 'subtype' and dataset = 'rl'").withColumn("failures", F.col("total") - F.col("correct"))
    order = W.partitionBy("model_id").orderBy(*_order(("-failure_rate", "-failures", "group_name")))
    rows = rows.withColumn("_at", F.row_number().over(order))
    out = rows.groupBy("model_id").agg(F.sum("failures").alias("total_failures"), F.sum(F.when(F.col("_at") <= top, F.col("failures")).otherwise(0)).alias("top_failures"))
    share = safe_ratio(F.col("top_failures"), F.col("total_failures"))
    return out.select("model_id", "total_failures", "top_failures", share.alias("top_failure_share"), ((share >= threshold) & (F.col("total_failures") > 0)).alias("concentrated"))


def failure_share(grouped: DataFrame, group_by: str = "template_type") -> DataFrame:
    rows = grouped.where(F.col("group_by") == group_by).withColumn("failures", F.col("total") - F.col("correct"))
    whole = F.sum("failures").over(W.partitionBy("model_id", "dataset"))
    return rows.select("model_id", "dataset", "group_name", "failures", safe_ratio(F.col("failures"), whole).alias("failure_share"))


def coverage(rows: DataFrame) -> DataFrame:
    """Which values of each field the two datasets share. ``rows``: ``dataset, group_by, group_name``."""
    sides = rows.groupBy("group_by", "group_name").agg((F.count_if(F.col("dataset") == "benchmark") > 0).alias("b"), (F.count_if(F.col("dataset") == "rl") > 0).alias("r"))
    only = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("group_name")))), ",")
    return sides.where("b or r").groupBy("group_by").agg(
        F.count_if("b").alias("benchmark_count"), F.count_if("r").alias("rl_count"), F.count_if(F.col("b") & F.col("r")).alias("shared_count"),
        only(F.col("b") & ~F.col("r")).alias("benchmark_only"), only(F.col("r") & ~F.col("b")).alias("rl_only"), (F.count_if(F.col("b") != F.col("r")) > 0).alias("coverage_mismatch"),
    )


def distribution_mismatch(grouped: DataFrame, share_delta: float = 0.2) -> DataFrame:
    """Subtypes whose share differs by ``share_delta`` or more, or that one dataset lacks."""
    rows = grouped.where("group_by = 'subtype'")
    n = lambda d: F.sum(F.when(F.col("dataset") == d, F.col("total")).otherwise(0))
    counts = rows.groupBy("model_id", F.col("group_name").alias("subtype")).agg(n("benchmark").alias("benchmark_count"), n("rl").alias("rl_count"))
    every = W.partitionBy("model_id")
    share = lambda d: safe_ratio(F.col(f"{d}_count"), F.sum(f"{d}_count").over(every))
    out = counts.withColumn("benchmark_share", share("benchmark")).withColumn("rl_share", share("rl")).withColumn("share_delta", F.col("rl_share") - F.col("benchmark_share"))
    return out.where((F.abs("share_delta") >= share_delta) | (F.col("benchmark_count") == 0) | (F.col("rl_count") == 0))


def wide_metric(grouped: DataFrame, group_by: str, metric: str, models: Sequence[str]) -> DataFrame:
    """One row a group with a column per model and their mean (0.0 without any), in order of the mean, then name;
    descending for failure rates."""
    rows = grouped.where(F.col("group_by") == group_by)
    cells = [F.max(F.when(F.col("model_id") == m, F.col(metric))).alias(m) for m in models]
    out = rows.groupBy("group_name").agg(*cells)
    present = [F.when(F.col(m).isNotNull(), F.col(m)).otherwise(0.0) for m in models]
    some = [F.col(m).isNotNull().cast("int") for m in models]
    total, n = present[0], some[0]
    for p, s in zip(present[1:], some[1:], strict=True):
        total, n = total + p, n + s
    out = out.withColumn("mean_across_models", safe_ratio(total, n))
    mean = F.col("mean_across_models")
    return out.orderBy(mean.desc() if metric == "failure_rate" else mean.asc(), "group_name")


def ordered_by_mean(wide: DataFrame, metric: str) -> DataFrame:
    """``position`` for figures: by mean and name, the whole key reversed for failure rates."""
    keys = ["mean_across_models", "group_name"]
    order = [F.col(k).desc() if metric == "failure_rate" else F.col(k).asc() for k in keys]
    return wide.select("group_name", "mean_across_models", F.row_number().over(W.orderBy(*order)).cast("long").alias("position"))


def ordered_by_mean_delta(shared: DataFrame, metric: str) -> DataFrame:
    """``subtype, mean_delta, position``: subtypes of ``shared_subtypes`` by the models' mean delta of a metric and name,
    the whole key reversed for failure rates. Means are taken to 12 digits: they are sums of fractions in any order, and
    equal ones must tie. One row a subtype, so one window holds them."""
    means = shared.groupBy("subtype").agg(F.round(F.avg(F.col(f"rl_{metric}") - F.col(f"benchmark_{metric}")), 12).alias("mean_delta"))
    order = [F.col(k).desc() if metric == "failure_rate" else F.col(k).asc() for k in ("mean_delta", "subtype")]
    return means.select("subtype", "mean_delta", F.row_number().over(W.orderBy(*order)).cast("long").alias("position"))


def dense_metric(wide: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """A wide table with 0.0 where a model has no value, as figures draw it."""
    return wide.select(key, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in models])


def difficulty_change(grouped: DataFrame, delta: float = 0.25) -> DataFrame:
    """Subtypes whose accuracy differs by ``delta`` or more between models, widest first; needs two models. ``by_model``
    maps each model to its accuracy, failure rate and mean margin."""
    own = F.struct("model_id", F.struct("accuracy", "failure_rate", "mean_preference_margin"))
    rows = grouped.where("group_by = 'subtype'").groupBy(F.col("group_name").alias("subtype")).agg(F.min("accuracy").alias("accuracy_min"), F.max("accuracy").alias("accuracy_max"), F.map_from_entries(F.sort_array(F.collect_list(own))).alias("by_model"))
    rows = rows.where(F.size("by_model") >= 2).withColumn("accuracy_range", F.col("accuracy_max") - F.col("accuracy_min")).where(F.col("accuracy_range") >= delta)
    return rows.select("subtype", "accuracy_min", "accuracy_max", "accuracy_range", "by_model").orderBy(F.desc("accuracy_range"), "subtype")


def consistently_hard(grouped: DataFrame, n: int = 3) -> DataFrame:
    """Subtypes among the ``n`` hardest of every model that has rows."""
    top = ranked(grouped.where("group_by = 'subtype'"), ["model_id"], HARDEST, n).select("model_id", F.col("group_name").alias("subtype"))
    counts = top.groupBy("subtype").agg(F.collect_set("model_id").alias("models"))
    # n rows a model: one window holds them
    every = F.size(F.array_distinct(F.flatten(F.collect_list("models").over(W.partitionBy()))))
    return counts.withColumn("_all", every).where(F.size("models") == F.col("_all")).select("subtype")


def cross_source_hardest(sources: dict[str, DataFrame | None], n: int = 5) -> DataFrame:
    """Hardest subtypes per source, model and dataset over several runs' grouped summaries; a missing source (None)
    gives one note row. Rows without a dataset belong to ``controlled``."""
    spark = next(d for d in sources.values() if d is not None).sparkSession
    out, notes = None, []
    for label, rows in sources.items():
        if rows is None:
            notes.append((label, "missing"))
            continue
        part = rows.where("group_by = 'subtype'").withColumn("source", F.lit(label)).withColumn("dataset", F.coalesce("dataset", F.lit("controlled")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    top = ranked(out, ["source", "model_id", "dataset"], HARDEST, n).select("source", "model_id", "dataset", "rank", F.col("group_name").alias("subtype"), "accuracy", "failure_rate", "mean_preference_margin").withColumn("note", F.lit(None).cast("string"))
    if notes:
        top = top.unionByName(spark.createDataFrame(notes, "source string, note string"), allowMissingColumns=True)
    return top
