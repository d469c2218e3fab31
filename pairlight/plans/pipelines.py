"""Whole runs from a configuration: load or generate, score, summarise, compare, write."""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions.rewards import RewardWeights
from pairlight.functions.text import distance_bucket, model_key, parse_bool
from pairlight.operators import compare, diagnostics, generate, quotas, scoring, search, summaries
from pairlight.sources import records, sinks
from pairlight.storage import materialize

LOG = logging.getLogger("pairlight")
FIELDS = ["template_type", "subtype", "dependency_distance_bucket", "clause_depth"]
Config = dict[str, Any]
Paths = dict[str, str]


def configuration(config: str | Config) -> Config:
    return records.read_config(config) if isinstance(config, str) else config


def with_columns(pairs: DataFrame) -> DataFrame:
    """Loaded pairs with the generator's metadata as typed columns; ``subtype`` keeps its fallback chain for reports,
    ``raw_subtype`` the record's own value for matching."""
    m = F.col("metadata")
    whole = lambda c: m[c].try_cast("int").alias(c)
    return pairs.select(
        "pair_id", "phenomenon", "grammatical", "ungrammatical", F.col("subtype").alias("raw_subtype"),
        F.coalesce(F.when(F.trim("subtype") != "", F.col("subtype")), m["linguistic_term"], m["linguistics_term"], m["field"]).alias("subtype"),
        m["template_type"].alias("template_type"), whole("dependency_distance"), whole("attractor_count"), whole("clause_depth"),
    )


def load(spark: SparkSession, entry: str | Config, dataset: str | None = None) -> DataFrame:
    entry = {"path": entry} if isinstance(entry, str) else entry
    rows = with_columns(records.load_pairs(spark, entry["path"], entry.get("phenomenon", "agreement")))
    return rows.withColumn("dataset", F.lit(dataset)) if dataset else rows


def scorers(config: Config) -> dict[str, scoring.Scorer]:
    """Enabled models by id. All of a model's options reach its scorer."""
    out = {}
    for m in config.get("models") or [{"provider": "dry_run", "id": "length"}]:
        if not m.get("enabled", True):
            continue
        key = (m.get("id") or (m.get("name") or "").replace("/", "_").replace(":", "_") or "model").strip()
        if scoring.is_judge(m.get("provider", "length")) and "client" not in m:
            m = {**m, "client": scoring.remote_client(m.get("name") or "", m.get("api_key_env", "OPENAI_API_KEY"), m.get("instructions", scoring.INSTRUCTIONS), m.get("max_output_tokens", 32))}
        options = {k: v for k, v in {"normalize": m.get("normalize_by_token_count"), "device": m.get("device"), "dtype": m.get("torch_dtype"), "client": m.get("client"), "loader": m.get("loader")}.items() if v is not None}
        out[key] = scoring.build_scorer(scoring.ScorerOptions(m.get("provider", "length"), m.get("name"), options))
    return out


def model_table(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(m.get("id"), m.get("name"), m.get("provider"), m.get("label")) for m in config.get("models") or [] if m.get("enabled", True)]
    d = spark.createDataFrame(rows, "id string, name string, provider string, label string")
    return d.select(model_key("id", "name").alias("model_id"), F.col("name").alias("model_name"), F.col("provider").alias("model_provider"), F.coalesce("label", "id").alias("model_label"))


def _cap_of(config: Config, model: str) -> int | None:
    """A model's own example cap, also a blank one, goes before the global cap."""
    for m in config.get("models") or []:
        if (m.get("id") or m.get("name")) == model and "max_examples_per_dataset" in m:
            return m["max_examples_per_dataset"]
    return config.get("evaluation", {}).get("max_examples_per_dataset")


def as_pairs(rows: DataFrame) -> DataFrame:
    """Records under the names of pairs, with all their columns."""
    return rows.withColumnsRenamed({"uid": "pair_id", "sentence_good": "grammatical", "sentence_bad": "ungrammatical"})


def score(pairs: DataFrame, config: Config) -> tuple[DataFrame, list[dict[str, str]]]:
    e = config.get("evaluation", {})
    out, errors = None, []
    for name, scorer in scorers(config).items():
        cap = _cap_of(config, name)
        rows = scoring.head_per_group(pairs, ["dataset"], ["pair_id"], int(cap)) if cap else pairs
        got, bad = scoring.score_each_model(rows, {name: scorer}, e.get("near_failure_margin", scoring.NEAR_FAILURE_MARGIN), e.get("continue_on_error", True))
        errors += bad
        if got is not None:
            out = got if out is None else out.unionByName(got)
    if out is None:
        raise RuntimeError(f"no model gave results: {errors}")
    return out, errors


def _matched_key(config: Config, *names: str) -> Any:
    """The first of several names of a setting that is there and not blank."""
    return next((config[n] for n in names if config.get(n) not in (None, "")), None)


def run_comparison(spark: SparkSession, config: str | Config) -> Paths:
    """Benchmark against rl pairs under all enabled models, with every summary, comparison and the report."""
    config = configuration(config)
    e, out = config.get("evaluation", {}), Path(config["outputs"]["comparison_dir"])
    pairs = load(spark, config["inputs"]["benchmark"], "benchmark").unionByName(load(spark, config["inputs"]["rl"], "rl"))
    paths: dict[str, Path] = {}
    if matched := config.get("matched_subset"):
        if matched.get("enabled", True):
            seed, asked, cap = config.get("experiment", {}).get("seed", 42), _matched_key(matched, "examples_per_shared_subtype", "examples_per_group") or 2, _matched_key(matched, "max_total_examples_per_dataset", "max_total_examples")
            wanted = matched.get("group_by", "raw_subtype")
            plan, field = quotas.matched_plan_or_fallback(pairs, int(asked), int(cap) if cap is not None else None, list(dict.fromkeys([wanted, "template_type"])))
            pairs = materialize(quotas.matched_sample(pairs, plan, field, str(seed)))
            paths["matched_groups"] = sinks.write_csv(plan, out / "matched_subset_groups.csv")
            paths["matched_pairs"] = sinks.write_rows(pairs.drop("dataset"), out / "matched_pairs.jsonl", "json")
            matched_summary = sinks.rows_of(quotas.matched_groups(plan, int(asked)))[0] | {"enabled": True, "seed": seed, "matching_field": field.removeprefix("raw_"), "exact_subtype_match": field == wanted, "fallback_to_template_type": field != wanted, "requested_examples_per_shared_subtype": int(asked), "max_total_examples_per_dataset": cap}
            paths["matched_summary"] = sinks.write_json(matched_summary, out / "matched_subset_summary.json")
    results, errors = score(pairs, config)
    overall = materialize(summaries.summarize(results, ["model_id", "dataset"]))
    grouped = materialize(summaries.summarize_fields(results, e.get("group_by", FIELDS), ["model_id", "dataset"]))
    shared = materialize(compare.shared_subtypes(grouped))
    paths["results"] = sinks.write_rows(results, out / "benchmark_vs_rl_results.csv")
    orders = {f"order_by_{m}_delta": compare.ordered_by_mean_delta(shared, m) for m in ("accuracy", "failure_rate", "mean_preference_margin")}
    tables = {
        "overall_summary": overall, "grouped_summary": grouped, "shared_subtype_comparison": shared, **orders,
        "hardest_subtypes": compare.ranked(grouped.where("group_by = 'subtype'"), ["model_id", "dataset"], compare.HARDEST, e.get("hard_subtype_top_n", 5)),
        "easiest_subtypes": compare.ranked(grouped.where("group_by = 'subtype'"), ["model_id", "dataset"], compare.EASIEST, e.get("hard_subtype_top_n", 5)),
        "template_failure_share": compare.failure_share(grouped),
    }
    if runs := config.get("cross_run_sources"):
        sources = {r["label"]: records.read_csv(spark, r["path"]) if Path(r["path"]).is_file() else None for r in runs}
        numbers = ("accuracy", "failure_rate", "mean_preference_margin", "total", "correct")
        typed = {k: None if d is None else d.withColumnRenamed("group", "group_name").select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in d.withColumnRenamed("group", "group_name").columns], *([] if "dataset" in d.columns else [F.lit(None).cast("string").alias("dataset")])) for k, d in sources.items()}
        tables["cross_run_hardest"] = compare.cross_source_hardest({"current": grouped, **typed})
    for name, df in tables.items():
        paths[name] = sinks.write_csv(df, out / f"benchmark_vs_rl_{name}.csv")
    report = {
        "overall": sinks.rows_of(compare.overall_deltas(overall)), "shared_subtypes": sinks.rows_of(shared), "harder_in_rl": sinks.rows_of(compare.harder_shared(grouped)),
        "coverage": sinks.rows_of(compare.coverage(grouped)), "distribution_warnings": sinks.rows_of(compare.distribution_mismatch(grouped, e.get("distribution_share_delta", 0.2))),
        "concentration": sinks.rows_of(compare.failure_concentration(grouped, e.get("concentration_top_n", 3), e.get("concentration_failure_share_threshold", 0.6))), "errors": errors,
    }
    paths["report_json"] = sinks.write_json(report, out / "benchmark_vs_rl_summary.json")
    lines = ["# Benchmark and RL pairs compared", "", "RL counts as harder where its accuracy is lower or its failure rate higher; margins are shown but do not decide.", "", "## Overall", ""]
    lines += sinks.markdown_table(report["overall"], ["model_id", "benchmark_accuracy", "rl_accuracy", "accuracy_delta", "failure_rate_delta", "rl_harder", "rl_boundary_closer"])
    lines += ["", "## Distribution", "", *([f"- {w['model_id']}: {w['subtype']} differs by {w['share_delta']:.3f}" for w in report["distribution_warnings"][:6]] or ["Subtype shares match at the threshold."])]
    lines += ["", "## Concentration of failures", "", *[f"- {c['model_id']}: {'' if c['concentrated'] else 'not '}concentrated; top share {c['top_failure_share']:.3f}" for c in report["concentration"]]]
    lines += ["", "## Shared subtypes", "", *sinks.markdown_table(report["shared_subtypes"], ["model_id", "subtype", "benchmark_accuracy", "rl_accuracy", "accuracy_delta", "rl_harder"])]
    lines += ["", "## Harder in RL", "", *sinks.markdown_table(report["harder_in_rl"], ["model_id", "rank", "subtype", "accuracy_delta", "failure_rate_delta"])]
    lines += ["", "## Coverage", "", *sinks.markdown_table(report["coverage"], ["group_by", "benchmark_count", "rl_count", "shared_count", "benchmark_only", "rl_only"])]
    lines += ["", "## Errors", "", *([f"- {x['model_id']}: {x['error']}" for x in errors] or ["None."])]
    paths["report"] = sinks.write_text(lines, out / "benchmark_vs_rl_report.md")
    if figures := config["outputs"].get("figures_dir"):
        folder, models = Path(figures), [r["model_id"] for r in report["overall"]]
        for metric in ("accuracy", "failure_rate", "mean_preference_margin"):
            title = metric.replace("_", " ").capitalize()
            drawn = {f"overall_{metric}": sinks.bar_figure(report["overall"], "model_id", [f"benchmark_{metric}", f"rl_{metric}"], title, folder / f"overall_{metric}.png")}
            place = {r["subtype"]: r["position"] for r in sinks.rows_of(orders[f"order_by_{metric}_delta"])}
            by_subtype: dict[str, dict] = {}
            for r in report["shared_subtypes"]:
                by_subtype.setdefault(r["subtype"], {"subtype": r["subtype"]})[r["model_id"]] = r[f"{metric}_delta"]
            rows = sorted(by_subtype.values(), key=lambda r: place[r["subtype"]])
            drawn[f"shared_subtype_{metric}"] = sinks.bar_figure(rows, "subtype", models, f"{title}, RL less benchmark", folder / f"shared_subtype_{metric}.png")
            paths |= {k: v for k, v in drawn.items() if v}
    return {k: str(v) for k, v in paths.items()}


def run_subtype_analysis(spark: SparkSession, config: str | Config) -> Paths:
    config = configuration(config)
    e, out = config.get("evaluation", {}), Path(config["outputs"]["analysis_dir"])
    results, errors = score(load(spark, config["inputs"]["dataset"], "controlled"), config)
    models = list(scorers(config))
    overall = compare.with_model_metadata(summaries.summarize(results, ["model_id"]), model_table(spark, config))
    grouped = materialize(summaries.summarize_fields(results, e.get("group_by", FIELDS), ["model_id"], nulls="literal"))
    n = e.get("hard_subtype_top_n", 3)
    across = grouped.where(F.col("group_by").isin("subtype", "template_type")).orderBy("group_by", "group_name", "model_id")
    tables = {"model_summary": overall, "grouped_summary": grouped, "cross_model_comparison": across}
    for group in ("subtype", "template_type"):
        for metric in ("accuracy", "failure_rate", "mean_preference_margin"):
            tables[f"{metric}_by_{group}"] = compare.wide_metric(grouped, group, metric, models).withColumnRenamed("group_name", group)
    paths = {k: sinks.write_csv(df, out / f"subtype_analysis_{k}.csv") for k, df in tables.items()}
    paths["results"] = sinks.write_rows(results, out / "subtype_analysis_results.csv")
    if figures := config["outputs"].get("figures_dir"):
        for group in ("subtype", "template_type"):
            for metric in ("accuracy", "failure_rate", "mean_preference_margin"):
                wide = compare.wide_metric(grouped, group, metric, models)
                place = {r["group_name"]: r["position"] for r in sinks.rows_of(compare.ordered_by_mean(wide, metric))}
                rows = sorted(sinks.rows_of(compare.dense_metric(wide, "group_name", models)), key=lambda r: place[r["group_name"]])
                if got := sinks.bar_figure(rows, "group_name", models, metric.replace("_", " ").capitalize(), Path(figures) / f"{metric}_by_{group}.png"):
                    paths[f"figure_{metric}_by_{group}"] = got
    subtypes = grouped.where("group_by = 'subtype'")
    summary = {
        "hardest": sinks.rows_of(compare.ranked(subtypes, ["model_id"], compare.HARDEST, n)), "easiest": sinks.rows_of(compare.ranked(subtypes, ["model_id"], compare.EASIEST, n)),
        "consistently_hard": [r["subtype"] for r in sinks.rows_of(compare.consistently_hard(grouped, n).orderBy("subtype"))],
        "difficulty_change": sinks.rows_of(compare.difficulty_change(grouped, e.get("difficulty_change_delta", 0.25))), "errors": errors,
    }
    paths["summary"] = sinks.write_json(summary, out / "subtype_analysis_summary.json")
    lines = ["# Subtypes by model", "", "Consistently hard: " + (", ".join(summary["consistently_hard"]) or "none"), "", *sinks.markdown_table(summary["hardest"], ["model_id", "rank", "group_name", "accuracy", "failure_rate", "mean_preference_margin"])]
    lines += ["", "## Across models", "", *sinks.markdown_table(sinks.rows_of(across.limit(20)), ["group_by", "group_name", "model_id", "accuracy", "failure_rate"])]
    paths["report"] = sinks.write_text(lines, out / "subtype_analysis_summary.md")
    return {k: str(v) for k, v in paths.items()}


def run_sanity_check(spark: SparkSession, config: str | Config) -> Paths:
    """Distribution, validation, duplicates, vocabulary, disagreement and extreme examples of two generated sets and
    their comparison's results (the results file may be left out: then the sets are scored anew)."""
    config = configuration(config)
    out, n = Path(config["outputs"]["sanity_dir"]), int(config.get("sample_size", 20))
    both = load(spark, config["inputs"]["benchmark"], "benchmark").unionByName(load(spark, config["inputs"]["rl"], "rl"))
    both = materialize(records.to_records(both))
    if path := config["inputs"].get("results"):
        raw = records.read_csv(spark, path)
        kinds = {"preference_margin": "double", "grammatical_score": "double", "ungrammatical_score": "double"}
        results = raw.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else parse_bool(c).alias(c) if c in ("correct", "failure", "near_failure") else F.col(c) for c in raw.columns])
    else:
        results, _ = score(as_pairs(both), config)
    results = materialize(results)
    rl = both.where("dataset = 'rl'")
    tables = {
        "pair_validation": diagnostics.validate(rl), "duplicate_examples": diagnostics.duplicate_rows(rl, ["sentence_good", "sentence_bad"]), "lexical_by_subtype": diagnostics.lexical_summary(both, ["dataset", "subtype"], "uid").drop("top_pattern_share"),
        "model_disagreement": diagnostics.disagreement(results), "tiny_extreme_failures": diagnostics.extreme_failures(results),
        "manual_tiny_hardest_rl": diagnostics.hardest_examples(results, diagnostics.TINY, "rl", n), "manual_gpt2_hardest_rl": diagnostics.hardest_examples(results, diagnostics.STRONGER[1], "rl", n), "manual_shared_subtype_examples": diagnostics.shared_examples(results, n),
    }
    paths = {k: sinks.write_csv(df, out / f"sanity_check_{k}.csv") for k, df in tables.items()}
    counts = summaries.count_fields(both.withColumn("dependency_distance_bucket", distance_bucket("dependency_distance")), FIELDS, ["dataset"])
    keys = {"pair": ["sentence_good", "sentence_bad"], "good": ["sentence_good"], "bad": ["sentence_bad"], "uid": ["uid"]}
    summary = {
        "distribution": sinks.rows_of(counts), "coverage": sinks.rows_of(compare.coverage(counts)), "duplicates": sinks.rows_of(diagnostics.duplicate_summary(rl, keys)), "lexical": sinks.rows_of(diagnostics.lexical_summary(both, ["dataset"], "uid", 10)),
        "flags": sinks.rows_of(diagnostics.collapse_flags(both, results))[0], "disagreement": sinks.rows_of(diagnostics.disagreement(results).groupBy("dataset", "category").count().orderBy("dataset", "category")),
        "stronger_hard_subtypes": sinks.rows_of(diagnostics.stronger_hard_subtypes(results)),
    }
    paths["summary"] = sinks.write_json(summary, out / "sanity_check_summary.json")
    f = summary["flags"]
    lines = ["# Sanity check", "", *[f"- {k}: {v:.3f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in f.items()], "", "## Disagreement", "", *[f"- {r['dataset']}:{r['category']}: {r['count']}" for r in summary["disagreement"]]]
    paths["report"] = sinks.write_text(lines, out / "sanity_check_report.md")
    return {k: str(v) for k, v in paths.items()}


def run_generation(spark: SparkSession, config: str | Config) -> Paths:
    config = configuration(config)
    g = config.get("generation", {})
    seed = config.get("experiment", {}).get("seed", 42)
    count, balanced = int(g.get("count", 15)), bool(g.get("balanced", False))
    if g.get("exact_replay"):
        rows = spark.createDataFrame(list(generate.replay_pairs(count, seed, balanced))).select(*generate.PAIR_FIELDS)
    else:
        rows = generate.generate_pairs(spark, count, balanced, str(seed))
    out = Path(config["outputs"]["path"])
    paths = {"pairs": sinks.write_rows(rows, out, "json")}
    if table := config["outputs"].get("csv_path"):
        paths["csv"] = sinks.write_rows(rows, table, columns=generate.PAIR_FIELDS)
    return {k: str(v) for k, v in paths.items()}


def run_quota_generation(spark: SparkSession, config: str | Config) -> Paths:
    """Hard candidates by subtype quotas. Each subtype's attempts (quota times ``attempts_per_target``) are made in one
    batch; repeated and invalid ones are spent. The order within a subtype, which drives the bonuses, is that of the
    attempts; how draws interleave between subtypes has no effect on it."""
    config = configuration(config)
    g, out = config.get("generation", {}), Path(config["outputs"]["dir"])
    shapes = generate.templates(spark, subtypes=g.get("target_subtypes") or ())
    if explicit := g.get("target_counts"):
        known = {r.subtype for r in shapes.collect()}
        if unknown := set(explicit) - known:
            raise ValueError(f"quotas for unknown subtypes: {sorted(unknown)}")
        targets = spark.createDataFrame([(s, int(n)) for s, n in explicit.items() if int(n) > 0], "subtype string, target_count long")
    else:
        if source := config.get("inputs", {}).get("benchmark_distribution", {}).get("path"):
            counts = load(spark, source).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = shapes.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
        targets = quotas.target_counts(counts, shapes, g.get("target_total"))
    targets = materialize(targets)
    tries = int(g.get("attempts_per_target", 8))
    attempts = targets.join(F.broadcast(shapes.select("subtype", "ordinal")), "subtype")  # 15 rows
    attempts = attempts.select("ordinal", F.explode(F.sequence(F.lit(0), (F.col("target_count") * tries - 1).cast("int"))).alias("attempt"))
    rows = generate.realize(attempts.withColumn("key", F.concat_ws("-", "ordinal", "attempt")), "key", str(config.get("experiment", {}).get("seed", 42)))
    rows = rows.where(generate.pair_is_valid("sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth"))
    rows = rows.withColumnsRenamed({"sentence_good": "grammatical", "sentence_bad": "ungrammatical"}).withColumn("pair_id", F.col("key"))
    near = float(g.get("near_failure_margin", scoring.NEAR_FAILURE_MARGIN))
    name, scorer = next(iter(scorers({"models": [config["scorer"]]} if "scorer" in config else {}).items()))
    LOG.info("candidates scored by %s", name)
    scored = scoring.add_scores(rows, scorer, near)
    w = config.get("scoring", {})
    hard = quotas.candidate_hardness(scored, targets, ["attempt"], near, w.get("model_failure_weight", 1.0), w.get("boundary_weight", 0.5), w.get("margin_weight", 0.1), w.get("underrepresented_subtype_bonus", 0.25), w.get("overrepresented_subtype_penalty", 0.5))
    chosen = materialize(quotas.select_candidates(hard, targets))
    # uid numbers run over all chosen pairs: a subtype's rank and the chosen of the subtypes before it (a row a subtype)
    sizes = chosen.groupBy("subtype").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("subtype").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.join(F.broadcast(sizes.select("subtype", before.alias("_before"))), "subtype")
    number = (F.col("_before") + F.col("rank")).cast("string")
    chosen = chosen.withColumn("uid", F.concat(F.lit("rl_dist_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))).withColumnsRenamed({"grammatical": "sentence_good", "ungrammatical": "sentence_bad"})
    achieved = chosen.groupBy("subtype").agg(F.count(F.lit(1)).alias("achieved_count"))
    extra = ["grammatical_score", "ungrammatical_score", "preference_margin", "model_failed", "boundary_score", "diversity_bonus", "over_quota_penalty", "hardness_score"]
    paths = {
        "pairs": sinks.write_rows(chosen.select(*generate.PAIR_FIELDS), out / "pairs.jsonl", "json"), "scores": sinks.write_rows(chosen, out / "candidate_scores.csv", columns=[*generate.PAIR_FIELDS, *extra]),
        "comparison": sinks.write_csv(quotas.compare_distribution(targets, achieved), out / "distribution_comparison.csv"),
        "target_distribution": sinks.write_csv(summaries.weighted_counts(targets, shapes, ["subtype", "template_type", "clause_depth"]), out / "target_distribution.csv"),
    }
    return {k: str(v) for k, v in paths.items()}


def invalid_records(spark: SparkSession, path: str) -> DataFrame:
    """``uid, errors`` of the invalid records of generated JSONL files; bad JSON and non-objects are records with the uid
    ``<unknown>``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    text = [f"{c} string" for c in generate.PAIR_FIELDS]
    parsed = F.from_json("value", ", ".join(text))
    bad = ~F.ltrim("value").startswith("{") | F.try_parse_json("value").isNull()
    broken = lines.where(bad).select(F.lit("<unknown>").alias("uid"), F.lit("Line is not a JSON object.").alias("errors"))
    checked = diagnostics.validate(lines.where(~bad).select(parsed.alias("r")).select("r.*")).where("not valid").select("uid", "errors")
    return broken.unionByName(checked)


def run_validation(spark: SparkSession, path: str) -> list[dict]:
    """The invalid records of one file, on the driver; see ``invalid_records`` for more than fit there."""
    return [r.asDict() for r in invalid_records(spark, path).toLocalIterator()]


def run_baseline(spark: SparkSession, config: str | Config) -> Paths:
    """Accuracy and mean margin overall and by phenomenon and subtype under one scorer."""
    config = configuration(config)
    d = config.get("data", {})
    pairs = load(spark, {"path": records.data_path(d.get("path"), d.get("raw_dir", "data/raw"), d.get("subset", "agreement")), "phenomenon": d.get("phenomenon", "agreement")}, "baseline")
    fields = config.get("evaluation", {}).get("group_by", ["phenomenon", "subtype"])
    if unknown := set(fields) - {"phenomenon", "subtype"}:
        raise ValueError(f"cannot group by {sorted(unknown)}")
    results, _ = score(pairs, config)
    out = Path(config["outputs"]["dir"])
    grouped = summaries.summarize_fields(results, fields, nulls="skip", rates=False)
    paths = {
        "results": sinks.write_rows(results, out / "baseline_results.csv", columns=["pair_id", "phenomenon", "subtype", "grammatical", "ungrammatical", "grammatical_score", "ungrammatical_score", "preference_margin", "correct"]),
        "grouped": sinks.write_csv(grouped.orderBy("group_by", "group_name"), out / "baseline_grouped.csv", ["group_by", "group_name", "total", "correct", "accuracy", "mean_preference_margin"]),
        "summary": sinks.write_json(sinks.rows_of(summaries.summarize(results, rates=False))[0], out / "baseline_summary.json"),
    }
    return {k: str(v) for k, v in paths.items()}


def run_training(spark: SparkSession, config: str | Config) -> Paths:
    """Trains, evaluates the learned and a random policy, and writes values, logs, trajectories and summaries."""
    config = configuration(config)
    t, seed, out = config.get("training", {}), int(config.get("experiment", {}).get("seed", 42)), Path(config["outputs"]["dir"])
    steps = int(config.get("environment", {}).get("max_steps", 8))
    weights = RewardWeights(**config.get("reward", {}))
    q, log = search.train(int(t.get("episodes", 100)), seed, t.get("learning_rate", 0.2), t.get("discount", 0.9), (t.get("epsilon_start", 0.4), t.get("epsilon_end", 0.05)), steps, weights)
    paths: dict[str, Any] = {"q_values": sinks.write_json(q, out / "q_values.json"), "log": sinks.write_csv(spark.createDataFrame([{k: v for k, v in r.items() if k != "sentence_bad"} for r in log]), out / "training_log.csv")}
    return {**{k: str(v) for k, v in paths.items()}, **compare_policies(spark, q, out, int(t.get("eval_episodes", 25)), seed, steps, (10_000, 20_000))}


def compare_policies(spark: SparkSession, q: dict, out: Path, episodes: int, seed: int, steps: int = 8, offsets: tuple[int, int] = (30_000, 40_000), threshold: float = 0.8) -> Paths:
    runs = search.rollouts(spark, "trained", episodes, seed + offsets[0], steps, q).unionByName(search.rollouts(spark, "random", episodes, seed + offsets[1], steps))
    runs = materialize(runs)
    pairs = runs.where("sentence_good is not null").select("policy", F.concat_ws("-", "policy", "episode").alias("pair_id"), F.lit("agreement").alias("phenomenon"), "subtype", "template_type", F.col("sentence_good").alias("grammatical"), F.col("sentence_bad").alias("ungrammatical"))
    filled = runs.fillna("missing", ["template_type", "subtype"])
    collapse = [r | {"field": f} for f in ("template_type", "subtype") for r in sinks.rows_of(summaries.dominance(filled, ["policy"], f, "episode", threshold).withColumnRenamed("dominant", "value"))]
    paths = {
        "trajectories": sinks.write_rows(runs, out / "trajectories.jsonl", "json"), "pairs": sinks.write_rows(pairs, out / "final_pairs.jsonl", "json"), "summary": sinks.write_csv(summaries.trajectory_summary(runs), out / "policy_summary.csv"),
        "histograms": sinks.write_json(sinks.rows_of(summaries.trajectory_histograms(runs)), out / "policy_histograms.json"),
        "distribution": sinks.write_csv(summaries.count_fields(filled, ["template_type", "subtype"], ["policy"]), out / "policy_distribution.csv"), "collapse": sinks.write_json(collapse, out / "policy_collapse.json"),
        "q_top": sinks.write_csv(search.q_summary(search.q_rows(spark, q)), out / "q_top.csv") if q else None, "q_report": sinks.write_json(sinks.rows_of(search.q_report(search.q_rows(spark, q)))[0], out / "q_summary.json") if q else None,
    }
    return {k: str(v) for k, v in paths.items() if v}


def run_rollouts(spark: SparkSession, config: str | Config) -> Paths:
    config = configuration(config)
    r, out = config.get("rollout", {}), Path(config["outputs"]["dir"])
    runs = materialize(search.rollouts(spark, "random", int(r.get("episodes", 10)), int(config.get("experiment", {}).get("seed", 42)), int(r.get("max_steps", 8)), go_on=0.75))
    return {"trajectories": str(sinks.write_rows(runs, out / "rollouts.jsonl", "json")), "summary": str(sinks.write_csv(summaries.trajectory_summary(runs), out / "rollout_summary.csv"))}


def run_reevaluation(spark: SparkSession, config: str | Config) -> Paths:
    """Final pairs of both policies under all enabled models: per policy, per policy and field, per model and policy."""
    config = configuration(config)
    out, parts = Path(config["outputs"]["dir"]), []
    for policy, path in config["inputs"].items():
        rows = records.to_pairs(records.read_plain_jsonl(spark, path))
        parts.append(rows.withColumn("policy", F.lit(policy)).withColumn("dataset", F.lit(policy)))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    results, errors = score(pairs, config)
    policies = list(config["inputs"])
    tables = {
        "policy_summary": summaries.policy_summary(results, policies), "policy_grouped": summaries.summarize_fields(results, ["phenomenon", "subtype", "template_type"], ["policy"], nulls="skip", rates=False),
        "model_policy_comparison": summaries.summarize(results, ["model_id", "policy"]),
    }
    paths = {k: str(sinks.write_csv(df, out / f"reevaluation_{k}.csv")) for k, df in tables.items()}
    return {**paths, "results": str(sinks.write_rows(results, out / "reevaluation_results.csv")), "errors": str(sinks.write_json(errors, out / "reevaluation_errors.json"))}


def run_report(spark: SparkSession, config: str | Config) -> Paths:
    """A training run's files read again: values, trajectories, collapse, baseline."""
    config = configuration(config)
    out, i = Path(config["outputs"]["dir"]), config["inputs"]
    q = records.read_q_table(spark, i["q_values"])
    runs = spark.read.schema(search.EPISODE_SCHEMA).json(i["trajectories"])
    base = records.optional_document(i.get("baseline"))
    examples = sinks.rows_of(runs.where("sentence_good is not null").orderBy("policy", "episode").limit(int(config.get("examples", 5))))
    report = {
        "policies": sinks.rows_of(summaries.trajectory_summary(runs)), "histograms": sinks.rows_of(summaries.trajectory_histograms(runs)), "q_values": sinks.rows_of(search.q_report(q))[0],
        "states": q.select("state_key").distinct().count(), "q_entries": q.count(), "episodes": runs.count(), "baseline": base, "examples": examples,
    }
    lines = ["# Training report", "", *sinks.markdown_table(report["policies"], ["policy", "episodes", "average_reward", "average_trajectory_length", "failure_rate", "near_failure_rate"], 6), "", f"States: {report['states']}"]
    return {"json": str(sinks.write_json(report, out / "report.json")), "report": str(sinks.write_text(lines, out / "report.md"))}


def download(url: str, destination: str) -> Paths:
    """Fetches an archive and keeps its JSONL files, flat; resource forks are dropped. Needs a network."""
    import io
    import urllib.request
    import zipfile

    with urllib.request.urlopen(url) as r:  # noqa: S310
        archive = zipfile.ZipFile(io.BytesIO(r.read()))
    out = Path(destination)
    out.mkdir(parents=True, exist_ok=True)
    kept = [n for n in archive.namelist() if n.endswith(".jsonl") and not Path(n).name.startswith("._")]
    for n in kept:
        (out / Path(n).name).write_bytes(archive.read(n))
    return {Path(n).name: str(out / Path(n).name) for n in kept}


RUNS: dict[str, Callable[[SparkSession, str], Any]] = {
    "baseline": run_baseline, "generate": run_generation, "validate": run_validation, "rollout": run_rollouts, "train": run_training, "generate-quota": run_quota_generation, "analyze": run_report,
    "reevaluate": run_reevaluation, "final-eval": run_reevaluation, "subtype-analysis": run_subtype_analysis, "compare": run_comparison, "sanity-check": run_sanity_check,
}
