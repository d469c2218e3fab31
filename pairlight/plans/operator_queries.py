"""Queries that run the sources, sinks and smaller operators over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions import rewards
from pairlight.functions.text import distance_bucket_strict, log_prob_score, next_value, parse_bool, parse_judgement
from pairlight.operators import compare, generate, quotas, scoring, search, summaries
from pairlight.plans.derived import BUCKET, GEN_PAIRS, MODELS, MODEL_SCORES, as_pairs, gen_pairs, model_scores
from pairlight.plans.pipelines import with_columns
from pairlight.plans.reference_queries import _PLAN, BY_MODEL, GROUPED, SHARED, _by_model, _grouped, _plan_rows
from pairlight.session import table
from pairlight.sources import records, sinks
from pairlight.storage import ensure_checkpoint_dir, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _renamed(spark: SparkSession, folder: str, ending: str, new: str) -> str:
    """The folder, with its files of one ending under another: the loader goes by endings."""
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    listed, paths = fs.listFiles(Path(folder), True), []
    while listed.hasNext():
        paths.append(listed.next().getPath())
    for p in paths:
        if p.getName().endswith(ending):
            fs.rename(p, Path(p.getParent(), p.getName().removesuffix(ending) + new))
    return folder


# --- sources and sinks: the pairs are written as files and read again --------------------------------------------------

_SENTENCES = "sentence_good AS grammatical, sentence_bad AS ungrammatical, dependency_distance, attractor_count, clause_depth"


@query(f"WITH {GEN_PAIRS} SELECT uid AS pair_id, phenomenon, subtype AS raw_subtype, subtype, template_type, {_SENTENCES} FROM gen_pairs")
def loaded_csv(spark, d):
    """Pairs out of a folder of CSV files, with their metadata as typed columns."""
    path = sinks.write_parts(gen_pairs(spark, d).drop("key", "dataset"), _folder(spark), "csv")
    return with_columns(records.load_pairs(spark, path))


@query(f"WITH {GEN_PAIRS} SELECT 'u' || key || '-' || dataset AS pair_id, 'subject_' || phenomenon AS phenomenon, 'subject_' || phenomenon AS subtype, 'syntax' AS field, template_type, sentence_good AS grammatical, sentence_bad AS ungrammatical, 'kept' AS dataset FROM gen_pairs")
def loaded_jsonl(spark, d):
    """Pairs out of JSON lines under other field names: the id in two parts, the subtype from its alias."""
    g = gen_pairs(spark, d)
    rows = g.select(F.concat(F.lit("u"), "key").alias("UID"), F.col("dataset").alias("pairID"), F.concat(F.lit("subject_"), "phenomenon").alias("linguistics_term"), F.lit("syntax").alias("field"), "template_type", "sentence_good", "sentence_bad")
    path = _renamed(spark, sinks.write_parts(rows, _folder(spark), "json"), ".json", ".jsonl")
    got = records.load_pairs(spark, path, "Agreement", dataset="kept")
    return got.select("pair_id", "phenomenon", "subtype", F.col("metadata")["field"].alias("field"), F.col("metadata")["template_type"].alias("template_type"), "grammatical", "ungrammatical", "dataset")


@query(f"WITH {GEN_PAIRS} SELECT key::VARCHAR AS pair_id, phenomenon, subtype, sentence_good AS grammatical, sentence_bad AS ungrammatical FROM gen_pairs")
def loaded_json(spark, d):
    """Pairs out of JSON documents, a few thousand pairs each: arrays, and objects with ``pairs``."""
    g = gen_pairs(spark, d)
    rows = g.select(F.struct(F.col("key").cast("string").alias("pair_id"), "phenomenon", "subtype", "sentence_good", "sentence_bad").alias("r"), F.floor(F.col("key") / 5000).alias("part"))
    docs = rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))
    shown = docs.select("part", F.when(F.col("part") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"pairs": '), "value", F.lit("}"))).alias("value"))
    folder = _folder(spark)
    # one document a file; the ending tells the reader
    shown.repartition("part").write.partitionBy("part").text(folder, lineSep="\n")
    return records.load_pairs(spark, _renamed(spark, folder, ".txt", ".json")).select("pair_id", "phenomenon", "subtype", "grammatical", "ungrammatical")


@query("SELECT event_id::VARCHAR AS event_id, event_type, nullif(props, '') AS props FROM events")
def plain_csv(spark, d):
    """A table written as CSV parts and read as text."""
    return records.read_csv(spark, sinks.write_parts(table(spark, d, "events").select("event_id", "event_type", "props"), _folder(spark), "csv"))


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents")
def plain_jsonl(spark, d):
    """Whole texts written as JSON lines and read without checks."""
    path = sinks.write_parts(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), _folder(spark), "json")
    return records.read_plain_jsonl(spark, path).select("doc_id", "lang", "source", F.length("text").alias("n"))


@query("SELECT coalesce(uid, '') AS pair_id, 'agreement' AS phenomenon, subtype, template_type, sentence_good AS grammatical, sentence_bad AS ungrammatical, error_count FROM sanity_check_pair_validation WHERE sentence_good IS NOT NULL AND uid IS NOT NULL")
def records_as_pairs(spark, d):
    """Records to pairs, and the count joined back from the records made of those pairs."""
    rows = table(spark, d, "sanity_check_pair_validation").where("sentence_good is not null and uid is not null")
    pairs = records.to_pairs(rows.withColumn("uid", F.concat_ws("\u0001", "uid", F.col("error_count").cast("string"))))
    back = records.to_records(pairs)
    return back.select(F.substring_index("uid", "\u0001", 1).alias("pair_id"), "phenomenon", "subtype", "template_type", F.col("sentence_good").alias("grammatical"), F.col("sentence_bad").alias("ungrammatical"), F.substring_index("uid", "\u0001", -1).try_cast("int").alias("error_count"))


@query("SELECT record_id, coalesce(lower(val_text) = 'true', false) AS flag FROM accuracy_facts")
def boolean_flags(spark, d):
    return table(spark, d, "accuracy_facts").select("record_id", parse_bool("val_text").alias("flag"))


# --- projections and scores ---------------------------------------------------------------------------------------------


@query(f"WITH {GEN_PAIRS} SELECT uid, {BUCKET} AS bucket FROM gen_pairs")
def strict_buckets(spark, d):
    return gen_pairs(spark, d).select("uid", distance_bucket_strict("dependency_distance").alias("bucket"))


@query(f"WITH {GEN_PAIRS} SELECT subtype, count(*) AS n FROM gen_pairs WHERE template_type IN ('simple_agreement', 'relative_clause') AND dependency_distance <= 5 AND attractor_count <= 0 AND clause_depth <= 1 AND subtype IN ('simple_plural', 'object_relative_clause_that', 'object_relative_clause_plural_embedded_that', 'pp_plural_attractor_near') GROUP BY 1")
def template_selection(spark, d):
    """Pairs of the templates that pass the filters by type, subtype and bounds."""
    shapes = generate.templates(spark, ["simple_agreement", "relative_clause"], ["simple_plural", "object_relative_clause_that", "object_relative_clause_plural_embedded_that", "pp_plural_attractor_near"], 5, 0, 1)
    return gen_pairs(spark, d).join(F.broadcast(shapes.select("subtype")), "subtype").groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GEN_PAIRS} SELECT key, CASE WHEN template_type = 'pp_attractor' THEN uid ELSE (row_number() OVER (ORDER BY key) - 1)::VARCHAR END AS pair_id FROM gen_pairs")
def pair_index(spark, d):
    """Empty and null ids become the row's index over all rows."""
    kind = F.col("template_type")
    rows = gen_pairs(spark, d).withColumn("pair_id", F.when(kind == "pp_attractor", F.col("uid")).when(kind == "relative_clause", ""))
    return scoring.with_pair_ids(rows, ["key"]).select("key", "pair_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN (-o_totalprice / 100) / (o_orderkey % 5) ELSE 0.0::DOUBLE END AS mean_score, CASE WHEN o_orderkey % 5 > 0 THEN -o_totalprice / 100 ELSE 0.0::DOUBLE END AS sum_score FROM orders")
def log_prob_scores(spark, d):
    total, tokens = -F.col("o_totalprice") / 100, F.col("o_orderkey") % 5
    return table(spark, d, "orders").select("o_orderkey", log_prob_score(total, tokens).alias("mean_score"), log_prob_score(total, tokens, False).alias("sum_score"))


_NUMBER = "(event_id % 1500) // 1000 || '.' || lpad((event_id % 1000)::VARCHAR, 3, '0')"
_ANSWER = f"CASE event_id % 4 WHEN 0 THEN '{{\"score\": ' || {_NUMBER} || ', \"why\": 3}}' WHEN 1 THEN 'I give it ' || {_NUMBER} || ' of 1' WHEN 2 THEN 'score: -0.5 or 2' ELSE 'no idea' END"


@query(f"WITH a AS (SELECT event_id, {_ANSWER} AS answer FROM events), v AS (SELECT event_id, coalesce(CASE WHEN json_valid(answer) THEN try_cast(json_extract_string(answer, '$.score') AS DOUBLE) END, try_cast(nullif(regexp_extract(answer, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE)) AS x FROM a) SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, x)) AS score FROM v WHERE x IS NOT NULL UNION ALL SELECT event_id, NULL FROM v WHERE x IS NULL")
def judge_scores(spark, d):
    """Scores out of a judge's answers: JSON, running text, out of range, none."""
    e = F.col("event_id")
    k, number = e % 4, F.concat(F.floor(e % 1500 / 1000).cast("string"), F.lit("."), F.lpad((e % 1000).cast("string"), 3, "0"))
    answer = F.when(k == 0, F.concat(F.lit('{"score": '), number, F.lit(', "why": 3}'))).when(k == 1, F.concat(F.lit("I give it "), number, F.lit(" of 1"))).when(k == 2, "score: -0.5 or 2").otherwise("no idea")
    return table(spark, d, "events").select("event_id", parse_judgement(answer).alias("score"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'FURNITURE' ELSE 'BUILDING' END AS following FROM customer")
def next_values(spark, d):
    return table(spark, d, "customer").select("c_custkey", next_value(["BUILDING", "MACHINERY", "FURNITURE"], "c_mktsegment").alias("following"))


@query(f"""WITH {MODEL_SCORES}, m AS (SELECT pair_id, model_id, model_failed, CASE WHEN template_type = 'simple_agreement' THEN 0.0::DOUBLE ELSE preference_margin / 12.5::DOUBLE END AS m, CASE WHEN template_type = 'simple_agreement' THEN 0 ELSE 1 END AS k, dependency_distance AS dd, attractor_count AS ac, clause_depth AS cd FROM model_scores),
p AS (SELECT *, CASE WHEN model_failed THEN 1.0::DOUBLE ELSE 0 END AS f, CASE WHEN abs(m) < 0.2 THEN 0.6::DOUBLE * (1.0 - abs(m) / 0.2::DOUBLE) * CASE WHEN m >= 0 THEN 1.0 ELSE 0.5 END ELSE 0 END AS low, CASE WHEN model_failed OR abs(m) < 0.2 THEN 0.02::DOUBLE * (0.5 * dd * k + ac * k + cd * k) ELSE 0 END AS load FROM m)
SELECT pair_id, model_id, round(CASE WHEN k = 0 OR (m = 0 AND dd * k + ac * k + cd * k + 6 * k = 0) THEN f - 0.25::DOUBLE ELSE f + low + load - 0.002::DOUBLE * 6 - 0.25::DOUBLE END, 12) AS reward FROM p""")
def scalar_rewards(spark, d):
    """The reward alone: simple pairs give nothing but the failure, so they take the older form."""
    rows = model_scores(spark, d)
    simple = F.col("template_type") == "simple_agreement"
    only = lambda c: F.when(simple, 0).otherwise(c)
    margin = F.when(simple, 0.0).otherwise(F.col("preference_margin") / 12.5)
    reward = rewards.scalar_reward(margin, F.col("model_failed"), only(F.lit(6)), only(F.col("dependency_distance")), only(F.col("attractor_count")), only(F.col("clause_depth")), penalty=0.25)
    return rows.select("pair_id", "model_id", F.round(reward, 12).alias("reward"))


# --- comparisons and summaries ------------------------------------------------------------------------------------------


@query(f"WITH {MODEL_SCORES}, {GROUPED}, {SHARED}, m AS (SELECT subtype, round(avg(accuracy_delta), 12) AS a, round(avg(failure_rate_delta), 12) AS f FROM shared GROUP BY 1) SELECT 'accuracy' AS metric, subtype, round(a, 9) + 0.0::DOUBLE AS mean_delta, row_number() OVER (ORDER BY a, subtype) AS position FROM m UNION ALL SELECT 'failure_rate', subtype, round(f, 9) + 0.0::DOUBLE, row_number() OVER (ORDER BY f DESC, subtype DESC) FROM m")
def mean_delta_order(spark, d):
    """Shared subtypes in the order of the models' mean delta."""
    shared = materialize(compare.shared_subtypes(_grouped(spark, d)))
    parts = [compare.ordered_by_mean_delta(shared, m).select(F.lit(m).alias("metric"), "subtype", F.round("mean_delta", 9).alias("mean_delta"), "position") for m in ("accuracy", "failure_rate")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {MODEL_SCORES}, {BY_MODEL}, w AS (SELECT group_name AS subtype, max(accuracy) - min(accuracy) AS r FROM by_model WHERE group_by = 'subtype' GROUP BY 1 HAVING count(*) >= 2) SELECT group_name AS subtype, model_id, accuracy, failure_rate, mean_preference_margin FROM by_model JOIN w ON subtype = group_name WHERE group_by = 'subtype' AND r >= 0.005")
def difficulty_by_model(spark, d):
    """The models' own metrics of the subtypes whose accuracy differs between models."""
    rows = compare.difficulty_change(_by_model(spark, d), 0.005)
    return rows.select("subtype", F.explode("by_model").alias("model_id", "m")).select("subtype", "model_id", "m.*")


@query(f"WITH {MODEL_SCORES}, {BY_MODEL}, m AS (SELECT * FROM by_model WHERE group_by = 'subtype' AND NOT (model_id = 'hf_gpt2' AND accuracy < 0.5)) SELECT group_name, " + ", ".join(f"coalesce(max(accuracy) FILTER (model_id = '{m}'), 0) AS {m}" for m in MODELS) + " FROM m GROUP BY 1")
def dense_metric_by_subtype(spark, d):
    """A wide table as figures draw it: 0.0 where a model has no value."""
    rows = _by_model(spark, d).where("not (model_id = 'hf_gpt2' and accuracy < 0.5)")
    return compare.dense_metric(compare.wide_metric(rows, "subtype", "accuracy", MODELS), "group_name", MODELS)


_LIST = "coalesce(string_agg({e}, ',' ORDER BY group_name) FILTER ({c}), '')"


@query(f"""WITH {GEN_PAIRS}, {_PLAN} SELECT sum(sampled)::BIGINT AS benchmark_total, sum(sampled)::BIGINT AS rl_total, bool_and(sampled <= benchmark_available AND sampled <= rl_available) AS distribution_matched, count(*) FILTER (sampled > 0) AS matched_group_count, {_LIST.format(e="group_name || ':' || sampled", c="sampled > 0")} AS per_group,
{_LIST.format(e="group_name", c="status = 'insufficient_examples'")} AS insufficient, {_LIST.format(e="group_name", c="status = 'dropped_by_total_cap'")} AS dropped, {_LIST.format(e="group_name || ':' || sampled || '/20'", c="sampled > 0 AND sampled < 20")} AS below, 'subtype' AS field FROM plan""")
def matched_groups(spark, d):
    """The summary of the matched plan by group, with the field that was matched by."""
    plan, field = quotas.matched_plan_or_fallback(_plan_rows(spark, d), 20, 250)
    one = quotas.matched_groups(plan, 20)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return one.select(
        "benchmark_total", "rl_total", "distribution_matched", "matched_group_count", text(F.map_entries("examples_per_matched_group"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))).alias("per_group"),
        F.array_join("dropped_groups_due_to_insufficient_examples", ",").alias("insufficient"), F.array_join("dropped_groups_due_to_total_cap", ",").alias("dropped"),
        text("limited_groups_below_requested_count", lambda e: F.concat(e["group"], F.lit(":"), e["sampled_per_dataset"].cast("string"), F.lit("/"), e["requested_per_group"].cast("string"))).alias("below"), F.lit(field).alias("field"),
    )


# --- search -------------------------------------------------------------------------------------------------------------

_RUNS_SQL = "runs AS (SELECT event_type AS policy, value AS total_reward, (user_id % 7)::INT AS steps, CASE WHEN event_id % 5 > 0 THEN 'kind_' || event_id % 3 END AS template_type, CASE WHEN event_id % 5 > 0 THEN 'sub_' || user_id % 4 END AS subtype, CASE WHEN event_id % 5 > 0 THEN (event_id % 1001 - 500) / 1024.0::DOUBLE END AS margin, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS model_failed FROM events)"


def _runs(spark, d):
    """Events as trajectories: their type is the policy, one in five ends without a pair."""
    e, u = F.col("event_id"), F.col("user_id")
    whole = lambda c: F.when(e % 5 > 0, c)
    return table(spark, d, "events").select(
        F.col("event_type").alias("policy"), F.col("value").alias("total_reward"), (u % 7).cast("int").alias("steps"), whole(F.concat(F.lit("kind_"), (e % 3).cast("string"))).alias("template_type"), whole(F.concat(F.lit("sub_"), (u % 4).cast("string"))).alias("subtype"),
        whole((e % 1001 - 500) / F.lit(1024.0)).alias("margin"), whole(e % 2 == 0).alias("model_failed"),
    )


@query(f"WITH {_RUNS_SQL} SELECT policy, count(*) AS episodes, round(avg(total_reward), 6) AS average_reward, avg(steps) AS average_trajectory_length, avg(coalesce(margin, 0)) AS average_preference_margin, count(*) FILTER (model_failed) / count(*) AS failure_rate, count(*) FILTER (abs(coalesce(margin, 0)) <= 0.2) / count(*) AS near_failure_rate FROM runs GROUP BY 1")
def event_trajectories(spark, d):
    return summaries.trajectory_summary(_runs(spark, d)).withColumn("average_reward", F.round("average_reward", 6))


def _histogram_sql(c: str) -> str:
    return f"(SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT coalesce({c}, 'missing') AS v, count(*) AS n FROM runs r WHERE r.policy = p.policy GROUP BY 1)) AS {c}s"


@query(f"WITH {_RUNS_SQL} SELECT policy, {_histogram_sql('template_type')}, {_histogram_sql('subtype')} FROM (SELECT DISTINCT policy FROM runs) p")
def trajectory_histograms(spark, d):
    text = lambda c, name: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(name)
    return summaries.trajectory_histograms(_runs(spark, d)).select("policy", text("template_type_distribution", "template_types"), text("subtype_distribution", "subtypes"))


@query(f"WITH {_RUNS_SQL}, c AS (SELECT policy, 'template_type' AS group_by, coalesce(template_type, 'None') AS group_name FROM runs UNION ALL SELECT policy, 'subtype', coalesce(subtype, 'None') FROM runs) SELECT policy, group_by, group_name, count(*) AS n FROM c GROUP BY ALL")
def event_distribution(spark, d):
    return summaries.count_fields(_runs(spark, d), ["template_type", "subtype"], ["policy"])


_STATES = [search.INITIAL_STATE, search.RELATIVE_STATE, "pp_attractor|4|1|0|0|0|0", "simple_agreement|1|0|0|0|0|0"]
_Q_SQL = f"""q AS (SELECT [{', '.join(repr(s) for s in _STATES)}][l_linenumber % 4 + 1] AS state_key, [{', '.join(repr(a) for a in search.ACTIONS)}][l_suppkey % 8 + 1] AS action, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL)"""


def _q_rows(spark, d):
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    rows = table(spark, d, "lineitem").select(pick(_STATES, F.col("l_linenumber") % 4).alias("state_key"), pick(search.ACTIONS, F.col("l_suppkey") % 8).alias("action"), "l_extendedprice")
    return rows.groupBy("state_key", "action").agg(F.max("l_extendedprice").alias("q"))


def _ranked_sql(state: str) -> str:
    return f"(SELECT string_agg(action, ',' ORDER BY q DESC, action) FROM q WHERE state_key = '{state}')"


@query(f"WITH {_Q_SQL} SELECT {_ranked_sql(search.INITIAL_STATE)} AS initial_actions, {_ranked_sql(search.RELATIVE_STATE)} AS relative_actions, starts_with({_ranked_sql(search.INITIAL_STATE)}, 'stop') AS favors_immediate_stop_initially, (SELECT count(DISTINCT state_key) FROM q) AS state_count, (SELECT string_agg(state_key || '>' || action, ',' ORDER BY q DESC, state_key, action) FROM (SELECT * FROM q ORDER BY q DESC, state_key, action LIMIT 10)) AS top_entries")
def q_table_report(spark, d):
    """The report on a Q-table of the prices by state and action."""
    one = search.q_report(materialize(_q_rows(spark, d)))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["action"]), ",")
    return one.select(names("initial_state_actions").alias("initial_actions"), names("relative_clause_actions").alias("relative_actions"), "favors_immediate_stop_initially", "state_count", F.array_join(F.transform("top_q_entries", lambda x: F.concat(x["state"], F.lit(">"), x["action"])), ",").alias("top_entries"))


@query(f"WITH {_Q_SQL} SELECT * FROM q ORDER BY q DESC, state_key, action LIMIT 10")
def q_table_top(spark, d):
    return search.q_summary(_q_rows(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount + 0.2 * (l_tax + 0.9 * l_quantity - l_discount), 9) AS updated, round(0.4 + (0.05 - 0.4) * least(1.0::DOUBLE, l_linenumber / 5.0::DOUBLE), 9) AS epsilon FROM lineitem")
def search_arithmetic(spark, d):
    """The value update and the decay of exploration as columns."""
    updated = rewards.q_step(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.2, 0.9)
    epsilon = rewards.linear_decay(0.4, 0.05, F.col("l_linenumber"), 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(updated, 9).alias("updated"), F.round(epsilon, 9).alias("epsilon"))


@query(f"WITH {GEN_PAIRS} SELECT uid, template_type || '|' || dependency_distance || '|' || attractor_count || '|' || clause_depth || '|' || (key % 2) || '|' || least(key % 3, 1) || '|' || least(key % 5, 1) AS state_key FROM gen_pairs")
def state_keys(spark, d):
    c, k = F.col, F.col("key")
    key = search.state_key(c("template_type"), c("dependency_distance"), c("attractor_count"), c("clause_depth"), k % 2 == 1, k % 3, k % 5)
    return gen_pairs(spark, d).select("uid", key.alias("state_key"))


@query("""WITH kinds(kind, part, choice) AS (VALUES ('unset', 'unset|0|0|0', 'unset'), ('simple', 'simple_agreement|1|0|0', 'simple_singular'), ('pp', 'pp_attractor|4|1|0', 'pp_plural_attractor_'), ('relative', 'relative_clause|5|0|1', 'object_relative_clause_')),
states AS (SELECT kind, p, r, part || '|0|' || p || '|' || r AS state_key, part, choice || CASE kind WHEN 'pp' THEN ['near', 'behind'][p + 1] WHEN 'relative' THEN ['that', 'who'][r + 1] ELSE '' END AS subtype
  FROM kinds, (VALUES (0), (1)) AS a(p), (VALUES (0), (1)) AS b(r) WHERE (kind IN ('pp', 'relative') OR p = 0) AND (kind = 'relative' OR r = 0)),
moves(kind, action, target) AS (VALUES ('unset', 'select_simple_template', 'simple'), ('unset', 'select_pp_template', 'pp'), ('unset', 'select_relative_clause_template', 'relative'), ('simple', 'add_plural_attractor', 'pp'), ('simple', 'increase_depth_if_valid', 'relative'), ('pp', 'increase_depth_if_valid', 'relative'))
SELECT s.state_key, s.subtype, action, t.state_key AS next_key, t.subtype AS next_subtype FROM states s JOIN moves USING (kind) JOIN states t ON t.kind = target AND t.p = s.p AND t.r = s.r
UNION ALL SELECT s.state_key, s.subtype, 'change_preposition', t.state_key, t.subtype FROM states s JOIN states t ON s.kind = 'pp' AND t.kind = 'pp' AND s.p = 0 AND t.p = 1
UNION ALL SELECT s.state_key, s.subtype, 'change_relative_pronoun', t.state_key, t.subtype FROM states s JOIN states t ON s.kind = 'relative' AND t.kind = 'relative' AND s.p = t.p AND s.r = 0 AND t.r = 1
UNION ALL SELECT state_key, subtype, 'stop', part || '|1|' || p || '|' || r, subtype FROM states WHERE kind <> 'unset'""")
def transition_table(spark, d):
    """All valid actions of the search in the states that can be reached (a fixed table; no driver table is read)."""
    return spark.createDataFrame(search.transitions(), "state_key string, subtype string, action string, next_key string, next_subtype string")


@query("WITH " + GEN_PAIRS.replace("SELECT o_orderkey AS key, CASE WHEN (o_orderkey // 15) % 2 = 0 THEN 'benchmark' ELSE 'rl' END AS dataset, t.*", "SELECT i AS key, '' AS dataset, t.*").replace("FROM orders JOIN", "FROM range((SELECT count(*) FROM orders)) n(i) JOIN").replace("ON o_orderkey % 15 = ordinal", "ON i % 15 = ordinal") + " SELECT template_type || '-' || lpad((key + 1)::VARCHAR, greatest(4, length((key + 1)::VARCHAR))::INT, '0') AS uid, phenomenon, sentence_good, sentence_bad, dependency_distance, attractor_count, clause_depth, template_type, subtype FROM gen_pairs")
def generated_pairs(spark, d):
    """As many generated pairs as there are orders."""
    return generate.generate_pairs(spark, table(spark, d, "orders").count())


@query(f"WITH {GEN_PAIRS} SELECT dataset, subtype, count(*) AS total, count(*) FILTER (length(sentence_good) > length(sentence_bad)) AS longer FROM gen_pairs GROUP BY ALL")
def pair_lengths(spark, d):
    """Pairs under the names of the scorers, by side lengths."""
    rows = as_pairs(gen_pairs(spark, d))
    return rows.groupBy("dataset", "subtype").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length("grammatical") > F.length("ungrammatical")).alias("longer"))
