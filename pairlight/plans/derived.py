"""Inputs that the reference queries run on, made the same way in Spark and in SQL from the driver's tables.

``gen_pairs``: one minimal pair per order: the template is the order key modulo 15, words are picked by MD5, datasets
alternate. ``model_scores``: the pairs under three test scorers whose scores are multiples of 1/1024, so that sums and
means are exact in any order. ``doc_results``: documents as result rows, for real text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.lexicon import SLOTS, TEMPLATES, VERBS_PLURAL, VERBS_SINGULAR
from pairlight.functions.text import distance_bucket, length_score, md5_number
from pairlight.operators.generate import realize
from pairlight.operators.scoring import hash_scorer, score_pairs
from pairlight.session import table
from pairlight.storage import spread

MODELS = ("hf_distilgpt2", "hf_gpt2", "hf_tiny_gpt2")
NEAR = 0.5


def gen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("key"), (k % 15).cast("int").alias("ordinal"), F.when(F.floor(k / 15) % 2 == 0, "benchmark").otherwise("rl").alias("dataset"))
    rows = realize(spread(orders), "key")
    uid = F.concat("template_type", F.lit("-"), F.lpad(F.col("key").cast("string"), 8, "0"))
    return rows.select("key", uid.alias("uid"), "dataset", "phenomenon", "sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth", "template_type", "subtype")


def as_pairs(records: DataFrame) -> DataFrame:
    return records.withColumnsRenamed({"uid": "pair_id", "sentence_good": "grammatical", "sentence_bad": "ungrammatical"})


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_pairs(as_pairs(gen_pairs(spark, sf_dir)), {m: hash_scorer(m) for m in MODELS}, NEAR)


def doc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    margin = (md5_number(F.lit("doc"), "doc_id") % 2001 - 1000) / F.lit(1024.0)
    rows = d.select("doc_id", "lang", "source", distance_bucket((F.col("n_chars") / 400).cast("int")).alias("bucket"), length_score("text").alias("score"), margin.alias("preference_margin"))
    return rows.withColumn("correct", F.col("preference_margin") > 0).withColumn("failure", ~F.col("correct")).withColumn("near_failure", F.abs("preference_margin") <= 0.1)


# --- the same in SQL -------------------------------------------------------------------------------------------------


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_md5(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


def _templates_sql() -> str:
    rows = ", ".join(f"({i}, '{t[0]}', '{t[1]}', '{t[2]}', {str(t[3] == 'plural').lower()}, {t[4]}, {t[5]}, {t[6]})" for i, t in enumerate(TEMPLATES))
    return f"(VALUES {rows}) AS t(ordinal, template_type, subtype, shape, plural, dependency_distance, attractor_count, clause_depth)"


def _stem_sql() -> str:
    out = "shape"
    for slot, words in SLOTS.items():
        stem = slot.removesuffix("_singular").removesuffix("_plural")
        number = sql_md5("'42'", "key::VARCHAR", f"'{stem}'")
        out = f"replace({out}, '{{{slot}}}', {sql_list(words)}[{number} % {len(words)} + 1])"
    return out


_VERB = sql_md5("'42'", "key::VARCHAR", "'verb'") + f" % {len(VERBS_SINGULAR)} + 1"
GEN_PAIRS = f"""words AS (
  SELECT o_orderkey AS key, CASE WHEN (o_orderkey // 15) % 2 = 0 THEN 'benchmark' ELSE 'rl' END AS dataset, t.*
  FROM orders JOIN {_templates_sql()} ON o_orderkey % 15 = ordinal
), stems AS (
  SELECT *, {_stem_sql()} AS stem, {sql_list(VERBS_SINGULAR)}[{_VERB}] AS one, {sql_list(VERBS_PLURAL)}[{_VERB}] AS many FROM words
), gen_pairs AS (
  SELECT key, template_type || '-' || lpad(key::VARCHAR, 8, '0') AS uid, dataset, 'agreement' AS phenomenon,
    stem || ' ' || CASE WHEN plural THEN many ELSE one END || '.' AS sentence_good, stem || ' ' || CASE WHEN plural THEN one ELSE many END || '.' AS sentence_bad,
    dependency_distance, attractor_count, clause_depth, template_type, subtype
  FROM stems
)"""
BUCKET = "CASE WHEN dependency_distance <= 1 THEN 'short_1' WHEN dependency_distance <= 4 THEN 'medium_2_4' ELSE 'long_5_plus' END"
MODEL_SCORES = f"""{GEN_PAIRS}, scored AS (
  SELECT dataset, model_id, uid AS pair_id, phenomenon, subtype, template_type, dependency_distance, {BUCKET} AS dependency_distance_bucket, attractor_count, clause_depth, sentence_good AS grammatical, sentence_bad AS ungrammatical,
    ({sql_md5("model_id", "sentence_good")} % 20001 - 10000) / 1024.0::DOUBLE AS grammatical_score, ({sql_md5("model_id", "sentence_bad")} % 20001 - 10000) / 1024.0::DOUBLE AS ungrammatical_score
  FROM gen_pairs, (SELECT unnest({sql_list(list(MODELS))}) AS model_id)
), model_scores AS (
  SELECT *, grammatical_score - ungrammatical_score AS preference_margin, grammatical_score > ungrammatical_score AS correct, NOT (grammatical_score > ungrammatical_score) AS failure,
    abs(grammatical_score - ungrammatical_score) <= {NEAR} AS near_failure, ungrammatical_score > grammatical_score AS model_failed
  FROM scored
)"""
DOC_RESULTS = f"""docs AS (
  SELECT doc_id, lang, source, CASE WHEN n_chars // 400 <= 1 THEN 'short_1' WHEN n_chars // 400 <= 4 THEN 'medium_2_4' WHEN n_chars IS NOT NULL THEN 'long_5_plus' END AS bucket,
    ({sql_md5("'doc'", "doc_id::VARCHAR")} % 2001 - 1000) / 1024.0::DOUBLE AS preference_margin, text
  FROM documents WHERE text IS NOT NULL
), doc_results AS (
  SELECT *, preference_margin > 0 AS correct, NOT (preference_margin > 0) AS failure, abs(preference_margin) <= 0.1 AS near_failure FROM docs
)"""
LENGTH = "CASE WHEN len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')) > 0 THEN list_sum(list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''), lambda x: length(x)))::DOUBLE / len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')) ELSE 0.0::DOUBLE END"
