"""Queries of the evaluation operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions import rewards
from pairlight.functions.text import alphabetic_tokens, distance_bucket, first_present, model_key, whitespace_tokens
from pairlight.operators import compare, diagnostics, generate, quotas, scoring, search, summaries
from pairlight.operators.scoring import score_pairs
from pairlight.plans.derived import BUCKET, DOC_RESULTS, GEN_PAIRS, LENGTH, MODEL_SCORES, MODELS, NEAR, as_pairs, doc_results, gen_pairs, model_scores, sql_md5
from pairlight.session import table
from pairlight.sources.records import matches_phenomenon, normalized_pair_id, normalized_phenomenon
from pairlight.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FIELDS = ["subtype", "template_type", "dependency_distance_bucket", "clause_depth"]

METRICS = "count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) AS accuracy"
RATES = METRICS + ", count(*) FILTER (failure) / count(*) AS failure_rate, count(*) FILTER (near_failure) / count(*) AS near_failure_rate"
MEAN = "coalesce(avg(preference_margin), 0.0::DOUBLE) AS mean_preference_margin"
OVERALL = f"overall AS (SELECT model_id, dataset, {RATES}, {MEAN} FROM model_scores GROUP BY ALL)"
GROUPED = "grouped AS (" + " UNION ALL ".join(f"SELECT model_id, dataset, '{f}' AS group_by, {f}::VARCHAR AS group_name, {RATES}, {MEAN} FROM model_scores WHERE {f} IS NOT NULL GROUP BY model_id, dataset, {f}" for f in FIELDS) + ")"
BY_MODEL = "by_model AS (" + " UNION ALL ".join(f"SELECT model_id, '{f}' AS group_by, coalesce({f}::VARCHAR, 'None') AS group_name, {RATES}, {MEAN} FROM model_scores GROUP BY model_id, {f}" for f in FIELDS) + ")"
SIDES = ("accuracy", "failure_rate", "mean_preference_margin", "total")
BOTH = ", ".join(f"{s}.{m} AS {n}_{m}" for s, n in (("b", "benchmark"), ("r", "rl")) for m in SIDES)
DELTAS = ", ".join(f"r.{m} - b.{m} AS {m}_delta" for m in SIDES[:3]) + ", r.accuracy < b.accuracy OR r.failure_rate > b.failure_rate AS rl_harder, abs(r.mean_preference_margin) < abs(b.mean_preference_margin) AS rl_boundary_closer"
SHARED = f"shared AS (SELECT b.model_id, b.group_name AS subtype, {BOTH}, {DELTAS} FROM grouped b JOIN grouped r USING (model_id, group_by, group_name) WHERE b.dataset = 'benchmark' AND r.dataset = 'rl' AND group_by = 'subtype')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _overall(spark, d):
    return summaries.summarize(model_scores(spark, d), ["model_id", "dataset"])


def _grouped(spark, d):
    return summaries.summarize_fields(model_scores(spark, d), FIELDS, ["model_id", "dataset"])


def _by_model(spark, d):
    return summaries.summarize_fields(model_scores(spark, d), FIELDS, ["model_id"], nulls="literal")


@query(f"WITH {GEN_PAIRS}, s AS (SELECT uid AS pair_id, {LENGTH.format(c='sentence_good')} AS grammatical_score, {LENGTH.format(c='sentence_bad')} AS ungrammatical_score FROM gen_pairs) SELECT *, grammatical_score - ungrammatical_score AS preference_margin, grammatical_score > ungrammatical_score AS correct, abs(grammatical_score - ungrammatical_score) <= 0.2 AS near_failure, ungrammatical_score > grammatical_score AS model_failed FROM s")
def pair_scores(spark, d):
    """Both sides under the length scorer."""
    scored = scoring.add_scores(as_pairs(gen_pairs(spark, d)), scoring.build_scorer(scoring.ScorerOptions()), 0.2)
    return scored.select("pair_id", "grammatical_score", "ungrammatical_score", "preference_margin", "correct", "near_failure", "model_failed")


@query(f"WITH {MODEL_SCORES}, {OVERALL} SELECT * FROM overall")
def overall_summary(spark, d):
    return _overall(spark, d)


@query(f"WITH {MODEL_SCORES}, {GROUPED} SELECT * FROM grouped")
def grouped_summary(spark, d):
    return _grouped(spark, d)


@query("WITH " + DOC_RESULTS + " " + " UNION ALL ".join(f"SELECT '{f}' AS group_by, coalesce({f}, 'None') AS group_name, {RATES}, {MEAN} FROM doc_results GROUP BY 2" for f in ("lang", "source", "bucket")))
def grouped_summary_null_literal(spark, d):
    return summaries.summarize_fields(doc_results(spark, d), ["lang", "source", "bucket"], nulls="literal")


@query("WITH " + DOC_RESULTS + f" SELECT 'all' AS group_by, 'all' AS group_name, {METRICS}, {MEAN} FROM doc_results UNION ALL " + " UNION ALL ".join(f"SELECT '{f}', {f}, {METRICS}, {MEAN} FROM doc_results WHERE {f} IS NOT NULL GROUP BY {f}" for f in ("lang", "source")))
def baseline_grouped(spark, d):
    rows = doc_results(spark, d)
    whole = summaries.summarize(rows, rates=False).withColumn("group_by", F.lit("all")).withColumn("group_name", F.lit("all"))
    return whole.unionByName(summaries.summarize_fields(rows, ["lang", "source"], nulls="skip", rates=False))


@query(f"WITH {MODEL_SCORES}, {GROUPED}, {SHARED} SELECT * FROM shared")
def shared_subtype_comparison(spark, d):
    return compare.shared_subtypes(_grouped(spark, d))


@query(f"WITH {MODEL_SCORES}, {OVERALL} SELECT b.model_id, {BOTH}, {DELTAS} FROM overall b JOIN overall r USING (model_id) WHERE b.dataset = 'benchmark' AND r.dataset = 'rl'")
def overall_deltas(spark, d):
    return compare.overall_deltas(_overall(spark, d))


@query(f"""WITH {MODEL_SCORES}, {OVERALL}, dim AS (
  SELECT coalesce(nullif(trim(id), ''), translate(name, '/:', '__')) AS model_id, name AS model_name, coalesce(provider, 'unknown') AS model_provider
  FROM (VALUES ('hf_distilgpt2', 'distil/gpt2:base', 'hf'), ('hf_gpt2', 'gpt2', 'hf'), (' ', 'hf:tiny/gpt2', NULL)) AS v(id, name, provider))
SELECT o.model_id, o.dataset, o.total, o.accuracy, model_name, model_provider FROM overall o LEFT JOIN dim USING (model_id)""")
def model_metadata_join(spark, d):
    rows = spark.createDataFrame([("hf_distilgpt2", "distil/gpt2:base", "hf"), ("hf_gpt2", "gpt2", "hf"), (" ", "hf:tiny/gpt2", None)], "id string, name string, provider string")
    dim = rows.select(model_key("id", "name").alias("model_id"), F.col("name").alias("model_name"), F.coalesce("provider", F.lit("unknown")).alias("model_provider"), F.lit(0).alias("total"))
    return compare.with_model_metadata(_overall(spark, d).select("model_id", "dataset", "total", "accuracy"), dim)


@query(f"WITH {MODEL_SCORES}, {GROUPED}, {SHARED} SELECT model_id, subtype, accuracy_delta, failure_rate_delta, row_number() OVER (PARTITION BY model_id ORDER BY accuracy_delta, failure_rate_delta DESC, subtype) AS rank FROM shared WHERE rl_harder")
def harder_shared_ranked(spark, d):
    return compare.harder_shared(_grouped(spark, d))


_RANK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dataset ORDER BY {o}) AS rank FROM grouped WHERE group_by = 'subtype') WHERE rank <= 5"
_HARD = "accuracy, failure_rate DESC, mean_preference_margin, group_name"


@query(f"WITH {MODEL_SCORES}, {GROUPED} " + _RANK.format(o=_HARD))
def hardest_subtypes(spark, d):
    return compare.ranked(_grouped(spark, d).where("group_by = 'subtype'"), ["model_id", "dataset"], compare.HARDEST, 5)


@query(f"WITH {MODEL_SCORES}, {GROUPED} " + _RANK.format(o="accuracy DESC, failure_rate, mean_preference_margin DESC, group_name"))
def easiest_subtypes(spark, d):
    return compare.ranked(_grouped(spark, d).where("group_by = 'subtype'"), ["model_id", "dataset"], compare.EASIEST, 5)


@query(f"""WITH {MODEL_SCORES}, {GROUPED}, runs AS (
  SELECT 'current' AS source, * FROM grouped WHERE dataset = 'rl' UNION ALL SELECT 'earlier', * REPLACE ('controlled' AS dataset) FROM grouped WHERE dataset = 'benchmark')
SELECT source, model_id, dataset, rank, group_name AS subtype, accuracy, failure_rate, mean_preference_margin, NULL::VARCHAR AS note
FROM (SELECT *, row_number() OVER (PARTITION BY source, model_id, dataset ORDER BY {_HARD}) AS rank FROM runs WHERE group_by = 'subtype') WHERE rank <= 5
UNION ALL SELECT 'lost', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing'""")
def cross_source_hardest(spark, d):
    g = _grouped(spark, d)
    earlier = g.where("dataset = 'benchmark'").withColumn("dataset", F.lit(None).cast("string"))
    return compare.cross_source_hardest({"current": g.where("dataset = 'rl'"), "earlier": earlier, "lost": None})


@query(f"""WITH {MODEL_SCORES}, {GROUPED}, r AS (SELECT *, total - correct AS failures, row_number() OVER (PARTITION BY model_id ORDER BY failure_rate DESC, total - correct DESC, group_name) AS rn FROM grouped WHERE group_by = 'subtype' AND dataset = 'rl'),
s AS (SELECT model_id, sum(failures)::BIGINT AS total_failures, sum(CASE WHEN rn <= 3 THEN failures ELSE 0 END)::BIGINT AS top_failures FROM r GROUP BY 1)
SELECT *, CASE WHEN total_failures > 0 THEN top_failures / total_failures ELSE 0.0::DOUBLE END AS top_failure_share, total_failures > 0 AND top_failures / total_failures >= 0.6 AS concentrated FROM s""")
def failure_concentration(spark, d):
    return compare.failure_concentration(_grouped(spark, d))


@query(f"WITH {MODEL_SCORES}, {GROUPED} SELECT model_id, dataset, group_name, total - correct AS failures, CASE WHEN sum(total - correct) OVER (PARTITION BY model_id, dataset) > 0 THEN (total - correct) / sum(total - correct) OVER (PARTITION BY model_id, dataset) ELSE 0.0::DOUBLE END AS failure_share FROM grouped WHERE group_by = 'template_type'")
def template_failure_share(spark, d):
    return compare.failure_share(_grouped(spark, d))


@query(f"""WITH {GEN_PAIRS}, rows AS (SELECT dataset, subtype, template_type FROM gen_pairs), v AS (
  SELECT DISTINCT dataset, 'subtype' AS group_by, subtype AS group_name FROM rows UNION SELECT DISTINCT dataset, 'template_type', template_type FROM rows),
s AS (SELECT group_by, group_name, bool_or(dataset = 'benchmark') AS b, bool_or(dataset = 'rl') AS r FROM v GROUP BY ALL)
SELECT group_by, count(*) FILTER (b) AS benchmark_count, count(*) FILTER (r) AS rl_count, count(*) FILTER (b AND r) AS shared_count,
  coalesce(string_agg(group_name, ',' ORDER BY group_name) FILTER (b AND NOT r), '') AS benchmark_only, coalesce(string_agg(group_name, ',' ORDER BY group_name) FILTER (r AND NOT b), '') AS rl_only, bool_or(b <> r) AS coverage_mismatch FROM s GROUP BY 1""")
def coverage_mismatch(spark, d):
    rows = summaries.count_fields(gen_pairs(spark, d), ["subtype", "template_type"], ["dataset"])
    return compare.coverage(rows)


@query(f"""WITH {MODEL_SCORES}, {GROUPED}, c AS (SELECT model_id, group_name AS subtype, sum(CASE WHEN dataset = 'benchmark' THEN total ELSE 0 END)::BIGINT AS benchmark_count, sum(CASE WHEN dataset = 'rl' THEN total ELSE 0 END)::BIGINT AS rl_count FROM grouped
  WHERE group_by = 'subtype' GROUP BY ALL),
s AS (SELECT *, benchmark_count / sum(benchmark_count) OVER (PARTITION BY model_id) AS benchmark_share, rl_count / sum(rl_count) OVER (PARTITION BY model_id) AS rl_share FROM c)
SELECT *, rl_share - benchmark_share AS share_delta FROM s WHERE abs(rl_share - benchmark_share) >= 0.002 OR benchmark_count = 0 OR rl_count = 0""")
def distribution_mismatch(spark, d):
    return compare.distribution_mismatch(_grouped(spark, d), 0.002)


_WIDE_CELLS = ", ".join(f"max(accuracy) FILTER (model_id = '{m}') AS {m}" for m in MODELS)
_WIDE_FAIL = ", ".join(f"max(failure_rate) FILTER (model_id = '{m}') AS {m}" for m in MODELS)
_WIDE_MEAN = "(" + " + ".join(f"coalesce({m}, 0)" for m in MODELS) + ") / (" + " + ".join(f"({m} IS NOT NULL)::INT" for m in MODELS) + ")"


@query(f"WITH {MODEL_SCORES}, {BY_MODEL}, w AS (SELECT group_name, {_WIDE_CELLS} FROM by_model WHERE group_by = 'subtype' GROUP BY 1) SELECT *, {_WIDE_MEAN} AS mean_across_models FROM w")
def wide_metric_by_subtype(spark, d):
    return compare.wide_metric(_by_model(spark, d), "subtype", "accuracy", MODELS)


@query(f"WITH {MODEL_SCORES}, {BY_MODEL}, w AS (SELECT group_name, {_WIDE_FAIL} FROM by_model WHERE group_by = 'subtype' GROUP BY 1), m AS (SELECT group_name, {_WIDE_MEAN} AS mean_across_models FROM w) SELECT *, row_number() OVER (ORDER BY mean_across_models DESC, group_name DESC) AS position FROM m")
def figure_order_by_failure(spark, d):
    return compare.ordered_by_mean(compare.wide_metric(_by_model(spark, d), "subtype", "failure_rate", MODELS), "failure_rate")


@query(f"WITH {MODEL_SCORES}, {BY_MODEL} SELECT group_name AS subtype, min(accuracy) AS accuracy_min, max(accuracy) AS accuracy_max, max(accuracy) - min(accuracy) AS accuracy_range FROM by_model WHERE group_by = 'subtype' GROUP BY 1 HAVING count(*) >= 2 AND max(accuracy) - min(accuracy) >= 0.005")
def difficulty_change(spark, d):
    return compare.difficulty_change(_by_model(spark, d), 0.005).drop("by_model")


@query(f"WITH {MODEL_SCORES}, {BY_MODEL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY {_HARD}) AS rn FROM by_model WHERE group_by = 'subtype') WHERE rn <= 8) SELECT group_name AS subtype FROM t GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model_id) FROM t)")
def consistently_hard(spark, d):
    return compare.consistently_hard(_by_model(spark, d), 8)


_DISAGREE = f"""{MODEL_SCORES}, p AS (
  SELECT dataset, pair_id, min(subtype) AS subtype, min(template_type) AS template_type, list_sort(list(model_id) FILTER (NOT correct)) AS failed,
    coalesce(bool_or(correct) FILTER (model_id = 'hf_tiny_gpt2'), false) AS tiny_correct, coalesce(bool_or(correct) FILTER (model_id = 'hf_distilgpt2'), false) AS distilgpt2_correct, coalesce(bool_or(correct) FILTER (model_id = 'hf_gpt2'), false) AS gpt2_correct,
    max(preference_margin) FILTER (model_id = 'hf_tiny_gpt2') AS tiny_margin, max(preference_margin) FILTER (model_id = 'hf_gpt2') AS gpt2_margin
  FROM model_scores GROUP BY 1, 2
), disagreement AS (
  SELECT dataset, pair_id, subtype, template_type, CASE
    WHEN failed = ['hf_tiny_gpt2'] THEN 'tiny_fails_stronger_succeed' WHEN NOT (tiny_correct OR distilgpt2_correct OR gpt2_correct) THEN 'all_models_fail'
    WHEN tiny_correct AND (distilgpt2_correct <> gpt2_correct) THEN 'only_one_stronger_model_fails' WHEN failed IS NULL OR len(failed) = 0 THEN 'all_models_succeed' ELSE 'mixed_disagreement' END AS category,
    coalesce(array_to_string(failed, ','), '') AS failed_models, tiny_correct, distilgpt2_correct, gpt2_correct, tiny_margin, gpt2_margin FROM p
)"""


@query(f"WITH {_DISAGREE} SELECT * FROM disagreement")
def disagreement_rows(spark, d):
    return diagnostics.disagreement(model_scores(spark, d))


@query(f"WITH {_DISAGREE} SELECT dataset, category, count(*) AS n FROM disagreement GROUP BY ALL")
def disagreement_counts(spark, d):
    return diagnostics.disagreement(model_scores(spark, d)).groupBy("dataset", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MODEL_SCORES}, s AS (SELECT subtype, count(DISTINCT model_id) AS k, {", ".join(f"count(*) FILTER (model_id = '{m}' AND NOT correct) / count(*) FILTER (model_id = '{m}') AS {m}_failure_rate" for m in MODELS[:2])}
  FROM model_scores WHERE dataset = 'rl' AND model_id IN ('hf_distilgpt2', 'hf_gpt2') GROUP BY 1) SELECT * EXCLUDE (k) FROM s WHERE k = 2 AND hf_distilgpt2_failure_rate >= 0.2 AND hf_gpt2_failure_rate >= 0.2""")
def stronger_hard_subtypes(spark, d):
    return diagnostics.stronger_hard_subtypes(model_scores(spark, d))


def _feature_sql(c: str, subtype: str = "subtype") -> str:
    tokens = f"list_transform(regexp_extract_all({c}, '[A-Za-z]+'), lambda x: lower(x))"
    inside = lambda words: f"list_filter({tokens}, lambda x: list_contains([{', '.join(repr(w) for w in words)}], x))"
    from pairlight.functions.lexicon import NOUNS, PREPOSITIONS, VERBS

    return f"{inside(NOUNS)} AS nouns, {inside(VERBS)} AS verbs, {inside(PREPOSITIONS)} AS preps"


_PATTERN = "subtype || '|' || array_to_string(nouns[1:3], '+') || '|' || array_to_string(verbs[greatest(len(verbs) - 1, 1):], '+') || '|' || array_to_string(preps, '+')"


@query(f"""WITH {MODEL_SCORES}, tiny AS (SELECT * FROM model_scores WHERE model_id = 'hf_tiny_gpt2'), x AS (
  SELECT * FROM tiny WHERE dataset = 'rl' AND NOT correct AND subtype IN (SELECT subtype FROM tiny WHERE dataset = 'benchmark' AND correct) ORDER BY preference_margin, subtype, pair_id LIMIT 100),
f AS (SELECT *, {_feature_sql('grammatical')} FROM x)
SELECT pair_id, subtype, template_type, preference_margin, grammatical_score, ungrammatical_score, {_PATTERN} AS lexical_pattern, grammatical AS sentence_good, ungrammatical AS sentence_bad FROM f""")
def extreme_failures(spark, d):
    return diagnostics.extreme_failures(model_scores(spark, d))


_INSPECT = "dataset, model_id, pair_id AS uid, subtype, template_type, grammatical, ungrammatical, grammatical_score, ungrammatical_score, preference_margin, correct"


@query(f"WITH {MODEL_SCORES} SELECT {_INSPECT} FROM model_scores WHERE model_id = 'hf_tiny_gpt2' AND dataset = 'rl' ORDER BY preference_margin, correct, pair_id LIMIT 20")
def hardest_examples(spark, d):
    return diagnostics.hardest_examples(model_scores(spark, d), "hf_tiny_gpt2", "rl", 20)


@query(f"""WITH {MODEL_SCORES}, h AS (SELECT {_INSPECT} FROM model_scores WHERE model_id = 'hf_gpt2' AND dataset = 'rl' ORDER BY preference_margin, correct, pair_id LIMIT 10)
SELECT * FROM h UNION ALL (SELECT {_INSPECT} FROM model_scores WHERE model_id = 'hf_gpt2' AND dataset = 'benchmark' AND subtype IN (SELECT subtype FROM h) ORDER BY preference_margin, pair_id LIMIT 10)""")
def shared_examples(spark, d):
    return diagnostics.shared_examples(model_scores(spark, d), 20)


@query("""WITH c AS (SELECT 'text' AS kind, count(*) AS n FROM documents GROUP BY text UNION ALL SELECT 'text_source', count(*) FROM documents GROUP BY text, source UNION ALL SELECT 'doc_id', count(*) FROM documents GROUP BY doc_id)
SELECT kind, count(*) FILTER (n > 1) AS duplicated, max(n) AS most FROM c GROUP BY 1""")
def duplicate_summary(spark, d):
    return diagnostics.duplicate_summary(table(spark, d, "documents"), {"text": ["text"], "text_source": ["text", "source"], "doc_id": ["doc_id"]})


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_rows(spark, d):
    return diagnostics.duplicate_rows(table(spark, d, "documents"), ["text"]).select(F.md5("text").alias("text_md5"), "n")


_TERMS = f"""{GEN_PAIRS}, f AS (SELECT dataset, subtype, uid, {_feature_sql('sentence_good')} FROM gen_pairs), g AS (SELECT *, {_PATTERN} AS pattern FROM f),
terms AS (
  SELECT dataset, subtype, uid, 'nouns' AS kind, unnest(nouns) AS term, generate_subscripts(nouns, 1) AS i FROM g UNION ALL SELECT dataset, subtype, uid, 'verbs', unnest(verbs), generate_subscripts(verbs, 1) FROM g
  UNION ALL SELECT dataset, subtype, uid, 'prepositions', unnest(preps), generate_subscripts(preps, 1) FROM g UNION ALL SELECT dataset, subtype, uid, 'patterns', pattern, 1 FROM g)"""


def _lexical_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    lists = ", ".join(f"'[' || coalesce(string_agg('[\"' || term || '\", ' || n || ']', ', ' ORDER BY rank) FILTER (kind = '{x}' AND rank <= 5), '') || ']' AS top_{x}" for x in ("nouns", "verbs", "patterns"))
    return f"""WITH {_TERMS}, c AS (SELECT {k}, kind, term, count(*) AS n, min((uid, i)) AS first FROM terms GROUP BY {k}, kind, term),
r AS (SELECT *, row_number() OVER (PARTITION BY {k}, kind ORDER BY n DESC, first) AS rank FROM c)
SELECT {k}, (sum(n) FILTER (kind = 'patterns'))::BIGINT AS total, count(*) FILTER (kind = 'nouns') AS unique_nouns, count(*) FILTER (kind = 'verbs') AS unique_verbs, count(*) FILTER (kind = 'prepositions') AS unique_prepositions, {lists},
  max(n) FILTER (kind = 'patterns') / sum(n) FILTER (kind = 'patterns') AS top_pattern_share FROM r GROUP BY {k}"""


@query(_lexical_sql(["dataset"]))
def lexical_summary(spark, d):
    return diagnostics.lexical_summary(gen_pairs(spark, d), ["dataset"], "uid")


@query(_lexical_sql(["dataset", "subtype"]))
def lexical_by_subtype(spark, d):
    return diagnostics.lexical_summary(gen_pairs(spark, d), ["dataset", "subtype"], "uid")


@query(f"WITH {GEN_PAIRS}, f AS (SELECT uid, subtype, {_feature_sql('sentence_good')} FROM gen_pairs) SELECT uid, {_PATTERN} AS pattern FROM f")
def lexical_pattern(spark, d):
    return diagnostics.with_lexical_features(gen_pairs(spark, d)).select("uid", "pattern")


_DEFECTS_SQL = """defects AS (SELECT key, uid, CASE WHEN key % 11 = 1 THEN ' ' ELSE phenomenon END AS phenomenon, sentence_good,
  CASE WHEN key % 7 = 1 THEN sentence_good WHEN key % 7 = 2 THEN 'A ' || sentence_bad WHEN key % 7 = 3 THEN replace(sentence_good, '.', 'x.') ELSE sentence_bad END AS sentence_bad,
  CASE WHEN key % 5 = 1 THEN 'many' WHEN key % 5 = 2 THEN '-1' WHEN key % 5 = 3 THEN '9' ELSE dependency_distance::VARCHAR END AS dependency_distance, attractor_count::VARCHAR AS attractor_count, clause_depth::VARCHAR AS clause_depth,
  CASE WHEN key % 13 = 1 THEN 'other' ELSE template_type END AS template_type, CASE WHEN key % 3 = 1 THEN subtype || '_x' ELSE subtype END AS subtype FROM gen_pairs)"""


def _defects(spark, d):
    k = F.col("key")
    r = gen_pairs(spark, d)
    return r.select(
        "key", "uid", F.when(k % 11 == 1, " ").otherwise(F.col("phenomenon")).alias("phenomenon"), "sentence_good",
        F.when(k % 7 == 1, F.col("sentence_good")).when(k % 7 == 2, F.concat(F.lit("A "), "sentence_bad")).when(k % 7 == 3, F.replace("sentence_good", F.lit("."), F.lit("x."))).otherwise(F.col("sentence_bad")).alias("sentence_bad"),
        F.when(k % 5 == 1, "many").when(k % 5 == 2, "-1").when(k % 5 == 3, "9").otherwise(F.col("dependency_distance").cast("string")).alias("dependency_distance"), F.col("attractor_count").cast("string").alias("attractor_count"), F.col("clause_depth").cast("string").alias("clause_depth"),
        F.when(k % 13 == 1, "other").otherwise(F.col("template_type")).alias("template_type"), F.when(k % 3 == 1, F.concat("subtype", F.lit("_x"))).otherwise(F.col("subtype")).alias("subtype"),
    )


def _valid_sql(source: str) -> str:
    """The validation rules over a table of generated records, as ``heur`` with the messages ``e`` of each record."""
    from pairlight.functions.lexicon import ALLOWED_METADATA, PREPOSITIONS, PRONOUNS, VERBS_PLURAL, VERBS_SINGULAR

    some = lambda parts: f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    named = lambda values: "[" + ", ".join(repr(v) for v in values) + "]"
    tokens = lambda c: f"list_filter(regexp_split_to_array(regexp_replace({c}, '\\.+$', ''), '\\s+'), lambda x: x <> '')"
    words = "list_transform(regexp_extract_all(coalesce(sentence_good, ''), '[A-Za-z]+'), lambda x: lower(x))"
    known = named(f"{x} {y}" for s, q in zip(VERBS_SINGULAR, VERBS_PLURAL, strict=True) for x, y in ((s, q), (q, s)))
    numbers = diagnostics.NUMBERS
    absent = [f"CASE WHEN trim(coalesce({c}::VARCHAR, '')) = '' THEN 'Missing or empty required field: {c}' END" for c in generate.PAIR_FIELDS]
    found = [f"""CASE WHEN len(a) <> len(b) THEN 'Good/bad sentences must have the same token length.' WHEN apart <> 1 THEN 'Good/bad sentences must differ in exactly one token; found ' || apart || '.'
    WHEN coalesce(a[-1], '') = coalesce(b[-1], '') THEN 'The differing token must be the final main verb.' WHEN NOT list_contains({known}, a[-1] || ' ' || b[-1]) THEN 'Differing final tokens are not a known agreement verb pair: ' || a[-1] || ' / ' || b[-1] END"""]
    found += [f"CASE WHEN n_{c} IS NULL THEN 'Metadata field must be an integer: {c}' WHEN n_{c} < 0 THEN 'Metadata field must be non-negative: {c}' END" for c in numbers]
    found.append(f"CASE WHEN template_type NOT IN ({', '.join(repr(k) for k in ALLOWED_METADATA)}) THEN 'Unknown template_type: ' || template_type END")
    for c in numbers:
        cases = " ".join(f"WHEN template_type = '{k}' AND n_{c} NOT IN ({', '.join(map(str, v[c]))}) THEN '{c}=' || {c} || ' is inconsistent with template_type={k}; expected one of {{{', '.join(map(str, v[c]))}}}.'" for k, v in ALLOWED_METADATA.items())
        found.append(f"CASE {cases} END")
    found.append("CASE WHEN len(a) < 3 THEN 'Sentence must have at least three tokens.' WHEN n_dependency_distance <> len(a) - 2 THEN 'dependency_distance=' || n_dependency_distance || ' does not match computed distance ' || (len(a) - 2) || '.' END")
    kind = lambda k: f"coalesce(template_type, '') = '{k}'"
    heuristics = [
        f"CASE WHEN {kind('pp_attractor')} AND len(preps) = 0 THEN 'PP subtype has no recognized preposition.' WHEN {kind('pp_attractor')} AND NOT ends_with(s, preps[1]) THEN 'Subtype ' || s || ' does not match preposition ' || preps[1] || '.' END",
        f"CASE WHEN {kind('pp_attractor')} AND contains(s, 'plural_attractor') AND coalesce(n_attractor_count, 0) <> 1 THEN 'PP attractor subtype should have attractor_count=1.' END",
        f"CASE WHEN {kind('relative_clause')} AND len(prons) = 0 THEN 'Relative-clause subtype has no that/who token.' "
        + " ".join(f"WHEN {kind('relative_clause')} AND ends_with(s, '{w}') AND NOT list_contains(prons, '{w}') THEN 'Subtype ends with {w} but sentence does not use {w}.'" for w in PRONOUNS) + " END",
        f"CASE WHEN {kind('relative_clause')} AND contains(s, 'plural_embedded') AND coalesce(n_attractor_count, 0) <> 1 THEN 'Plural-embedded relative subtype should have attractor_count=1.' END",
    ]
    return f"""tok AS (SELECT *, {tokens('sentence_good')} AS a, {tokens('sentence_bad')} AS b, coalesce(subtype, '') AS s, {", ".join(f"try_cast({c} AS INTEGER) AS n_{c}" for c in numbers)},
  list_filter({words}, lambda x: list_contains({named(PREPOSITIONS)}, x)) AS preps, list_filter({words}, lambda x: list_contains({named(PRONOUNS)}, x)) AS prons FROM {source}),
dif AS (SELECT *, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS apart FROM tok),
msgs AS (SELECT *, {some(absent)} AS absent, {some(found)} AS found, {some(heuristics)} AS odd FROM dif),
heur AS (SELECT *, CASE WHEN len(absent) > 0 THEN absent ELSE found END || odd AS e FROM msgs)"""


_VALID_SQL = f"{GEN_PAIRS}, {_DEFECTS_SQL}, {_valid_sql('defects')}"


@query(f"WITH {_VALID_SQL} SELECT uid, subtype, template_type, len(e) = 0 AS valid, len(e) AS error_count, array_to_string(e, ' | ') AS errors, sentence_good, sentence_bad FROM heur")
def record_validation(spark, d):
    """Validation of generated records with injected defects."""
    return diagnostics.validate(_defects(spark, d))


@query(f"WITH {_VALID_SQL} SELECT count(*) AS records, count(*) FILTER (len(e) > 0) AS invalid FROM heur")
def validation_tally(spark, d):
    return diagnostics.validate(_defects(spark, d)).agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("valid")).alias("invalid"))


@query(f"""WITH {_DISAGREE}, own AS (SELECT * FROM gen_pairs WHERE dataset = 'rl'), {_valid_sql('own')}, f AS (SELECT dataset, subtype, sentence_good, sentence_bad, {_feature_sql('sentence_good')} FROM gen_pairs), g AS (SELECT *, {_PATTERN} AS pattern FROM f),
p AS (SELECT dataset, max(n) / sum(n) AS s FROM (SELECT dataset, pattern, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1),
one AS (SELECT (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM gen_pairs WHERE dataset = 'rl' GROUP BY subtype)) AS top_rl_subtype_share, (SELECT s FROM p WHERE dataset = 'rl') AS rl_top_pattern_share, (SELECT s FROM p WHERE dataset = 'benchmark') AS benchmark_top_pattern_share,
  (SELECT count(*) FROM (SELECT 1 FROM gen_pairs WHERE dataset = 'rl' GROUP BY sentence_good, sentence_bad HAVING count(*) > 1)) AS duplicate_pair_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM gen_pairs WHERE dataset = 'rl' GROUP BY sentence_good)) AS max_good_sentence_repetition,
  (SELECT count(*) FROM heur WHERE len(e) > 0) AS validation_error_count, (SELECT count(*) FROM disagreement WHERE dataset = 'rl' AND category = 'tiny_fails_stronger_succeed') AS tiny_only_failures)
SELECT *, top_rl_subtype_share > 0.25 AS subtype_collapse, rl_top_pattern_share > greatest(benchmark_top_pattern_share * 2, 0.15) AS lexical_collapse, duplicate_pair_count > 0 OR max_good_sentence_repetition > 2 AS duplicate_evidence, validation_error_count > 0 AS metadata_issue, tiny_only_failures > 0 AS tiny_artifact FROM one""".replace(", p AS (\n", ", q AS (\n", 1).replace("FROM p\n)", "FROM q\n)", 1))
def collapse_flags(spark, d):
    pairs = materialize(gen_pairs(spark, d))
    return diagnostics.collapse_flags(pairs, score_pairs(as_pairs(pairs), {m: scoring.hash_scorer(m) for m in MODELS}, NEAR))


@query("""WITH c AS (SELECT user_id % 50 AS user_group, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_group ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY user_group) AS total FROM c)
SELECT user_group, event_type AS dominant, n / total AS share, n / total >= 0.25 AS collapsed FROM r WHERE rn = 1""")
def dominance(spark, d):
    e = table(spark, d, "events").withColumn("user_group", F.col("user_id") % 50)
    return summaries.dominance(e, ["user_group"], "event_type", "event_id", 0.25)


_COUNTS_SQL = f"{GEN_PAIRS}, counts AS (SELECT subtype, count(*) AS n FROM gen_pairs WHERE dataset = 'benchmark' GROUP BY 1)"


def _counts(spark, d):
    return gen_pairs(spark, d).where("dataset = 'benchmark'").groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


_SCALED = "raw AS (SELECT subtype, n * 240.0::DOUBLE / sum(n) OVER () AS r FROM counts), fl AS (SELECT *, CAST(floor(r) AS BIGINT) AS f FROM raw), rk AS (SELECT *, row_number() OVER (ORDER BY r - f DESC, subtype DESC) AS rn, 240 - sum(f) OVER () AS rest FROM fl), quotas AS (SELECT subtype, f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS target_count FROM rk)"


@query(f"WITH {_COUNTS_SQL}, {_SCALED} SELECT subtype, target_count::BIGINT AS target_count FROM quotas WHERE target_count > 0")
def scaled_quotas(spark, d):
    return quotas.target_counts(_counts(spark, d), generate.templates(spark), 240)


@query(f"WITH {_COUNTS_SQL}, u AS (SELECT subtype, unnest(range(1, n + 1)) AS unit FROM counts), k AS (SELECT * FROM u ORDER BY unit, subtype LIMIT 200) SELECT subtype, count(*) AS n FROM k GROUP BY 1")
def capped_quotas(spark, d):
    return quotas.cap_counts(_counts(spark, d), "subtype", "n", 200)


_PLAN_ROWS = "rows AS (SELECT *, uid AS pair_id FROM gen_pairs)"
_PLAN = f"""{_PLAN_ROWS}, av AS (SELECT subtype AS group_name, count(*) FILTER (dataset = 'benchmark') AS benchmark_available, count(*) FILTER (dataset = 'rl') AS rl_available FROM rows GROUP BY 1),
w AS (SELECT *, least(20, benchmark_available, rl_available) AS wanted FROM av), u AS (SELECT group_name, unnest(range(1, wanted + 1)) AS unit FROM w WHERE wanted > 0), k AS (SELECT group_name, count(*) AS sampled FROM (SELECT * FROM u ORDER BY unit, group_name LIMIT 250) GROUP BY 1),
plan AS (SELECT w.group_name, benchmark_available, rl_available, coalesce(sampled, 0) AS sampled, CASE WHEN coalesce(sampled, 0) <= 0 AND benchmark_available > 0 AND rl_available > 0 THEN 'dropped_by_total_cap' WHEN coalesce(sampled, 0) <= 0 THEN 'insufficient_examples' WHEN sampled < 20 THEN 'limited_by_available_examples' ELSE 'matched' END AS status FROM w LEFT JOIN k USING (group_name))"""


def _plan_rows(spark, d):
    return gen_pairs(spark, d).withColumnRenamed("uid", "pair_id")


@query(f"WITH {GEN_PAIRS}, {_PLAN} SELECT * FROM plan")
def matched_plan(spark, d):
    return quotas.matched_plan(_plan_rows(spark, d), "subtype", 20, 250)


@query(f"WITH {GEN_PAIRS}, {_PLAN}, o AS (SELECT r.dataset, r.subtype, r.pair_id, sampled, row_number() OVER (PARTITION BY dataset, subtype ORDER BY {sql_md5(chr(39) + '42' + chr(39), 'pair_id')}, pair_id) AS rn FROM rows r JOIN plan ON subtype = group_name) SELECT dataset, subtype, pair_id FROM o WHERE rn <= sampled")
def matched_sample(spark, d):
    rows = _plan_rows(spark, d)
    return quotas.matched_sample(rows, quotas.matched_plan(rows, "subtype", 20, 250), "subtype").select("dataset", "subtype", "pair_id")


def _names_sql(status: str) -> str:
    return f"coalesce(string_agg(group_name, ',' ORDER BY group_name) FILTER (status = '{status}'), '')"


@query(f"WITH {GEN_PAIRS}, {_PLAN} SELECT sum(sampled)::BIGINT AS sampled_per_dataset, {_names_sql('matched')} AS matched, {_names_sql('limited_by_available_examples')} AS limited, {_names_sql('dropped_by_total_cap')} AS dropped, {_names_sql('insufficient_examples')} AS insufficient FROM plan")
def matched_summary(spark, d):
    return quotas.matched_summary(quotas.matched_plan(_plan_rows(spark, d), "subtype", 20, 250))


@query(f"""WITH {_COUNTS_SQL}, {_SCALED}, a AS (SELECT subtype, count(*) AS achieved_count FROM gen_pairs WHERE dataset = 'rl' GROUP BY 1),
j AS (SELECT coalesce(q.subtype, a.subtype) AS subtype, coalesce(target_count, 0)::BIGINT AS target_count, coalesce(achieved_count, 0) AS achieved_count FROM quotas q FULL JOIN a ON q.subtype = a.subtype)
SELECT *, greatest(target_count - achieved_count, 0) AS missing_count, greatest(achieved_count - target_count, 0) AS extra_count, target_count / sum(target_count) OVER () AS target_share, achieved_count / sum(achieved_count) OVER () AS achieved_share FROM j""")
def quota_comparison(spark, d):
    achieved = gen_pairs(spark, d).where("dataset = 'rl'").groupBy("subtype").agg(F.count(F.lit(1)).alias("achieved_count"))
    return quotas.compare_distribution(quotas.target_counts(_counts(spark, d), generate.templates(spark), 240), achieved)


@query(f"WITH {_COUNTS_SQL}, {_SCALED}, j AS (SELECT DISTINCT subtype, template_type, clause_depth, target_count FROM quotas JOIN gen_pairs USING (subtype)) SELECT 'subtype' AS group_by, subtype AS group_name, sum(target_count)::BIGINT AS n FROM j GROUP BY 2 UNION ALL SELECT 'template_type', template_type, sum(target_count)::BIGINT FROM j GROUP BY 2 UNION ALL SELECT 'clause_depth', clause_depth::VARCHAR, sum(target_count)::BIGINT FROM j GROUP BY 2")
def target_distribution(spark, d):
    shapes = generate.templates(spark)
    return summaries.weighted_counts(quotas.target_counts(_counts(spark, d), shapes, 240), shapes, ["subtype", "template_type", "clause_depth"])


@query(f"WITH {GEN_PAIRS} " + " UNION ALL ".join(f"SELECT dataset, '{f}' AS group_by, {e} AS group_name, count(*) AS n FROM gen_pairs GROUP BY ALL" for f, e in (("subtype", "subtype"), ("template_type", "template_type"), ("dependency_distance_bucket", BUCKET), ("clause_depth", "clause_depth::VARCHAR"))))
def dataset_distribution(spark, d):
    rows = gen_pairs(spark, d).withColumn("dependency_distance_bucket", distance_bucket("dependency_distance"))
    return summaries.count_fields(rows, FIELDS, ["dataset"])


@query("SELECT i::BIGINT AS i, CASE i % 3 WHEN 0 THEN 'pp_attractor' WHEN 1 THEN 'relative_clause' ELSE 'simple_agreement' END AS template_type FROM range(240) t(i)")
def balanced_schedule(spark, d):
    return generate.schedule(spark, 240, balanced=True).join(F.broadcast(generate.templates(spark)), "ordinal").select("i", "template_type")


@query(f"WITH {GEN_PAIRS} SELECT uid, sentence_good, sentence_bad, dependency_distance, attractor_count, clause_depth, template_type, subtype FROM gen_pairs")
def realized_pairs(spark, d):
    rows = gen_pairs(spark, d)
    return rows.where(generate.pair_is_valid("sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth")).select("uid", "sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth", "template_type", "subtype")


_CAND = f"""{MODEL_SCORES}, counts AS (SELECT subtype, count(*) AS n FROM gen_pairs WHERE dataset = 'benchmark' GROUP BY 1), {_SCALED},
cand AS (SELECT *, row_number() OVER (PARTITION BY subtype, grammatical, ungrammatical ORDER BY pair_id) AS f1 FROM model_scores WHERE model_id = 'hf_gpt2'),
pool AS (SELECT pair_id, subtype, grammatical, preference_margin, model_failed, target_count::BIGINT AS target_count, row_number() OVER (PARTITION BY subtype ORDER BY pair_id) - 1 AS pool_index FROM cand JOIN quotas USING (subtype) WHERE f1 = 1),
sc AS (SELECT *, greatest(0.0::DOUBLE, 0.5 - abs(preference_margin)) / 0.5 AS boundary_score, greatest(0.0::DOUBLE, 1.0 - pool_index / greatest(target_count, 1)) * 0.25 AS diversity_bonus, greatest(0.0::DOUBLE, pool_index / greatest(target_count, 1) - 1.0) * 0.5 AS over_quota_penalty FROM pool),
hs AS (SELECT *, 1.0 * model_failed::INT + 0.5 * boundary_score - 0.1::DOUBLE * preference_margin + diversity_bonus - over_quota_penalty AS hardness_score FROM sc)"""


def _candidates(spark, d):
    """Scored candidates, and the quotas that they were scored by."""
    wanted = materialize(quotas.target_counts(_counts(spark, d), generate.templates(spark), 240))
    rows = score_pairs(as_pairs(gen_pairs(spark, d)), {"hf_gpt2": scoring.hash_scorer("hf_gpt2")}, NEAR)
    return quotas.candidate_hardness(rows, wanted, ["pair_id"], near=0.5), wanted


@query(f"WITH {_CAND} SELECT pair_id, subtype, pool_index, boundary_score, round(diversity_bonus, 12) AS diversity_bonus, round(over_quota_penalty, 12) AS over_quota_penalty, round(hardness_score, 12) AS hardness_score FROM hs")
def candidate_hardness(spark, d):
    exact = lambda c: F.round(c, 12).alias(c)
    return _candidates(spark, d)[0].select("pair_id", "subtype", "pool_index", "boundary_score", exact("diversity_bonus"), exact("over_quota_penalty"), exact("hardness_score"))


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY hardness_score DESC, preference_margin, grammatical) AS rank FROM hs) SELECT subtype, rank, pair_id FROM r WHERE rank <= target_count")
def selected_candidates(spark, d):
    return quotas.select_candidates(*_candidates(spark, d)).select("subtype", "rank", "pair_id")


@query(f"WITH {GEN_PAIRS}, r AS (SELECT dataset, uid, row_number() OVER (PARTITION BY dataset ORDER BY key) AS rn FROM gen_pairs) SELECT dataset, uid FROM r WHERE rn <= 50")
def head_limit(spark, d):
    return scoring.head_per_group(gen_pairs(spark, d), ["dataset"], ["key"], 50).select("dataset", "uid")


@query(f"""WITH {MODEL_SCORES}, m AS (SELECT pair_id, model_id, model_failed, preference_margin / 12.7::DOUBLE AS margin, dependency_distance + 2 AS tokens, dependency_distance, attractor_count, clause_depth, template_type FROM model_scores),
p AS (SELECT *, CASE WHEN model_failed THEN 1.0::DOUBLE ELSE 0 END AS model_failure_reward, CASE WHEN abs(margin) < 0.2 THEN 0.6::DOUBLE * (1.0 - abs(margin) / 0.2::DOUBLE) * CASE WHEN margin >= 0 THEN 1.0 ELSE 0.5 END ELSE 0 END AS low_confidence_reward,
  CASE WHEN model_failed OR abs(margin) < 0.2 THEN 0.02::DOUBLE * (0.5 * dependency_distance + attractor_count + clause_depth) ELSE 0 END AS complexity_reward, 0.002::DOUBLE * tokens AS length_penalty, CASE WHEN template_type = 'simple_agreement' THEN 0.1::DOUBLE ELSE 0 END AS simple_stop_penalty FROM m)
SELECT pair_id, model_id, round(model_failure_reward + low_confidence_reward + complexity_reward - length_penalty - simple_stop_penalty, 9) AS reward, model_failure_reward, round(low_confidence_reward, 9) AS low_confidence_reward, round(complexity_reward, 9) AS complexity_reward, simple_stop_penalty FROM p""")
def reward_breakdown(spark, d):
    rows = model_scores(spark, d)
    b = rewards.breakdown(F.col("preference_margin") / 12.7, F.col("model_failed"), F.col("dependency_distance") + 2, F.col("dependency_distance"), F.col("attractor_count"), F.col("clause_depth"), {"stopped_simple": F.col("template_type") == "simple_agreement"})
    r9 = lambda c: F.round(f"b.{c}", 9).alias(c)
    return rows.select("pair_id", "model_id", b.alias("b")).select("pair_id", "model_id", r9("reward"), "b.model_failure_reward", r9("low_confidence_reward"), r9("complexity_reward"), "b.simple_stop_penalty")


def _alias_rows(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("doc_id"), F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).when(k % 3 == 1, " ").alias("uid"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("pairID"),
        F.when(k % 5 == 0, "Subject_Agreement").when(k % 5 == 1, "").alias("phenomenon"), F.when(k % 5 == 1, "anaphor").alias("linguistics_term"), F.lit("morphology").alias("field"), F.col("source").alias("subtype"),
    )


_ALIAS_SQL = """a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id WHEN doc_id % 3 = 1 THEN ' ' END AS uid, CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id END AS pairID,
  CASE WHEN doc_id % 5 = 0 THEN 'Subject_Agreement' WHEN doc_id % 5 = 1 THEN '' END AS phenomenon, CASE WHEN doc_id % 5 = 1 THEN 'anaphor' END AS linguistics_term, 'morphology' AS field, source AS subtype FROM documents)"""


@query(f"WITH {_ALIAS_SQL} SELECT doc_id, CASE WHEN trim(uid) <> '' AND pairID IS NOT NULL THEN uid || '-' || pairID ELSE coalesce(CASE WHEN trim(uid) <> '' THEN uid END, pairID) END AS pair_id, coalesce(nullif(trim(phenomenon), ''), linguistics_term, field) AS phenomenon, CASE WHEN trim(subtype) <> '' THEN subtype ELSE field END AS subtype FROM a")
def pair_id_normalization(spark, d):
    rows = _alias_rows(spark, d)
    return rows.select("doc_id", normalized_pair_id(rows.columns).alias("pair_id"), normalized_phenomenon(rows.columns).alias("phenomenon"), first_present("subtype", "field").alias("subtype"))


@query(f"WITH {_ALIAS_SQL} SELECT doc_id FROM a WHERE contains(lower(coalesce(phenomenon, '')), 'agreement') OR contains(lower(coalesce(subtype, '')), 'agreement') OR contains(lower(coalesce(linguistics_term, '')), 'agreement') OR contains(lower(field), 'agreement')")
def phenomenon_filter(spark, d):
    rows = _alias_rows(spark, d)
    return rows.where(matches_phenomenon(rows.columns, "Agreement")).select("doc_id")


def _with_policy(spark, d):
    return model_scores(spark, d).withColumn("policy", F.when(F.col("dataset") == "rl", "trained").otherwise("random"))


_POLICY = "CASE WHEN dataset = 'rl' THEN 'trained' ELSE 'random' END AS policy"


@query(f"WITH {MODEL_SCORES} SELECT {_POLICY}, {METRICS}, {MEAN} FROM model_scores GROUP BY 1 UNION ALL SELECT 'greedy', 0, 0, 0, 0")
def policy_summary(spark, d):
    return summaries.policy_summary(_with_policy(spark, d), ("trained", "random", "greedy"))


@query(f"WITH {MODEL_SCORES} " + " UNION ALL ".join(f"SELECT {_POLICY}, '{f}' AS group_by, {f} AS group_name, {METRICS}, {MEAN} FROM model_scores GROUP BY 1, 3" for f in ("phenomenon", "subtype", "template_type")))
def policy_grouped(spark, d):
    return summaries.summarize_fields(_with_policy(spark, d), ["phenomenon", "subtype", "template_type"], ["policy"], nulls="skip", rates=False)


@query(f"WITH {MODEL_SCORES} SELECT model_id, {_POLICY}, {RATES}, {MEAN} FROM model_scores GROUP BY 1, 2")
def policy_model_comparison(spark, d):
    return summaries.summarize(_with_policy(spark, d), ["model_id", "policy"])


_ODD_SPACES = "[\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS alphabetic, len(list_filter(regexp_split_to_array(regexp_replace(text, '{_ODD_SPACES}', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS tokens FROM documents WHERE text IS NOT NULL""")
def document_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(alphabetic_tokens("text")).cast("long").alias("alphabetic"), F.size(whitespace_tokens("text")).cast("long").alias("tokens"))


@query()
def trajectory_summary(spark, d):
    """Rollouts of the learned and the random policy, summarised."""
    q, _ = search.train(100)
    runs = search.rollouts(spark, "trained", 200, 10_042, q=q).unionByName(search.rollouts(spark, "random", 200, 20_042))
    return summaries.trajectory_summary(runs)


@query()
def trajectory_distribution(spark, d):
    runs = search.rollouts(spark, "random", 200, 42, go_on=0.75)
    return summaries.count_fields(runs.fillna("missing", ["template_type", "subtype"]), ["template_type", "subtype"], ["policy"])


@query()
def q_summary(spark, d):
    q, _ = search.train(100)
    return search.q_summary(search.q_rows(spark, q))
