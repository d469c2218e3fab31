"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.names import folded_name, folded_sentence, is_finite, trimmed_lower
from pairlight.llm import langid, leaks, mixing, percentiles, sampling, terms, topn
from pairlight.session import table
from pairlight.storage import materialize

LISTS = ["top_nouns", "top_verbs", "top_patterns"]
PCTS = (10, 50, 90)


def _valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "sanity_check_pair_validation").where("valid")
    both = F.concat_ws("\u0001", folded_sentence("sentence_good"), folded_sentence("sentence_bad"))
    return pairs.where("sentence_good is not null and sentence_bad is not null").select("run_id", folded_name("subtype").alias("subtype"), both.alias("pair_key"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last requested target of each run and subtype."""
    asked = table(spark, sf_dir, "distribution_comparison").select("run_id", folded_name("subtype").alias("subtype"), F.struct("requested_at", "target_count", "min_count").alias("t"))
    return asked.dropna(subset=["run_id", "subtype"]).groupBy("run_id", "subtype").agg(F.max("t").alias("t")).select("run_id", "subtype", "t.target_count", "t.min_count")


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.match_targets(_valid_pairs(spark, sf_dir), _targets(spark, sf_dir), ["run_id"], "subtype", "pair_key")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run and subtype pairs whose target cannot be met, from the sampler's report."""
    _, report = _sampled(spark, sf_dir)
    return report.where("missing_count > 0").select("run_id", "subtype")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = _sampled(spark, sf_dir)
    return report.select("run_id", "subtype", "target_count", "min_count", "quota", "available", "achieved_count", "missing_count")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, _ = _sampled(spark, sf_dir)
    return sample


#: Pairs of a run in the sample of a given size.
RUN_SAMPLE = 200


def p1_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of ``RUN_SAMPLE`` pairs a run in the proportions of its targets, floors kept within that size: its report."""
    targets = _targets(spark, sf_dir).withColumn("size", F.lit(RUN_SAMPLE))
    _, report = sampling.match_targets(_valid_pairs(spark, sf_dir), targets, ["run_id"], "subtype", "pair_key", total="size", keep_total=True)
    return report.select("run_id", "subtype", "quota", "available", "achieved_count", "missing_count")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sanity_check_tiny_extreme_failures").where(is_finite("preference_margin"))
    rows = rows.dropna(subset=["run_id", "subtype", "pair_id"])
    return rows.groupBy("run_id", "subtype", "pair_id").agg(F.min("preference_margin").alias("score"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark_vs_rl_grouped_summary").where((trimmed_lower("dataset") == "rl") & (trimmed_lower("group_by") == "subtype"))
    rows = rows.dropna(subset=["run_id", "model_id", "group_name"])
    last = rows.groupBy("run_id", "model_id", "group_name").agg(F.max(F.struct("ingested_at", "accuracy")).alias("last"))
    return last.select("run_id", "model_id", "group_name", F.col("last.accuracy").alias("score")).where(is_finite("score"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest items of every group: both kinds go through one bisection."""
    worst = _failures(spark, sf_dir).select(F.lit("failure").alias("kind"), "run_id", F.col("subtype").alias("group_key"), F.col("pair_id").alias("item_key"), "score", F.lit(5).alias("n"))
    low = _summaries(spark, sf_dir).select(F.lit("summary").alias("kind"), "run_id", F.col("model_id").alias("group_key"), F.col("group_name").alias("item_key"), "score", F.lit(3).alias("n"))
    code = F.concat(topn.double_code("score"), topn.text_code("item_key"))
    return topn.lowest_n(worst.unionByName(low), ["kind", "run_id", "group_key"], code, F.col("n")).select("kind", "run_id", "group_key", "item_key")


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "sanity_check_lexical_by_subtype")
    total = cells.agg(F.count_distinct("record_id")).first()[0]
    return terms.count_terms(terms.term_occurrences(cells, "record_id", LISTS), total)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir)


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finite margin per result (the last ingested), with folded names; results without a name are in no group."""
    rows = table(spark, sf_dir, "sanity_check_manual_examples").where(is_finite("preference_margin")).where("result_id is not null")
    rows = rows.select("result_id", F.struct("ingested_at", "preference_margin", folded_name("model_id").alias("model_id"), folded_name("subtype").alias("subtype")).alias("r"))
    return rows.groupBy("result_id").agg(F.max("r").alias("r")).select("r.model_id", "r.subtype", "r.preference_margin").dropna()


def _percentiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _margins(spark, sf_dir)
    keys = ["model_id", "subtype"]
    return rows, percentiles.percentiles(percentiles.sketch_groups(rows, keys, "preference_margin"), keys, PCTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles below 0 of groups with at least 50 rows. Where the sketch's error leaves it open, an exact count of
    the group's negative margins decides; the rows are read again only for such groups."""
    rows, asked = _percentiles(spark, sf_dir)
    asked = materialize(asked.where("n >= 50"))
    keys = ["model_id", "subtype"]
    sure = asked.where("sure and below").select(*keys, "pct")
    if asked.where("not sure").isEmpty():
        return sure
    doubtful = asked.where("not sure").select(*keys, "n", "pct")
    exact = rows.join(doubtful.select(*keys).distinct(), keys).groupBy(*keys).agg(F.count_if(F.col("preference_margin") < 0).alias("negative"))
    return sure.unionByName(doubtful.join(exact, keys).where(F.col("negative") * 100 >= F.col("n") * F.col("pct")).select(*keys, "pct"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked = _percentiles(spark, sf_dir)
    return asked.select("model_id", "subtype", "n", "pct", "value")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with leaked passages cut out."""
    clean = leaks.clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return clean.select("doc_id", F.length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", trimmed_lower("source"))
    return mixing.mix(docs, trimmed_lower("source"), targets)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that all their repeats cannot bring to their share, from the report of the written mixes."""
    _, report = _mixed(spark, sf_dir)
    return report.where("capped").select("mix_id", "source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = _mixed(spark, sf_dir)
    return report.select("mix_id", "source", "target_share", "actual_share", "actual_tokens", "wanted_slots", "mixed_slots", "most_repeats", "max_repeats", "capped")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = _mixed(spark, sf_dir)
    return mixed


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.find_languages(docs, langid.train(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).where("label_state <> 'right'").select("doc_id", "found_lang").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.find_segments(docs, langid.train(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_scaled, p2_found, p3_found, p3_terms, p4_found, p4_percentiles, p6_found, p6_clean, p7_found, p7_report, p7_mix, p8_found, p8_segments)}


def _name(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '[\\s-]+', '_', 'g'), '')"


_P1 = f"""WITH pairs AS (
  SELECT run_id, {_name("subtype")} AS subtype, count(DISTINCT regexp_replace(lower(sentence_good), '\\s+', '', 'g') || chr(1) || regexp_replace(lower(sentence_bad), '\\s+', '', 'g')) AS available
  FROM sanity_check_pair_validation WHERE valid AND sentence_good IS NOT NULL AND sentence_bad IS NOT NULL GROUP BY ALL
), targets AS (
  SELECT run_id, {_name("subtype")} AS subtype, target_count, min_count, row_number() OVER (PARTITION BY run_id, {_name("subtype")} ORDER BY requested_at DESC, target_count DESC, min_count DESC) AS rn
  FROM distribution_comparison
), report AS (
  SELECT t.run_id, t.subtype, CAST(target_count AS BIGINT) AS target_count, CAST(min_count AS BIGINT) AS min_count, CAST(greatest(target_count, min_count) AS BIGINT) AS quota, coalesce(available, 0) AS available
  FROM targets t LEFT JOIN pairs p USING (run_id, subtype) WHERE rn = 1
)"""

_P4 = f"""WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC, preference_margin DESC) AS rn
  FROM sanity_check_manual_examples WHERE isfinite(preference_margin) AND result_id IS NOT NULL
), margins AS (
  SELECT {_name("model_id")} AS model_id, {_name("subtype")} AS subtype, preference_margin AS m FROM latest WHERE rn = 1
)"""

_P1_ITEMS = f"""items AS (
  SELECT DISTINCT run_id, {_name("subtype")} AS subtype, regexp_replace(lower(sentence_good), '\\s+', '', 'g') || chr(1) || regexp_replace(lower(sentence_bad), '\\s+', '', 'g') AS pair_key
  FROM sanity_check_pair_validation WHERE valid AND sentence_good IS NOT NULL AND sentence_bad IS NOT NULL
), ranked AS (
  SELECT i.*, least(quota, available) AS achieved, row_number() OVER (PARTITION BY run_id, subtype ORDER BY md5('42|' || run_id || '|' || subtype || '|' || pair_key), pair_key) AS rn
  FROM items i JOIN report USING (run_id, subtype)
)"""


def _list_cells(field: str) -> str:
    return f"SELECT record_id, '{field}' AS field_name, {field} AS cell FROM sanity_check_lexical_by_subtype WHERE record_id IS NOT NULL"


_P3 = f"""WITH cells AS ({" UNION ALL ".join(_list_cells(f) for f in LISTS)}
), plain AS (
  SELECT record_id, field_name, CASE WHEN cell LIKE '"%' AND json_valid(cell) THEN json_extract_string(cell, '$') WHEN cell LIKE '[[''%' THEN replace(cell, '''', '"') ELSE cell END AS cell FROM cells
), lists AS (
  SELECT record_id, field_name, CAST(cell AS JSON[]) AS entries FROM plain WHERE json_valid(cell) AND json_type(cell) = 'ARRAY'
), entries AS (
  SELECT record_id, field_name, unnest(entries) AS e, generate_subscripts(entries, 1) AS place FROM lists
), terms AS (
  SELECT DISTINCT record_id, field_name, place, regexp_replace(lower(CASE json_type(e) WHEN 'ARRAY' THEN e ->> 0 WHEN 'OBJECT' THEN e ->> 'term' ELSE e ->> '$' END), '^\\s+|\\s+$', '', 'g') AS term FROM entries
), counted AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM terms WHERE term <> '' GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN records * 100 >= 40 * (SELECT count(DISTINCT record_id) FROM sanity_check_lexical_by_subtype) THEN 'common' WHEN records < 3 THEN 'rare' END AS mark FROM counted
)"""

_RUN = "PARTITION BY run_id"
_FALLING = f"{_RUN} ORDER BY ratio DESC, subtype"
_P1_SCALED = f"""t AS (
  SELECT run_id, subtype, available, greatest(coalesce(target_count, 0), 0)::HUGEINT AS target, greatest(coalesce(min_count, 0), 0)::HUGEINT AS least_count FROM report
), r AS (
  SELECT *, CASE WHEN target > 0 THEN least_count / target ELSE 'inf'::DOUBLE END AS ratio FROM t
), w AS (
  SELECT *, {RUN_SAMPLE} - coalesce(sum(least_count) OVER ({_FALLING} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(target) OVER ({_FALLING} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM r
), f AS (
  SELECT *, bool_and(target = 0 OR least_count * behind > target * rest) OVER ({_FALLING} ROWS UNBOUNDED PRECEDING) AS fixed FROM w
), s AS (
  SELECT *, sum(CASE WHEN fixed THEN 0 ELSE target END) OVER ({_RUN}) AS free, greatest({RUN_SAMPLE} - sum(CASE WHEN fixed THEN least_count ELSE 0 END) OVER ({_RUN}), 0) AS size FROM f
), b AS (
  SELECT *, CASE WHEN fixed OR free = 0 THEN 0 ELSE (target * size) // free END AS base, CASE WHEN fixed OR free = 0 THEN 0 ELSE (target * size) % free END AS remainder FROM s
), q AS (
  SELECT *, size - sum(base) OVER ({_RUN}) AS units, row_number() OVER ({_RUN} ORDER BY remainder DESC, subtype) AS rk FROM b
), quotas AS (
  SELECT run_id, subtype, available, CASE WHEN fixed THEN least_count ELSE base + CASE WHEN rk <= units AND remainder > 0 THEN 1 ELSE 0 END END::BIGINT AS quota FROM q
)"""

ORACLE = {
    "p1_scaled": f"{_P1}, {_P1_SCALED} SELECT *, least(quota, available) AS achieved_count, quota - least(quota, available) AS missing_count FROM quotas",
    "p1_sample": f"{_P1}, {_P1_ITEMS} SELECT run_id, subtype, pair_key FROM ranked WHERE rn <= achieved",
    "p3_found": f"{_P3} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": f"{_P3} SELECT * FROM marked",
    "p1_found": f"{_P1} SELECT run_id, subtype FROM report WHERE available < quota",
    "p1_report": f"{_P1} SELECT *, least(quota, available) AS achieved_count, quota - least(quota, available) AS missing_count FROM report",
    "p2_found": """WITH failures AS (
  SELECT run_id, subtype, pair_id, min(preference_margin) AS m FROM sanity_check_tiny_extreme_failures
  WHERE isfinite(preference_margin) AND run_id IS NOT NULL AND subtype IS NOT NULL AND pair_id IS NOT NULL GROUP BY ALL
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, subtype ORDER BY m, pair_id) AS rn FROM failures
), latest AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, model_id, group_name ORDER BY ingested_at DESC, accuracy DESC NULLS LAST) AS rn
  FROM benchmark_vs_rl_grouped_summary WHERE lower(trim(dataset)) = 'rl' AND lower(trim(group_by)) = 'subtype' AND group_name IS NOT NULL AND model_id IS NOT NULL AND run_id IS NOT NULL
), low AS (
  SELECT run_id, model_id, group_name, row_number() OVER (PARTITION BY run_id, model_id ORDER BY accuracy, group_name) AS rn
  FROM latest WHERE rn = 1 AND isfinite(accuracy)
)
SELECT 'failure' AS kind, run_id, subtype AS group_key, pair_id AS item_key FROM worst WHERE rn <= 5
UNION ALL SELECT 'summary', run_id, model_id, group_name FROM low WHERE rn <= 3""",
    "p4_found": f"""{_P4}, counted AS (
  SELECT model_id, subtype, count(*) AS n, count(*) FILTER (m < 0) AS negative FROM margins WHERE model_id IS NOT NULL AND subtype IS NOT NULL GROUP BY ALL HAVING count(*) >= 50
)
SELECT model_id, subtype, pct FROM counted, (SELECT unnest([10, 50, 90]) AS pct) WHERE negative * 100 >= n * pct""",
}
