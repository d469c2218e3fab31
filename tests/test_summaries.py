import math

import pytest
from pyspark.sql import functions as F

from pairlight.operators import compare, quotas, scoring, summaries

COLUMNS = "model_id string, dataset string, subtype string, preference_margin double, correct boolean, failure boolean, near_failure boolean"


def results(spark):
    rows = [("m", d, s, m, m > 0, m <= 0, abs(m) <= 0.01) for d, s, m in (("rl", "a", 1.0), ("rl", "a", 0.0), ("rl", None, -1.0), ("benchmark", "b", 0.005), ("benchmark", "", 2.0), ("rl", "b", -0.5))]
    return spark.createDataFrame(rows, COLUMNS)


def test_flags_on_ties_nan_and_null(spark):
    pairs = spark.createDataFrame([(1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (float("-inf"), float("-inf")), (None, 1.0), (float("nan"), 0.0)], "grammatical double, ungrammatical double")
    got = [(r.correct, r.failure, r.near_failure, r.model_failed) for r in scoring.add_scores(pairs, lambda c: c).collect()]
    assert got == [(True, False, False, False), (False, True, True, False), (False, True, False, True), (False, True, False, False), (False, True, False, False), (False, True, False, False)]


def test_null_policies(spark):
    r = results(spark)
    names = lambda nulls: {x.group_name for x in summaries.summarize_fields(r, ["subtype"], nulls=nulls).collect()}
    assert names("drop") == {"a", "b"} and names("skip") == {"a", "b", ""} and names("literal") == {"a", "b", "", "None"}


def test_summary_numbers_and_empty(spark):
    row = summaries.summarize(results(spark)).first()
    assert (row.total, row.correct, row.accuracy, row.failure_rate, row.near_failure_rate) == (6, 3, 0.5, 0.5, 2 / 6)
    empty = summaries.summarize(results(spark).limit(0)).first()
    assert (empty.total, empty.accuracy, empty.mean_preference_margin) == (0, 0.0, 0.0)
    assert summaries.summarize_fields(results(spark).limit(0), ["subtype"]).isEmpty()


def test_policies_are_always_listed(spark):
    r = results(spark).withColumn("policy", F.lit("trained"))
    got = {x.policy: x.total for x in summaries.policy_summary(r).collect()}
    assert got == {"trained": 6, "random": 0}


def test_incremental_equals_batch(spark, tmp_path):
    from pairlight.streaming import incremental

    r = results(spark)
    for i, part in enumerate(r.randomSplit([0.5, 0.5], 1)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 2
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start(stream, ["model_id", "dataset"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(x) for x in incremental.read(spark, ["model_id", "dataset"], str(tmp_path / "out")).collect()}
    assert got == {tuple(x) for x in summaries.summarize(r, ["model_id", "dataset"]).collect()}


def test_overall_needs_both_datasets(spark):
    whole = summaries.summarize(results(spark), ["model_id", "dataset"])
    assert compare.overall_deltas(whole).count() == 1
    with pytest.raises(Exception, match="lacks a dataset"):
        compare.overall_deltas(whole.where("dataset = 'rl'")).collect()


def loop_cap(counts, cap):
    counts = {k: v for k, v in counts.items() if v > 0}
    while counts and sum(counts.values()) > cap:
        k = max(counts, key=lambda g: (counts[g], g))
        counts[k] -= 1
        counts = {g: v for g, v in counts.items() if v > 0}
    return counts


@pytest.mark.parametrize("cap", [0, 1, 5, 9, 14, 100])
def test_cap_equals_the_loop(spark, cap):
    counts = {"a": 5, "b": 5, "c": 1, "d": 0, "e": 3}
    got = quotas.cap_counts(spark.createDataFrame(list(counts.items()), "g string, n long"), "g", "n", cap)
    assert {r.g: r.n for r in got.collect()} == loop_cap(counts, cap)


@pytest.mark.parametrize("total", [1, 7, 100])
def test_scaling_sums_to_the_total(spark, total):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5)], "subtype string, n long")
    got = {r.subtype: r.target_count for r in quotas.scale_counts(df, "subtype", "n", total).collect()}
    assert sum(got.values()) == total
    raw = {"a": total / 7, "b": total / 7, "c": 5 * total / 7}
    left = total - sum(map(math.floor, raw.values()))
    order = sorted(raw, key=lambda k: (raw[k] - math.floor(raw[k]), k), reverse=True)
    assert got == {k: v for k in raw if (v := math.floor(raw[k]) + (k in order[:left]))}


def test_errors_of_a_model_are_kept_apart(spark):
    pairs = spark.createDataFrame([("rl", "1", "The dog runs.", "The dog run.", 1)], "dataset string, pair_id string, grammatical string, ungrammatical string, dependency_distance int")

    def broken():
        raise RuntimeError("no such model")

    rows, errors = scoring.score_each_model(pairs, {"ok": scoring.hash_scorer("ok"), "bad": scoring.batch_scorer(broken)})
    assert rows.count() == 1 and [e["model_id"] for e in errors] == ["bad"]
    with pytest.raises(ValueError):
        scoring.build_scorer(scoring.ScorerOptions("nobody"))


def test_python_scorers(spark):
    pairs = spark.createDataFrame([("a b c", "a b"), ("", "x")], "grammatical string, ungrammatical string")
    lm = scoring.causal_lm_scorer("fake", loader=lambda: (str.split, lambda ids: [-1.0] * (len(ids) - 1)))
    got = scoring.add_scores(pairs, lm).collect()
    assert got[0].grammatical_score == -1.0 and got[1].grammatical_score == float("-inf") and got[1].ungrammatical_score == 0.0
    judge = scoring.judge_scorer(lambda: lambda s: f'{{"score": {len(s) / 10}}}')
    got = scoring.add_scores(pairs, judge).collect()
    assert got[0].grammatical_score == 0.5 and got[1].grammatical_score == 0.0


def test_response_text():
    from types import SimpleNamespace as N

    assert scoring.response_text(N(output_text="a")) == "a"
    assert scoring.response_text(N(output=[N(content=[N(text="a"), N(text=None), N(text="b")]), N(content=None)])) == "a\nb"
    assert scoring.response_text(N()) == ""
