"""Comparisons on small fixtures: groups that one side lacks, orders, maps."""

import pytest
from pyspark.sql import functions as F

from pairlight.functions import rewards
from pairlight.operators import compare, search, summaries

SCHEMA = "model_id string, dataset string, group_by string, group_name string, total long, correct long, accuracy double, failure_rate double, mean_preference_margin double"


def grouped(spark, rows):
    return spark.createDataFrame([(m, d, "subtype", g, t, c, c / t, 1 - c / t, x) for m, d, g, t, c, x in rows], SCHEMA)


ROWS = [("m", "benchmark", "a", 10, 8, 0.5), ("m", "rl", "a", 10, 4, 0.1), ("m", "benchmark", "b", 10, 5, 0.2), ("n", "benchmark", "a", 4, 4, 0.9), ("n", "rl", "a", 4, 1, -0.5), ("n", "rl", "c", 4, 2, 0.0)]


def test_coverage_and_distribution_with_groups_of_one_side(spark):
    g = grouped(spark, ROWS)
    (c,) = compare.coverage(g).collect()
    assert (c.benchmark_count, c.rl_count, c.shared_count, c.benchmark_only, c.rl_only, c.coverage_mismatch) == (2, 2, 1, "b", "c", True)
    got = {(r.model_id, r.subtype): (r.benchmark_count, r.rl_count, r.share_delta) for r in compare.distribution_mismatch(g, 0.9).collect()}
    assert got == {("m", "b"): (10, 0, -0.5), ("n", "c"): (0, 4, 0.5)}
    assert compare.coverage(g.limit(0)).isEmpty() and compare.distribution_mismatch(g.limit(0)).isEmpty()


def test_order_by_mean_delta(spark):
    shared = compare.shared_subtypes(grouped(spark, [*ROWS, ("m", "rl", "b", 10, 5, 0.2)]))
    rows = [(r.subtype, r.position) for r in compare.ordered_by_mean_delta(shared, "accuracy").collect()]
    assert sorted(rows) == [("a", 1), ("b", 2)]
    assert {r.subtype: r.position for r in compare.ordered_by_mean_delta(shared, "failure_rate").collect()} == {"a": 1, "b": 2}


def test_a_model_without_a_dataset_is_an_error(spark):
    overall = spark.createDataFrame([("m", "benchmark", 0.5, 0.5, 0.1, 10), ("m", "rl", 0.25, 0.75, 0.1, 10)], "model_id string, dataset string, accuracy double, failure_rate double, mean_preference_margin double, total long")
    (r,) = compare.overall_deltas(overall).collect()
    assert r.accuracy_delta == -0.25 and r.rl_harder
    with pytest.raises(Exception, match="lacks a dataset"):
        compare.overall_deltas(overall.where("dataset = 'rl'")).collect()


def test_difficulty_and_consistently_hard(spark):
    g = grouped(spark, [("m", "rl", "a", 10, 8, 0.5), ("n", "rl", "a", 10, 2, 0.1), ("m", "rl", "b", 10, 9, 0.5), ("n", "rl", "b", 10, 8, 0.4), ("m", "rl", "c", 10, 1, 0.0)])
    (d,) = compare.difficulty_change(g, 0.25).collect()
    assert d.subtype == "a" and d.by_model["n"].accuracy == 0.2 and set(d.by_model) == {"m", "n"}
    assert {r.subtype for r in compare.consistently_hard(g, 2).collect()} == {"a"} and compare.consistently_hard(g.limit(0), 2).isEmpty()


def test_scalar_reward(spark):
    df = spark.createDataFrame([(True, 0.0, 0), (False, 0.0, 0), (False, 0.1, 0), (True, 0.0, 5)], "failed boolean, m double, tokens int")
    zero = F.lit(0)
    got = [r[0] for r in df.select(rewards.scalar_reward(F.col("m"), F.col("failed"), F.col("tokens"), zero, zero, zero, penalty=0.5)).collect()]
    assert got == pytest.approx([0.5, -0.5, 0.3 - 0.5, 1.0 + 0.6 - 0.01 - 0.5])
    weighed = df.select(rewards.scalar_reward(F.col("m"), F.col("failed"), F.col("tokens"), zero, zero, zero, weights=rewards.RewardWeights())).first()[0]
    assert weighed == pytest.approx(1.6)


def test_histograms_and_q_report(spark):
    runs = spark.createDataFrame([("p", "t", "s"), ("p", None, None), ("q", "t", "u")], "policy string, template_type string, subtype string")
    got = {r.policy: r for r in summaries.trajectory_histograms(runs).collect()}
    assert got["p"].template_type_distribution == {"missing": 1, "t": 1} and got["q"].subtype_distribution == {"u": 1}
    q = search.q_rows(spark, {search.INITIAL_STATE: {"stop": 2.0, "select_pp_template": 1.0}, "other": {"stop": 3.0}})
    one = search.q_report(q, 2).first()
    assert one.favors_immediate_stop_initially and one.best_relative_clause_action is None and one.state_count == 2
    assert [x.q_value for x in one.top_q_entries] == [3.0, 2.0] and [x.action for x in one.initial_state_actions] == ["stop", "select_pp_template"]
    assert not search.q_report(q.limit(0)).first().favors_immediate_stop_initially
