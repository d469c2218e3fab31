import random

import pytest

from pairlight.operators import search, summaries


def test_transitions():
    s = search.State()
    assert search.valid_actions(s) == list(search.ACTIONS[:3]) and s.key == "unset|0|0|0|0|0|0"
    pp = search.moved(s, "select_pp_template")
    assert pp.subtype == "pp_plural_attractor_near" and search.valid_actions(pp) == ["stop", "change_preposition", "increase_depth_if_valid"]
    turned = search.moved(pp, "change_preposition")
    assert turned.preposition == "behind" and "change_preposition" not in search.valid_actions(turned)
    rel = search.moved(turned, "increase_depth_if_valid")
    assert rel.key == "relative_clause|5|0|1|0|1|0" and search.valid_actions(rel) == ["stop", "change_relative_pronoun"]
    assert search.moved(search.moved(rel, "change_relative_pronoun"), "stop").step_count == 5


def test_environment_rules():
    env = search.Environment(1)
    reward, done, info = env.step("stop")
    assert not info["valid"] and not done and reward == pytest.approx(-0.4)
    env.step("select_simple_template")
    reward, done, info = env.step("stop")
    assert done and info["good"].startswith("The ") and env.step("stop")[0] == 0.0


def test_episode_ends_with_stop():
    for seed in range(30):
        got = search.run_episode(search.Environment(seed, 3), search.random_policy(random.Random(seed), 0.75))
        assert got["actions"].endswith("stop") and got["steps"] <= 3 and got["sentence_good"]


def test_rollouts_do_not_depend_on_partitions(spark):
    a = {tuple(r) for r in search.rollouts(spark, "random", 40, 7).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    b = {tuple(r) for r in search.rollouts(spark, "random", 40, 7).repartition(3).collect()}
    assert a == b and len(a) == 40 and old


def test_training_and_summaries(spark):
    q, log = search.train(60)
    assert len(log) == 60 and log[0]["epsilon"] == 0.4 and log[-1]["epsilon"] == pytest.approx(0.05)
    again, _ = search.train(60)
    assert q == again
    rows = search.q_rows(spark, q)
    assert search.q_summary(rows, 3).count() == 3
    s = summaries.trajectory_summary(search.rollouts(spark, "trained", 20, 1, q=q)).first()
    assert s.episodes == 20 and 0 <= s.failure_rate <= 1
