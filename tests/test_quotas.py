"""Groups that are short, missing or cut by the cap, on small fixtures."""

import random

from pairlight.operators import quotas


def pairs(spark):
    have = {"a": (5, 5), "b": (5, 2), "c": (3, 0), "d": (0, 4)}
    rows = [(f"{g}-{d}-{i}", d, g) for g, n in have.items() for d, k in zip(("benchmark", "rl"), n, strict=True) for i in range(k)]
    return spark.createDataFrame(rows, "pair_id string, dataset string, subtype string")


def test_plan_of_short_and_missing_groups(spark):
    got = {tuple(r) for r in quotas.matched_plan(pairs(spark), "subtype", 3).collect()}
    assert got == {("a", 5, 5, 3, "matched"), ("b", 5, 2, 2, "limited_by_available_examples"), ("c", 3, 0, 0, "insufficient_examples"), ("d", 0, 4, 0, "insufficient_examples")}


def test_cap_drops_groups(spark):
    plan = quotas.matched_plan(pairs(spark), "subtype", 3, 1)
    assert {r.group_name: (r.sampled, r.status) for r in plan.collect()} == {"a": (1, "limited_by_available_examples"), "b": (0, "dropped_by_total_cap"), "c": (0, "insufficient_examples"), "d": (0, "insufficient_examples")}
    assert tuple(quotas.matched_summary(plan).first()) == (1, "", "a", "b", "c,d")


def test_comparison_with_groups_of_one_side(spark):
    targets = spark.createDataFrame([("a", 3), ("b", 1)], "subtype string, target_count long")
    achieved = spark.createDataFrame([("a", 1), ("c", 3)], "subtype string, achieved_count long")
    got = {r.subtype: tuple(r)[1:] for r in quotas.compare_distribution(targets, achieved).collect()}
    assert got == {"a": (3, 1, 2, 0, 0.75, 0.25), "b": (1, 0, 1, 0, 0.25, 0.0), "c": (0, 3, 0, 3, 0.0, 0.75)}


def test_cap_by_taking_units_off_the_largest(spark):
    rng = random.Random(6)
    for _ in range(12):
        counts = {f"g{k}": rng.randrange(0, 9) for k in range(rng.randrange(1, 7))}
        cap = rng.randrange(0, 25)
        want = dict(counts)
        while sum(want.values()) > cap:
            want[max(want, key=lambda k: (want[k], k))] -= 1
        df = spark.createDataFrame(list(counts.items()), "k string, n long")
        assert {r.k: r.n for r in quotas.cap_counts(df, "k", "n", cap).collect()} == {k: n for k, n in want.items() if n}, (counts, cap)


def test_matched_groups_and_fallback(spark):
    plan, field = quotas.matched_plan_or_fallback(pairs(spark), 3, None, ["subtype"])
    one = quotas.matched_groups(plan, 3).first()
    assert field == "subtype" and (one.benchmark_total, one.rl_total, one.distribution_matched, one.matched_group_count) == (5, 5, True, 2)
    assert one.examples_per_matched_group == {"a": 3, "b": 2} and one.dropped_groups_due_to_insufficient_examples == ["c", "d"] and one.dropped_groups_due_to_total_cap == []
    assert [tuple(x) for x in one.limited_groups_below_requested_count] == [("b", 2, 3)]
    apart = spark.createDataFrame([("1", "benchmark", "x", "t"), ("2", "rl", "y", "t")], "pair_id string, dataset string, subtype string, template_type string")
    plan, field = quotas.matched_plan_or_fallback(apart, 1)
    assert field == "template_type" and [tuple(r) for r in plan.collect()] == [("t", 1, 1, 1, "matched")]
    empty = quotas.matched_groups(quotas.matched_plan(pairs(spark).limit(0), "subtype", 3), 3).first()
    assert (empty.benchmark_total, empty.matched_group_count, empty.examples_per_matched_group) == (0, 0, {})
