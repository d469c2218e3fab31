import random
from collections import Counter

from pairlight.llm import sampling


def test_allocation_largest_remainder_floor_and_cap(spark):
    t = spark.createDataFrame([("r", "a", 5, 0, 10), ("r", "b", 3, 0, 10), ("r", "c", 2, 4, 10), ("r", "d", 0, 2, 10)], "run string, cat string, target_count int, min_count int, size int")
    a = spark.createDataFrame([("r", "a", 3), ("r", "b", 100), ("r", "c", 100)], "run string, cat string, available long")
    got = {r.cat: r for r in sampling.allocate(t, a, ["run"], "cat", "size").collect()}
    assert {k: r.quota for k, r in got.items()} == {"a": 5, "b": 3, "c": 4, "d": 2}
    assert {k: r.achieved_count for k, r in got.items()} == {"a": 3, "b": 3, "c": 4, "d": 0}
    assert {k: r.missing_count for k, r in got.items()} == {"a": 2, "b": 0, "c": 0, "d": 2}
    assert got["a"].target_share == 0.5


def test_scaled_quotas_sum_to_the_size(spark):
    t = spark.createDataFrame([("r", c, n, 0, 17) for c, n in (("a", 1), ("b", 1), ("c", 1), ("d", 7))], "run string, cat string, target_count int, min_count int, size int")
    a = spark.createDataFrame([], "run string, cat string, available long")
    got = {r.cat: r.quota for r in sampling.allocate(t, a, ["run"], "cat", "size").collect()}
    assert sum(got.values()) == 17 and got["d"] == 12 and Counter(got[c] for c in "abc") == Counter([2, 2, 1])


def _by_hand(targets, size):
    """Quotas of one pool with its size kept: floors are fixed one after the other, the rest is shared anew each time."""
    fixed = {}
    while True:
        rest = {c: t for c, (t, _) in targets.items() if c not in fixed}
        left, whole = size - sum(fixed.values()), sum(rest.values())
        short = [c for c in rest if whole == 0 or targets[c][1] * whole > rest[c] * left]
        if not short:
            break
        worst = max(short, key=lambda c: (targets[c][1] / rest[c] if rest[c] else float("inf"), c))
        fixed[worst] = targets[worst][1]
    if whole:
        base = {c: rest[c] * left // whole for c in rest}
        for c in sorted(rest, key=lambda c: (base[c] * whole - rest[c] * left, c))[: left - sum(base.values())]:
            base[c] += 1
        fixed |= base
    return fixed


def test_floors_keep_the_size(spark):
    random.seed(8)
    pools = {"one": {"a": (5, 0), "b": (3, 0), "c": (2, 4), "d": (0, 2)}, "floors": {"a": (1, 9), "b": (4, 9)}, "zero": {"a": (0, 0), "b": (0, 3)}}
    sizes = {"one": 10, "floors": 12, "zero": 10}
    for k in range(60):
        pools[f"p{k}"] = {c: (random.choice([0, 1, 5, random.randrange(40)]), random.choice([0, 0, 2, random.randrange(12)])) for c in "abcdef"[: random.randrange(1, 7)]}
        sizes[f"p{k}"] = random.randrange(80)
    rows = [(p, c, t, f, sizes[p]) for p, cs in pools.items() for c, (t, f) in cs.items()]
    t = spark.createDataFrame(rows, "run string, cat string, target_count int, min_count int, size int")
    got = {}
    for r in sampling.quotas(t, ["run"], "cat", "size", keep_total=True).collect():
        got.setdefault(r.run, {})[r.cat] = r.quota
    for p, cs in pools.items():
        assert got[p] == _by_hand(cs, sizes[p]), (p, cs, sizes[p])
        if any(t for t, _ in cs.values()) and sum(f for _, f in cs.values()) <= sizes[p]:
            assert sum(got[p].values()) == sizes[p] and all(got[p][c] >= f for c, (_, f) in cs.items())
    assert got["one"] == {"a": 3, "b": 1, "c": 4, "d": 2}


def test_sample_is_exact_repeatable_and_spread(spark):
    rows = [("r", "hot", f"i{k}") for k in range(5000)] * 2 + [("r", "small", f"j{k}") for k in range(3)] + [("r", None, "x"), (None, "hot", "y"), ("r", "hot", None)]
    items = spark.createDataFrame(rows, "run string, cat string, item string")
    targets = spark.createDataFrame([("r", "hot", 1000, 1), ("r", "small", 10, 1), ("r", "none", 2, 0)], "run string, cat string, target_count int, min_count int")
    sample, report = sampling.match_targets(items, targets, ["run"], "cat", "item", seed=1)
    got = [tuple(r) for r in sample.collect()]
    assert len(got) == len(set(got)) == 1003
    again, _ = sampling.match_targets(items.repartition(7), targets, ["run"], "cat", "item", seed=1)
    assert {tuple(r) for r in again.collect()} == set(got)
    numbers = sorted(int(i[1:]) for _, c, i in got if c == "hot")
    assert 2100 < sum(numbers) / len(numbers) < 2900
    assert {r.cat: r.missing_count for r in report.collect()} == {"hot": 0, "small": 7, "none": 2}


def test_empty_inputs(spark):
    items = spark.createDataFrame([], "run string, cat string, item string")
    targets = spark.createDataFrame([("r", "a", 2, None), ("r", "b", None, 3)], "run string, cat string, target_count int, min_count int")
    sample, report = sampling.match_targets(items, targets, ["run"], "cat", "item")
    assert sample.isEmpty() and {r.cat: r.missing_count for r in report.collect()} == {"a": 2, "b": 3}
    sample, report = sampling.match_targets(items, targets.limit(0), ["run"], "cat", "item")
    assert sample.isEmpty() and report.isEmpty()
