import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import percentiles as percentiles_module
from pairlight.llm.percentiles import RankSketch, percentiles, sketch_groups


@pytest.mark.parametrize("protect", ["low", "high"])
@pytest.mark.parametrize("parts", [1, 7])
def test_relative_rank_error(protect, parts):
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 2, 300_000)
    whole = RankSketch(protect)
    for i, p in enumerate(np.array_split(x, parts)):
        s = RankSketch(protect, seed=i + 5)
        s.update(p)
        whole.merge(s)
    assert whole.n == len(x) and sum(map(len, whole.levels)) < 20_000
    ordered = np.sort(x)
    for q in (0.0005, 0.01, 0.1, 0.5, 0.9, 0.99, 0.9995):
        rank = np.searchsorted(ordered, whole.quantile(q), side="right")
        want = math.ceil(q * len(x))
        tail = want if protect == "low" else len(x) - want + 1
        assert abs(rank - want) <= 0.02 * tail + 1, (q, rank, want)


def test_small_is_exact_and_ties():
    s = RankSketch()
    s.update(np.array([3.0, -1.0, 3.0, 2.0]))
    assert [s.quantile(q) for q in (0.1, 0.5, 0.75, 1.0)] == [-1.0, 2.0, 3.0, 3.0]
    assert s.rank_below(3.0) == 2 and s.exact()
    assert math.isnan(RankSketch().quantile(0.5)) and RankSketch.from_bytes(s.to_bytes()).quantile(0.5) == 2.0


def test_groups_with_nulls_and_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(0.3, 1, 20_000)] + [("s", float(k)) for k in range(-5, 6)] + [(None, 1.0), ("hot", None), ("hot", float("nan")), ("s", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r.g, r.pct): r for r in percentiles(sketch_groups(df, ["g"], "v"), ["g"], (10, 50, 90)).collect()}
    hot = sorted(v for g, v in rows if g == "hot" and v is not None and v == v)
    for pct in (10, 50, 90):
        rank = np.searchsorted(hot, got["hot", pct].value, side="right") / len(hot)
        assert abs(rank - pct / 100) < 0.011
    assert got["hot", 10].n == 20_000 and got["hot", 10].below and not got["hot", 90].below
    assert [got["s", p].value for p in (10, 50, 90)] == [-4.0, 0.0, 4.0] and got["s", 10].sure and got[None, 50].value == 1.0


def test_error_over_hundreds_of_tasks(spark):
    # every task compacts; were their tosses alike, the errors of all tasks would add up
    df = spark.range(0, 600_000, 1, 300).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("v"))
    got = {(r.g, r.pct): r for r in percentiles(sketch_groups(df, ["g"], "v"), ["g"], (1, 10, 50, 90, 99)).collect()}
    for g in range(3):
        ordered = np.sort([r.v for r in df.where(F.col("g") == g).select("v").collect()])
        for pct in (1, 10, 50, 90, 99):
            rank, want = np.searchsorted(ordered, got[g, pct].value, side="right"), math.ceil(len(ordered) * pct / 100)
            tail = want if pct <= 50 else len(ordered) - want + 1
            assert got[g, pct].n == len(ordered) and abs(rank - want) <= 0.02 * tail + 1, (g, pct, rank, want)


def test_seeds_differ():
    seeds = [percentiles_module._seed(task, (key,), tail) for task in range(20) for key in ("a", "b", None) for tail in ("low", "high")]
    assert len(set(seeds)) == len(seeds)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(sketch_groups(df, ["g"], "v"), ["g"], (50,)).isEmpty()


def test_merge_needs_the_same_tail():
    with pytest.raises(ValueError):
        RankSketch("low").merge(RankSketch("high"))
