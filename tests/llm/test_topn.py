import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlight.llm import topn


def brute(rows, n):
    groups = defaultdict(set)
    for g, s, i in rows:
        if s is not None:
            groups[g].add((s, i))
    return {(g, s, i) for g, items in groups.items() for s, i in sorted(items)[:n]}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "g int, s double, i string")
    code = F.concat(topn.double_code("s"), topn.text_code("i"))
    return {tuple(r) for r in topn.lowest_n(df, ["g"], code, n, **kw).collect()}


def test_order_of_double_codes(spark):
    values = [float("-inf"), -1e300, -1.5, -1e-320, 0.0, 1e-320, 2.0**-1022, 1.5, 3.14, 1e300, float("inf"), float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(topn.double_code("v")).collect()
    assert [r[0] for r in got] == sorted({r[0] for r in got})
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "v double").select(topn.double_code("v")).collect()
    assert zeros[0][0] == zeros[1][0] and zeros[2][0] is None


def test_hot_group_ties_and_null_group(spark):
    random.seed(3)
    rows = [(random.choice([1, 1, 1, 2, None]), random.choice([-1.0, 0.0, random.random()]), f"id{k}") for k in range(6000)]
    rows += [(9, 1.0, "a"), (9, 0.5, "b"), (8, None, "x")]
    assert run(spark, rows, 300) == brute(rows, 300)


def test_one_group_all_ties_goes_through_the_identifiers(spark):
    rows = [(1, 2.5, f"item-with-a-long-common-prefix-{k:05d}") for k in range(2000)]
    assert run(spark, rows, 700) == brute(rows, 700)


def test_few_passes_for_long_common_identifiers(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(topn, "materialize", lambda df, f=topn.materialize: passes.append("_rows" in df.columns and "_code" in df.columns) or f(df))
    rows = [(1, 2.5, "x" * 300 + f"{k:05d}") for k in range(3000)] + [(2, float(k), "y") for k in range(2000)]
    assert run(spark, rows, 700) == brute(rows, 700)
    assert sum(passes) <= 3  # by four characters a pass there would be some 150


def test_repeated_rows_all_pass_or_none(spark):
    rows = [(1, 1.0, "a")] * 3 + [(1, 2.0, "b")] * 4 + [(1, 3.0, "c")] * 2
    df = spark.createDataFrame(rows, "g int, s double, i string")
    code = F.concat(topn.double_code("s"), topn.text_code("i"))
    for n, want in ((1, 3), (3, 3), (4, 7), (8, 9), (20, 9)):
        assert topn.lowest_n(df, ["g"], code, n).count() == want


def test_empty_and_n_zero(spark):
    assert run(spark, [], 5) == set()
    assert run(spark, [(1, 1.0, "a")], 0) == set()


def test_extra_columns_named_like_the_operators_own(spark):
    df = spark.createDataFrame([(1, 2.0, "a", "x"), (1, 1.0, "b", "y")], "g int, _code double, _n string, _row string")
    got = topn.lowest_n(df, ["g"], F.concat(topn.double_code("_code"), topn.text_code("_n")), 1)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, 1.0, "b", "y")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(allow_nan=False, width=32), st.text("ab", max_size=3)), max_size=60), st.integers(1, 7))
def test_against_sorting(spark, rows, n):
    rows = [(g, s + 0.0, i) for g, s, i in set(rows)]
    rows = list({(g, s, i): (g, s, i) for g, s, i in rows}.values())
    assert run(spark, rows, n) == brute(rows, n)


@pytest.mark.parametrize("small", [0, 10])
def test_cutoffs_without_direct_ranking(spark, small):
    rows = [(g, float(k % 7), f"k{k}") for g in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, s double, i string").withColumn("c", F.concat(topn.double_code("s"), topn.text_code("i"))).withColumn("n", F.lit(11))
    cuts = {r.g: r for r in topn.cutoffs(df, ["g"], "c", "n", small).collect()}
    for g, cut in cuts.items():
        kept = [r for r in df.where(F.col("g") == g).collect() if r.c[: cut.cut_len] <= cut.cut]
        assert len(kept) == 11 and {(r.s, r.i) for r in kept} == set(sorted((s, i) for x, s, i in rows if x == g)[:11])
    assert not math.isnan(len(cuts))
