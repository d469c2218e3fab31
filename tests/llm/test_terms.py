import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlight.llm import terms


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ('[["a", 2], [" B", 1]]', ["a", " B"]),
        ('[["a", "2"]]', ["a"]),
        ("[['a', 2], [\"it's\", 1]]", ["a", "it's"]),
        ('[{"term": "a", "n": 1}, {"n": 2}]', ["a"]),
        ('"[[\\"a\\", 8], [\\"b\\", 4]]"', ["a", "b"]),
        ('["a", null, "b"]', ["a", "b"]),
        ("", []), ("  ", []), (None, []), ("null", []), ("[]", []),
        ('[["a", 2], ["b', None), ('[["a", 2]', None), ("plain words", None), ('"[[\\"a\\", 8]', None), ("[" * 3000, None), ("42", None),
    ],
)
def test_list_entries(cell, want):
    assert terms.list_entries(cell) == want


def test_counts_against_brute_force(spark):
    random.seed(5)
    words = ["hot"] * 30 + [f"w{k}" for k in range(40)]
    rows = [(r, "f", random.choice(words), p) for r in range(400) for p in range(5)]
    rows += rows[:700]  # repeated records
    occ = spark.createDataFrame(rows, "record_id long, field_name string, term string, at int")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.count_terms(occ, 400).collect()}
    n, recs = Counter(), defaultdict(set)
    for r, _, t, p in set(rows):
        n[t] += 1
        recs[t].add(r)
    mark = lambda k: "common" if k * 100 >= 40 * 400 else "rare" if k < 3 else None
    assert got == {t: (n[t], len(recs[t]), mark(len(recs[t]))) for t in n}


def test_places_of_a_record_share_a_range(spark):
    # few terms with many places each, cut into many ranges that adaptive execution may not join again
    rows = [(r, "f", t, p) for t in ("hot", "warm") for r in (1, 2) for p in range(3000)] + [(3, "f", f"w{k}", k) for k in range(500)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        occ = spark.createDataFrame(rows, "record_id long, field_name string, term string, at int")
        got = {r.term: (r.occurrences, r.records) for r in terms.count_terms(occ, 3).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {"hot": (6000, 2), "warm": (6000, 2)} | {f"w{k}": (1, 1) for k in range(500)}


def test_plain_cells_are_read_as_by_python(spark):
    cells = [
        '[["a", 2], ["B b", 1]]', '[["a", "2"],["b", -3]]', '[["a"]]', '[["a"], ["b", 0]]', "[]", "[ ]", '[["a", 01]]', '[["a", 2]', '[["a", 2], ]', '[["a", 2],]', '[["a\\n", 1]]', '[["a\u0001", 1]]',
        '[\u0001, ["a", 1]]', "\u0001", '[["a", 2]]x', '[["", 1]]', "[['a', 2]]", '[{"term": "a"}]', '"[[\\"a\\", 8]]"', '[["a", 123456789012345678901]]', '[["a", 1.5]]', None, "", " ", '[["ü日", 7]]', '[["a", 1] ["b", 2]]', '[["a" , 1]]', '["a", 1]',
        "[" + ", ".join(f'["t{k}", {k}]' for k in range(20000)) + "]", "[" + ", ".join(f'["t{k}", {k}]' for k in range(20000)),
    ]
    got = spark.createDataFrame(list(enumerate(cells)), "i int, cell string").select("i", terms.terms_of("cell").alias("t")).collect()
    for r in got:
        assert (list(r.t) if r.t is not None else None) == terms.list_entries(cells[r.i]), cells[r.i]


def test_repeated_and_restated_records_and_clashing_columns(spark):
    rows = [(1, '[["a", 1], ["a", 2]]', "x")] * 5 + [(1, '[["a", 1]]', "y"), (2, '[["a", 1]]', "z")]
    cells = spark.createDataFrame(rows, "record_id long, top string, term string").withColumn("cell", F.lit(1)).withColumn("at", F.lit(7))
    (got,) = terms.count_terms(terms.term_occurrences(cells, "record_id", ["top"]), 2).collect()
    assert (got.occurrences, got.records, got.mark) == (3, 2, "common")


def test_runs_carry_over_batches():
    import pandas as pd

    rows = pd.DataFrame({"field_name": ["f"] * 6, "term": list("aaabbb"), "record_id": [1, 1, 2, 2, 2, 3], "at": [0, 0, 1, 0, 1, 0]})
    for size in (1, 2, 4, 6):
        out = pd.concat(terms._runs(iter([rows[i : i + size] for i in range(0, 6, size)]))).groupby("term")[["occurrences", "records"]].sum()
        assert out.loc["a"].tolist() == [2, 2] and out.loc["b"].tolist() == [3, 2]


def test_cells_with_nulls_and_empty_table(spark):
    schema = "record_id long, top string, term string, at int"
    cells = spark.createDataFrame([(1, '[["  Über ", 1], ["", 2]]', "x", 1), (None, '[["a", 1]]', None, None), (2, None, None, None)], schema)
    got = terms.term_occurrences(cells, "record_id", ["top"]).collect()
    assert [tuple(r) for r in got] == [("top", "über", 1, 0)]
    empty = terms.term_occurrences(cells.limit(0), "record_id", ["top"])
    assert terms.count_terms(empty, 0).isEmpty() and F is not None
