import random

import pytest
from pyspark.sql import functions as F

from pairlight.operators.ranking import first_of_each, running_index


@pytest.fixture
def rows(spark):
    random.seed(4)
    data = [(random.choice(["hot", "hot", "hot", "b", None]), k, random.random()) for k in range(900)]
    return data, spark.createDataFrame(data, "g string, k int, v double").repartition(5)


def test_running_index(rows):
    data, df = rows
    got = {r.k: r["index"] for r in running_index(df, ["g"], ["v", "k"]).collect()}
    for g in {d[0] for d in data}:
        assert [got[k] for _, _, k in sorted((v, k, k) for x, k, v in data if x == g)] == list(range(sum(d[0] == g for d in data)))
    assert running_index(df.limit(0), ["g"], ["v", "k"]).isEmpty()


def test_first_of_each(rows):
    data, df = rows
    want = {k for g in {d[0] for d in data} for _, k in sorted((v, k) for x, k, v in data if x == g)[:7]}
    assert {r.k for r in first_of_each(df, ["g"], ["v", "k"], 7).collect()} == want
    limited = df.withColumn("n", F.when(F.col("g") == "hot", 7).otherwise(2))
    assert first_of_each(limited, ["g"], ["v", "k"], "n", 7).count() == 11


def test_cut_before_the_shuffle(rows):
    plan = first_of_each(rows[1].withColumn("n", F.lit(3)), ["g"], ["v"], "n", 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
