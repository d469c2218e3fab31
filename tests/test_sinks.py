import csv
import json

from pyspark.sql import functions as F

from pairlight.sources import sinks
from pairlight.storage import materialize


def test_rows_become_one_file_or_stay_parts(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f'a "q", {i}\nline', None if i % 2 else 0.5) for i in range(40)], "b int, a string, c double").repartition(3)
    p = sinks.write_rows(df, tmp_path / "x.csv")
    rows = list(csv.DictReader(open(p, encoding="utf-8", newline="")))
    assert list(rows[0]) == ["a", "b", "c"] and {r["a"] for r in rows} == {f'a "q", {i}\nline' for i in range(40)} and {r["c"] for r in rows} == {"", "0.5"}
    got = [json.loads(x) for x in open(sinks.write_rows(df, tmp_path / "x.jsonl", "json"), encoding="utf-8")]
    assert len(got) == 40 and list(got[0]) == ["b", "a", "c"] and any(r["c"] is None for r in got)
    monkeypatch.setattr(sinks, "ONE_FILE_BYTES", 10)
    parts = sinks.write_rows(df, tmp_path / "y.csv", columns=["b"])
    assert parts.endswith("y.csv.parts") and sum(1 for f in (tmp_path / "y.csv.parts").glob("part-*") for _ in open(f)) == 40
    monkeypatch.undo()
    assert open(sinks.write_rows(df.limit(0), tmp_path / "z.csv"), encoding="utf-8").read() == "a,b,c\n"


def test_materialized_tables(spark):
    df = spark.createDataFrame([(1, "x", [1, 2])], "a int, b string, c array<int>")
    assert materialize(df).collect() == df.collect()
    odd = df.select(F.lit(None).alias("n"), "a", F.col("b").alias("A"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert [tuple(r) for r in materialize(odd).collect()] == [(None, 1, "x")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
