"""The queries over the smallest driver tables: columns as stated, and what can be told without SQL."""

import os

import pytest
from pyspark.sql import functions as F

from pairlight.llm import mixing, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
FOUND = {
    "p1_found": ["run_id", "subtype"], "p2_found": ["kind", "run_id", "group_key", "item_key"], "p3_found": ["field_name", "term", "mark"], "p4_found": ["model_id", "subtype", "pct"],
    "p6_found": ["doc_id", "item_id"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id", "found_lang"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)


def test_mix_and_report_agree(spark):
    mixed = queries.p7_mix(spark, DATA).groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("t"), F.max("repeat").alias("r"))
    report = {(r.mix_id, r.source): r for r in queries.p7_report(spark, DATA).collect()}
    for r in mixed.collect():
        assert report[r.mix_id, r.source].actual_tokens == r.t and r.r < report[r.mix_id, r.source].max_repeats


@pytest.mark.parametrize("name", ["p7_found", "p7_report"])
def test_mix_is_written_with_contents(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(mixing, "materialize", lambda df, f=mixing.materialize: written.append(f(df)) or written[-1])
    assert not queries.QUERIES[name](spark, DATA).isEmpty()
    mixes = [df for df in written if {"mix_id", "slot", "tokens"} <= set(df.columns)]
    assert len(mixes) == 1 and mixes[0].where("tokens is null or size(tokens) <> n_tokens").isEmpty() and not mixes[0].isEmpty()


def test_cleaned_documents_hold_no_leak(spark):
    from pairlight.llm import leaks

    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    found = leaks.find_leaks(docs, items)
    clean = leaks.without_leaks(docs, found)
    assert clean.count() == docs.count() and not found.isEmpty()
    assert leaks.find_leaks(clean, items).isEmpty()


def test_segments_cover_the_main_languages(spark):
    segments = queries.p8_segments(spark, DATA)
    assert {"en", "de", "fr"} <= {r.lang for r in segments.select("lang").distinct().collect()}
    assert segments.where("start >= end or confidence > 1.0001 or sentences < 1").isEmpty()
