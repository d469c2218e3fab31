from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairlight.functions.lexicon import TEMPLATES
from pairlight.operators import diagnostics, generate, scoring


def test_template_order_and_counts():
    assert [t[0] for t in TEMPLATES[:4]] == ["simple_agreement", "pp_attractor", "relative_clause", "simple_agreement"]
    assert Counter(t[0] for t in TEMPLATES) == {"simple_agreement": 2, "pp_attractor": 8, "relative_clause": 5}


def test_balanced_counts(spark):
    shapes = generate.templates(spark)
    got = generate.schedule(spark, 240, True).join(shapes, "ordinal").groupBy("template_type", "subtype").count().collect()
    per = {r.subtype: r["count"] for r in got}
    assert per["simple_singular"] == 40 and per["pp_plural_attractor_with"] == 10 and per["object_relative_clause_who"] == 16
    assert [r.ordinal for r in generate.schedule(spark, 4).orderBy("i").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        generate.schedule(spark, -1)
    with pytest.raises(ValueError):
        generate.templates(spark, subtypes=["none"])


def test_generated_pairs_are_valid(spark):
    rows = generate.generate_pairs(spark, 300, True)
    assert rows.count() == 300 and diagnostics.validate(rows).where("not valid").isEmpty()
    again = generate.generate_pairs(spark, 300, True).repartition(3)
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in again.collect()}


def test_seeded_replay_matches_the_published_vocabulary(spark):
    """Fixed values of the published 240-pair set: 88 nouns, 66 verbs, 144 pairs that the length scorer gets right."""
    rows = spark.createDataFrame(list(generate.replay_pairs(240, 123)))
    counts = diagnostics.lexical_counts(rows.withColumn("d", F.lit(1)), ["d"], "uid")
    unique = {r.kind: r["count"] for r in counts.groupBy("kind").count().collect()}
    assert (unique["nouns"], unique["verbs"], unique["prepositions"]) == (88, 66, 4)
    pairs = rows.withColumnsRenamed({"sentence_good": "grammatical", "sentence_bad": "ungrammatical"})
    scored = scoring.add_scores(pairs, scoring.build_scorer(scoring.ScorerOptions("dry_run")))
    assert scored.where("correct").count() == 144
    assert diagnostics.validate(rows).where("not valid").isEmpty()
