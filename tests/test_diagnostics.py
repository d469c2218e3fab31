from pairlight.operators import diagnostics

PAIR = {"uid": "1", "phenomenon": "agreement", "sentence_good": "The dog near the cars runs.", "sentence_bad": "The dog near the cars run.", "dependency_distance": "4", "attractor_count": "1", "clause_depth": "0", "template_type": "pp_attractor", "subtype": "pp_plural_attractor_near"}


def errors(spark, **changes):
    row = {**PAIR, **changes}
    return diagnostics.validate(spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))).first().errors


def test_messages(spark):
    assert errors(spark) == ""
    assert errors(spark, phenomenon=" ").startswith("Missing or empty required field: phenomenon")
    assert "same token length" in errors(spark, sentence_bad="The dog run.")
    assert "found 2" in errors(spark, sentence_bad="The cat near the cars run.")
    assert "final main verb" in errors(spark, sentence_bad="The cat near the cars runs.")
    assert "not a known agreement verb pair: runs / ran" in errors(spark, sentence_bad="The dog near the cars ran.")
    assert "must be an integer: clause_depth" in errors(spark, clause_depth="x")
    assert "non-negative: attractor_count" in errors(spark, attractor_count="-1")
    assert "Unknown template_type: t" in errors(spark, template_type="t")
    assert "dependency_distance=3 is inconsistent" in errors(spark, dependency_distance="3") and "computed distance 4" in errors(spark, dependency_distance="3")
    assert "does not match preposition near" in errors(spark, subtype="pp_plural_attractor_with")


def test_disagreement_with_absent_models(spark):
    rows = [("rl", "1", "hf_tiny_gpt2", False), ("rl", "1", "hf_gpt2", True), ("rl", "2", "hf_gpt2", False), ("rl", "3", "hf_tiny_gpt2", True), ("rl", "3", "other", False)]
    df = spark.createDataFrame([(d, p, m, c, "s", "t", 1.0) for d, p, m, c in rows], "dataset string, pair_id string, model_id string, correct boolean, subtype string, template_type string, preference_margin double")
    got = {r.pair_id: (r.category, r.distilgpt2_correct) for r in diagnostics.disagreement(df).collect()}
    assert got == {"1": ("tiny_fails_stronger_succeed", False), "3": ("mixed_disagreement", False)}


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), (None, None), (None, None)], "x string, y string")
    got = {r.kind: (r.duplicated, r.most) for r in diagnostics.duplicate_summary(df, {"x": ["x"], "both": ["x", "y"]}).collect()}
    assert got == {"x": (2, 3), "both": (2, 2)}


def test_top_terms_ties_by_first_place(spark):
    rows = [(1, "g", "The robot runs.", "s"), (2, "g", "The dog runs.", "s"), (3, "g", "The dog near the robot runs.", "s")]
    df = spark.createDataFrame(rows, "uid int, dataset string, sentence_good string, subtype string")
    row = diagnostics.lexical_summary(df, ["dataset"], "uid").first()
    assert row.top_nouns == '[["robot", 2], ["dog", 2]]' and row.total == 3 and row.top_pattern_share == 1 / 3
