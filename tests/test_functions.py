import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairlight.functions import names, rewards, text, typed


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("0.5", 0.5), (" +1,5 ", 1.5), ("7.8e-01", 0.78), ("12.5 %", 0.125), ("50%", 0.5), ("3/8", 0.375), ("3/0", None), ("o.81", None), ("0.8.1", None), ("NaN", None), ("", None), (None, None), ("1e999", None), ("--", None)])
def test_double(spark, raw, want):
    assert one(spark, raw, "string", lambda x: typed.to_double(typed.to_text(x))) == want


@pytest.mark.parametrize(("raw", "want"), [("016", 16), ("+16", 16), ("16.0", 16), ("1.6e+01", 16), ("1.5", None), ("6x4", None), ("99999999999", None), (" ", None), ("-3", -3)])
def test_int(spark, raw, want):
    assert one(spark, raw, "string", lambda x: typed.to_int(typed.to_text(x))) == want


@pytest.mark.parametrize(("raw", "want"), [("2025-06-19", (2025, 6, 19)), (" 2025/06/19", (2025, 6, 19)), ("20250619", (2025, 6, 19)), ("19.06.2025", (2025, 6, 19)), ("9 Jun 2025", (2025, 6, 9)), ("2025-06-19T10:05:00Z", (2025, 6, 19)), ("2025-02-30", None), ("2025-13-07", None), ("0000-00-00", None), ("soon", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, raw, "string", lambda x: typed.to_date_any(typed.to_text(x))) == (dt.date(*want) if want else None)


@pytest.mark.parametrize(("raw", "want"), [("Y", True), ("true", True), ("1", True), ("f", False), ("NO", False), ("maybe", None), ("", None), (None, None)])
def test_bool(spark, raw, want):
    assert one(spark, raw, "string", lambda x: typed.to_bool(typed.to_text(x))) == want


def test_names(spark):
    for raw, want in ((" PP-plural  Attractor\t", "pp_plural_attractor"), ("", None), (None, None), (" \t", None)):
        assert one(spark, raw, "string", names.folded_name) == want
    assert one(spark, "The  Cat \n sat.", "string", names.folded_sentence) == "thecatsat."
    for v, want in ((1.0, True), (float("nan"), False), (float("inf"), False), (None, False)):
        assert one(spark, v, "double", names.is_finite) is want


def test_tokens_and_length_score(spark):
    assert one(spark, "The dogs run...", "string", text.sentence_tokens) == ["The", "dogs", "run"]
    assert one(spark, "It's 2 o'Clock", "string", text.alphabetic_tokens) == ["it", "s", "o", "clock"]
    assert one(spark, "ab  c def", "string", text.length_score) == 2.0
    assert one(spark, " ", "string", text.length_score) == 0.0 == one(spark, None, "string", text.length_score)


def test_buckets(spark):
    assert [one(spark, v, "string", text.distance_bucket) for v in ("1", "4", "5", "", None)] == ["short_1", "medium_2_4", "long_5_plus", None, None]
    with pytest.raises(Exception, match="missing or not an integer"):
        one(spark, "", "string", text.distance_bucket_strict)


@pytest.mark.parametrize(("raw", "want"), [('{"score": 0.25}', 0.25), ("Score: 0.8 of 1", 0.8), ("7", 1.0), ("-2", 0.0), ("none", None), ("", None)])
def test_judgement(spark, raw, want):
    assert one(spark, raw, "string", text.parse_judgement) == want


def test_model_key(spark):
    rows = spark.createDataFrame([("a", "x/y"), (" ", "x/y:z"), (None, None)], "i string, n string")
    assert [r[0] for r in rows.select(text.model_key("i", "n")).collect()] == ["a", "x_y_z", "model"]


@pytest.mark.parametrize(("margin", "failed", "flags"), [(0.1, False, set()), (-0.05, True, {"stopped_simple"}), (3.0, False, set()), (-3.0, True, {"repeated_edit"}), (0.0, False, {"invalid_action"}), (0.2, False, {"grammar_invalid"})])
def test_reward_column_equals_function(spark, margin, failed, flags):
    want = rewards.reward_parts(margin, failed, 6, 4, 1, 0, flags)
    b = rewards.breakdown(F.lit(margin), F.lit(failed), F.lit(6), F.lit(4), F.lit(1), F.lit(0), {f: F.lit(True) for f in flags})
    got = spark.range(1).select(b.alias("b")).first().b.asDict()
    assert got == pytest.approx(want)


def test_invalid_action_keeps_the_low_confidence_reward():
    assert rewards.reward_parts(0.0, False, 3, 0, 0, 0, {"invalid_action"})["reward"] == pytest.approx(-0.4 - 0.006)


def test_decay():
    assert [rewards.linear_decay(0.4, 0.05, s, 10) for s in (0, 10, 99)] == pytest.approx([0.4, 0.05, 0.05])
