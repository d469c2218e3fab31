"""Checks of pairs and results: validation, duplicates, vocabulary, disagreement between models, extreme examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.functions.lexicon import ALLOWED_METADATA, NOUNS, PREPOSITIONS, PRONOUNS, VERBS, VERBS_PLURAL, VERBS_SINGULAR
from pairlight.functions.text import alphabetic_tokens, missing, sentence_tokens
from pairlight.operators.generate import PAIR_FIELDS, dependency_distance
from pairlight.operators.ranking import first_of_each
from pairlight.operators.summaries import safe_ratio
from pairlight.storage import materialize

NUMBERS = ("dependency_distance", "attractor_count", "clause_depth")
# The models that the disagreement categories name.
TINY = "hf_tiny_gpt2"
STRONGER = ("hf_distilgpt2", "hf_gpt2")


def record_errors(columns: Sequence[str]) -> Column:
    """Array of messages for one generated record; empty when it is valid.

    Missing fields end the check. Then: equal token counts, one differing token, the last, a known verb pair (the first
    that applies), whole numbers that are not negative, metadata as the template type allows, and the stated distance.
    Fields that are no whole number are reported once and not compared further.
    """
    text = {c: (F.col(c).cast("string") if c in columns else F.lit(None).cast("string")) for c in PAIR_FIELDS}
    absent = F.array_compact(F.array(*[F.when(missing(text[c]), F.lit(f"Missing or empty required field: {c}")) for c in PAIR_FIELDS]))
    a, b = sentence_tokens(text["sentence_good"]), sentence_tokens(text["sentence_bad"])
    apart = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    last = lambda t: F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
    known = F.array(*[F.lit(f"{x} {y}") for s, p in zip(VERBS_SINGULAR, VERBS_PLURAL, strict=True) for x, y in ((s, p), (p, s))])
    contrast = (
        F.when(F.size(a) != F.size(b), F.lit("Good/bad sentences must have the same token length."))
        .when(apart != 1, F.concat(F.lit("Good/bad sentences must differ in exactly one token; found "), apart.cast("string"), F.lit(".")))
        .when(last(a) == last(b), F.lit("The differing token must be the final main verb."))
        .when(~F.array_contains(known, F.concat_ws(" ", last(a), last(b))), F.concat(F.lit("Differing final tokens are not a known agreement verb pair: "), last(a), F.lit(" / "), last(b)))
    )
    number = {c: text[c].try_cast("int") for c in NUMBERS}
    numeric = [F.when(number[c].isNull(), F.lit(f"Metadata field must be an integer: {c}")).when(number[c] < 0, F.lit(f"Metadata field must be non-negative: {c}")) for c in NUMBERS]
    kind = text["template_type"]
    unknown = F.when(~kind.isin(*ALLOWED_METADATA), F.concat(F.lit("Unknown template_type: "), kind))
    allowed = []
    for c in NUMBERS:
        message = F.lit(None).cast("string")
        for t, fields in ALLOWED_METADATA.items():
            tail = f" is inconsistent with template_type={t}; expected one of {{{', '.join(map(str, fields[c]))}}}."
            message = F.when((kind == t) & ~number[c].isin(*fields[c]), F.concat(F.lit(f"{c}="), text[c], F.lit(tail))).otherwise(message)
        allowed.append(message)
    computed = dependency_distance(text["sentence_good"])
    distance = F.when(computed.isNull(), F.lit("Sentence must have at least three tokens.")).when(
        number["dependency_distance"] != computed, F.concat(F.lit("dependency_distance="), number["dependency_distance"].cast("string"), F.lit(" does not match computed distance "), computed.cast("string"), F.lit("."))
    )
    found = F.array_compact(F.array(contrast, *numeric, unknown, *allowed, distance))
    return F.when(F.size(absent) > 0, absent).otherwise(found)


def heuristic_errors() -> Column:
    """Array of messages where the subtype's name does not fit the sentence's preposition, pronoun or attractors."""
    tokens = alphabetic_tokens(F.coalesce("sentence_good", F.lit("")))
    kind, subtype = F.coalesce("template_type", F.lit("")), F.coalesce("subtype", F.lit(""))
    attractors = F.coalesce(F.col("attractor_count").cast("string").try_cast("int"), F.lit(0))
    inside = lambda words: F.filter(tokens, lambda t: t.isin(*words))
    prep, pron = inside(PREPOSITIONS), inside(PRONOUNS)
    first = F.coalesce(F.get(prep, F.lit(0)), F.lit(""))
    on = lambda t, cond, text: F.when((kind == t) & cond, text if isinstance(text, Column) else F.lit(text))
    lacks = lambda w: F.endswith(subtype, F.lit(w)) & ~F.array_contains(pron, w)
    return F.array_compact(F.array(
        F.coalesce(on("pp_attractor", F.size(prep) == 0, "PP subtype has no recognized preposition."), on("pp_attractor", ~F.endswith(subtype, first), F.concat(F.lit("Subtype "), subtype, F.lit(" does not match preposition "), first, F.lit(".")))),
        on("pp_attractor", F.contains(subtype, F.lit("plural_attractor")) & (attractors != 1), "PP attractor subtype should have attractor_count=1."),
        F.coalesce(on("relative_clause", F.size(pron) == 0, "Relative-clause subtype has no that/who token."), on("relative_clause", lacks("that"), "Subtype ends with that but sentence does not use that."), on("relative_clause", lacks("who"), "Subtype ends with who but sentence does not use who.")),
        on("relative_clause", F.contains(subtype, F.lit("plural_embedded")) & (attractors != 1), "Plural-embedded relative subtype should have attractor_count=1."),
    ))


def validate(records: DataFrame) -> DataFrame:
    """``uid, subtype, template_type, valid, error_count, errors`` and both sentences of every record."""
    e = F.concat(record_errors(records.columns), heuristic_errors())
    rows = records.withColumn("_e", e)
    return rows.select("uid", "subtype", "template_type", (F.size("_e") == 0).alias("valid"), F.size("_e").cast("long").alias("error_count"), F.array_join("_e", " | ").alias("errors"), "sentence_good", "sentence_bad")


def duplicate_summary(records: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """``kind, duplicated, most``: per key how many values occur twice or more, and the most frequent's count.

    All keys are counted in one pass, by a 128-bit hash of the values that stands for them in the shuffle.
    """
    text = lambda cols: F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text(cols).alias("v")) for k, cols in keys.items()]))
    counts = records.select(each.alias("k")).groupBy("k.kind", "k.v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("duplicated"), F.max("n").alias("most"))


def duplicate_rows(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_lexical_features(rows: DataFrame, sentence: str = "sentence_good", subtype: str = "subtype") -> DataFrame:
    """Adds ``nouns``, ``verbs`` and ``prepositions`` of a sentence in order, and its lexical ``pattern`` (first three
    nouns, last two verbs, all prepositions). One projection builds on the other, so tokens are taken once."""
    inside = lambda words: F.filter("_tokens", lambda t: t.isin(*words))
    rows = rows.withColumn("_tokens", alphabetic_tokens(F.coalesce(sentence, F.lit(""))))
    rows = rows.select("*", inside(NOUNS).alias("nouns"), inside(VERBS).alias("verbs"), inside(PREPOSITIONS).alias("prepositions")).drop("_tokens")
    two = F.slice("verbs", F.greatest(F.size("verbs") - 1, F.lit(1)), 2)
    pattern = F.concat_ws("|", F.coalesce(subtype, F.lit("None")), F.array_join(F.slice("nouns", 1, 3), "+"), F.array_join(two, "+"), F.array_join("prepositions", "+"))
    return rows.withColumn("pattern", pattern)


def lexical_counts(records: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``keys, kind, term, n, first``: counts of nouns, verbs, prepositions and patterns with their first place by
    ``order`` and place in the sentence."""
    needed = [c for c in dict.fromkeys([*keys, order, "sentence_good", "subtype"])]
    f = with_lexical_features(records.select(*needed)).withColumn("patterns", F.array("pattern"))
    place = lambda kind: F.transform(F.col(kind), lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("term"), i.alias("i")))
    all_terms = F.concat(*[place(k) for k in ("nouns", "verbs", "prepositions", "patterns")])
    long = f.select(*keys, F.col(order).alias("_o"), F.explode(all_terms).alias("t"))
    return long.groupBy(*keys, "t.kind", "t.term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "t.i")).alias("first"))


def top_terms(counts: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent terms of each kind, ties by first occurrence, with ``rank``."""
    r = F.row_number().over(W.partitionBy(*keys, "kind").orderBy(F.desc("n"), F.asc("first"))).cast("long")
    return counts.withColumn("rank", r).where(F.col("rank") <= n)


def lexical_summary(records: DataFrame, keys: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """Unique counts, top lists as JSON text and the share of the top pattern, by ``keys`` (one at least)."""
    counts = materialize(lexical_counts(records, keys, order))  # read twice below
    unique = lambda k: F.count_if(F.col("kind") == k)
    u = counts.groupBy(*keys).agg(F.sum(F.when(F.col("kind") == "patterns", F.col("n"))).alias("total"), unique("nouns").alias("unique_nouns"), unique("verbs").alias("unique_verbs"), unique("prepositions").alias("unique_prepositions"), F.max(F.when(F.col("kind") == "patterns", F.col("n"))).alias("_top"))
    pair = F.concat(F.lit('["'), F.col("term"), F.lit('", '), F.col("n").cast("string"), F.lit("]"))
    listed = lambda k: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", pair.alias("p"))))), lambda x: x["p"]), ", "), F.lit("]"))
    tops = top_terms(counts, keys, n).groupBy(*keys).agg(listed("nouns").alias("top_nouns"), listed("verbs").alias("top_verbs"), listed("patterns").alias("top_patterns"))
    return u.join(tops, list(keys)).withColumn("top_pattern_share", safe_ratio(F.col("_top"), F.col("total"))).drop("_top")


def disagreement(results: DataFrame) -> DataFrame:
    """One row per (dataset, pair) that the tiny model scored, with the category of the set of failing models.

    Absent models count as not correct in their flag, but do not join the failing set.
    """
    correct = lambda m: F.coalesce(F.bool_or(F.when(F.col("model_id") == m, F.col("correct"))), F.lit(False))
    rows = results.groupBy("dataset", "pair_id").agg(
        F.min("subtype").alias("subtype"), F.min("template_type").alias("template_type"),
        F.sort_array(F.collect_set(F.when(~F.col("correct"), F.col("model_id")))).alias("failed"),
        F.bool_or(F.col("model_id") == TINY).alias("has_tiny"), correct(TINY).alias("tiny_correct"), correct(STRONGER[0]).alias("distilgpt2_correct"), correct(STRONGER[1]).alias("gpt2_correct"),
        F.max(F.when(F.col("model_id") == TINY, F.col("preference_margin"))).alias("tiny_margin"), F.max(F.when(F.col("model_id") == STRONGER[1], F.col("preference_margin"))).alias("gpt2_margin"),
    ).where("has_tiny")
    tiny = F.array_contains("failed", TINY)
    strong = F.size(F.array_intersect("failed", F.array(*[F.lit(m) for m in STRONGER])))
    category = (
        F.when(tiny & (F.size("failed") == 1), "tiny_fails_stronger_succeed")
        .when(tiny & (strong == len(STRONGER)), "all_models_fail")
        .when((F.size("failed") > 0) & ~tiny & (strong == 1), "only_one_stronger_model_fails")
        .when(F.size("failed") == 0, "all_models_succeed")
        .otherwise("mixed_disagreement")
    )
    return rows.select("dataset", "pair_id", "subtype", "template_type", category.alias("category"), F.array_join("failed", ",").alias("failed_models"), "tiny_correct", "distilgpt2_correct", "gpt2_correct", "tiny_margin", "gpt2_margin")


def stronger_hard_subtypes(results: DataFrame, rate: float = 0.2) -> DataFrame:
    """Rl subtypes on which both stronger models fail in at least ``rate`` of their rows."""
    rows = results.where(F.col("model_id").isin(*STRONGER) & (F.col("dataset") == "rl"))
    of = lambda m: safe_ratio(F.count_if((F.col("model_id") == m) & ~F.col("correct")), F.count_if(F.col("model_id") == m))
    out = rows.groupBy("subtype").agg(F.count_distinct("model_id").alias("models"), *[of(m).alias(f"{m}_failure_rate") for m in STRONGER])
    both = F.lit(True)
    for m in STRONGER:
        both = both & (F.col(f"{m}_failure_rate") >= rate)
    return out.where(both & (F.col("models") == len(STRONGER))).drop("models")


def extreme_failures(results: DataFrame, n: int = 100, model_id: str = TINY) -> DataFrame:
    """The ``n`` rl failures of a model with the lowest margins, in subtypes where it has a benchmark success."""
    rows = results.where(F.col("model_id") == model_id)
    good = rows.where("dataset = 'benchmark' and correct").select("subtype").distinct()
    bad = rows.where("dataset = 'rl' and not correct").join(good, "subtype", "left_semi")
    top = with_lexical_features(bad.orderBy("preference_margin", "subtype", "pair_id").limit(n), "grammatical")
    return top.select("pair_id", "subtype", "template_type", "preference_margin", "grammatical_score", "ungrammatical_score", F.col("pattern").alias("lexical_pattern"), F.col("grammatical").alias("sentence_good"), F.col("ungrammatical").alias("sentence_bad"))


INSPECTED = ["dataset", "model_id", "pair_id", "subtype", "template_type", "grammatical", "ungrammatical", "grammatical_score", "ungrammatical_score", "preference_margin", "correct"]


def hardest_examples(results: DataFrame, model_id: str, dataset: str, n: int) -> DataFrame:
    rows = results.where((F.col("model_id") == model_id) & (F.col("dataset") == dataset))
    return rows.orderBy("preference_margin", "correct", "pair_id").limit(n).select(*INSPECTED).withColumnRenamed("pair_id", "uid")


def shared_examples(results: DataFrame, n: int, model_id: str = STRONGER[1]) -> DataFrame:
    """Half of ``n`` (one at least) hardest rl rows, then the hardest benchmark rows of their subtypes up to ``n``."""
    half = max(n // 2, 1)
    # one pass: neither half can take more than n rows of a subtype, and Spark keeps no more before the shuffle
    rows = results.where((F.col("model_id") == model_id) & F.col("dataset").isin("benchmark", "rl")).select(*INSPECTED)
    order = ["preference_margin", F.when(F.col("dataset") == "rl", F.col("correct")), F.col("pair_id")]
    first = materialize(first_of_each(rows, ["dataset", "subtype"], order, n).drop("rank"))
    hard = hardest_examples(first, model_id, "rl", half)
    rest = first.where("dataset = 'benchmark'").alias("b").join(hard.select("subtype").distinct().alias("h"), F.expr("b.subtype = h.subtype"), "left_semi")
    return hard.unionByName(rest.orderBy("preference_margin", "pair_id").limit(max(n - half, 0)).select(*INSPECTED).withColumnRenamed("pair_id", "uid"))


def collapse_flags(records: DataFrame, results: DataFrame, order: str = "uid") -> DataFrame:
    """One row of evidence: subtype and lexical collapse, duplicates, validation errors, tiny-only failures.

    ``records`` are read four times and ``results`` once: give tables, or materialised frames.
    """
    rl = records.where("dataset = 'rl'")
    top = rl.groupBy("subtype").agg(F.count(F.lit(1)).alias("n")).agg(safe_ratio(F.max("n"), F.sum("n")).alias("top_rl_subtype_share"))
    patterns = lexical_counts(records, ["dataset"], order).where("kind = 'patterns'").groupBy("dataset").agg(safe_ratio(F.max("n"), F.sum("n")).alias("s"))
    side = lambda d: F.coalesce(F.max(F.when(F.col("dataset") == d, F.col("s"))), F.lit(0.0))
    shares = patterns.agg(side("rl").alias("rl_top_pattern_share"), side("benchmark").alias("benchmark_top_pattern_share"))
    dup = duplicate_summary(rl, {"pair": ["sentence_good", "sentence_bad"], "good": ["sentence_good"]})
    dup = dup.agg(F.coalesce(F.max(F.when(F.col("kind") == "pair", F.col("duplicated"))), F.lit(0)).alias("duplicate_pair_count"), F.coalesce(F.max(F.when(F.col("kind") == "good", F.col("most"))), F.lit(0)).alias("max_good_sentence_repetition"))
    invalid = validate(rl).agg(F.count_if(~F.col("valid")).alias("validation_error_count"))
    tiny = disagreement(results).agg(F.count_if((F.col("dataset") == "rl") & (F.col("category") == "tiny_fails_stronger_succeed")).alias("tiny_only_failures"))
    one = top.withColumn("_one", F.lit(1))
    for part in (shares, dup, invalid, tiny):  # single rows
        one = one.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return one.drop("_one").select(
        "*", (F.col("top_rl_subtype_share") > 0.25).alias("subtype_collapse"),
        (F.col("rl_top_pattern_share") > F.greatest(F.col("benchmark_top_pattern_share") * 2, F.lit(0.15))).alias("lexical_collapse"),
        ((F.col("duplicate_pair_count") > 0) | (F.col("max_good_sentence_repetition") > 2)).alias("duplicate_evidence"),
        (F.col("validation_error_count") > 0).alias("metadata_issue"), (F.col("tiny_only_failures") > 0).alias("tiny_artifact"),
    )
