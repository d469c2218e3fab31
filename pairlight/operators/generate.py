"""Controlled generation of minimal pairs: schedules, word choice and realisation."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.lexicon import SLOTS, TEMPLATE_FIELDS, TEMPLATES, VERBS_PLURAL, VERBS_SINGULAR
from pairlight.functions.text import md5_number, sentence_tokens

PAIR_FIELDS = ["uid", "phenomenon", "sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth", "template_type", "subtype"]


def templates(spark: SparkSession, types: Sequence[str] = (), subtypes: Sequence[str] = (), max_distance: int = 999, max_attractors: int = 999, max_depth: int = 999) -> DataFrame:
    """The template shapes as a table of 15 rows with ``ordinal``, filtered by type, subtype and bounds; empty lists mean
    all. An unknown subtype list that leaves nothing is an error."""
    rows = [
        (i, *t) for i, t in enumerate(TEMPLATES)
        if (not types or t[0] in types) and (not subtypes or t[1] in subtypes) and t[4] <= max_distance and t[5] <= max_attractors and t[6] <= max_depth
    ]
    if not rows:
        raise ValueError("no template is left")
    return spark.createDataFrame(rows, "ordinal int, template_type string, subtype string, shape string, subject_number string, dependency_distance int, attractor_count int, clause_depth int")


def schedule(spark: SparkSession, count: int, balanced: bool = False, types: Sequence[str] = ()) -> DataFrame:
    """``i, ordinal``: the template of each of ``count`` pairs.

    Unbalanced: templates in turn. Balanced: types (in name order) in turn, and each type's templates in turn.
    """
    if count < 0:
        raise ValueError("count must not be negative")
    listed = [i for i, t in enumerate(TEMPLATES) if not types or t[0] in types]
    i = F.col("id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    if not balanced:
        ordinal = pick(listed, i % len(listed))
    else:
        kinds = sorted({TEMPLATES[k][0] for k in listed})
        ordinal = F.lit(None).cast("int")
        for k, kind in enumerate(kinds):
            own = [n for n in listed if TEMPLATES[n][0] == kind]
            turn = F.floor(i / len(kinds))
            ordinal = F.when(i % len(kinds) == k, pick(own, turn % len(own))).otherwise(ordinal)
    return spark.range(count).select(i.alias("i"), ordinal.alias("ordinal"))


def _word(values: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def realize(numbered: DataFrame, key: str | Column, seed: str = "42") -> DataFrame:
    """Adds sentences and metadata to rows with a template ``ordinal``.

    Words are picked by the MD5 of seed, key and slot, so any row can be made anywhere and the result does not depend on
    partitions. Singular and plural lists of a slot are read at the same place.
    """
    spark = numbered.sparkSession
    shapes = templates(spark)
    rows = numbered.join(F.broadcast(shapes), "ordinal")  # 15 rows
    sentence = F.col("shape")
    for slot, words in SLOTS.items():
        stem = slot.removesuffix("_singular").removesuffix("_plural")
        sentence = F.replace(sentence, F.lit("{" + slot + "}"), _word(words, md5_number(F.lit(seed), key, F.lit(stem))))
    number = md5_number(F.lit(seed), key, F.lit("verb"))
    one, many = _word(VERBS_SINGULAR, number), _word(VERBS_PLURAL, number)
    plural = F.col("subject_number") == "plural"
    good, bad = F.when(plural, many).otherwise(one), F.when(plural, one).otherwise(many)
    rows = rows.withColumn("_stem", sentence)
    rows = rows.withColumn("sentence_good", F.concat("_stem", F.lit(" "), good, F.lit("."))).withColumn("sentence_bad", F.concat("_stem", F.lit(" "), bad, F.lit(".")))
    return rows.withColumn("phenomenon", F.lit("agreement")).drop("_stem", "shape", "subject_number")


def generate_pairs(spark: SparkSession, count: int, balanced: bool = False, seed: str = "42") -> DataFrame:
    """``count`` pairs at any scale; an invalid pair is an error, as the generator must only make valid ones."""
    rows = realize(schedule(spark, count, balanced), "i", seed)
    number = (F.col("i") + 1).cast("string")
    rows = rows.withColumn("uid", F.concat("template_type", F.lit("-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)))
    gate = F.assert_true(pair_is_valid("sentence_good", "sentence_bad", "dependency_distance", "attractor_count", "clause_depth"), F.lit("invalid generated pair"))
    return rows.where(gate.isNull()).select(*PAIR_FIELDS)


def pair_is_valid(good: str, bad: str, distance: str, attractors: str, depth: str) -> Column:
    """Non-empty different sentences that differ in the last token alone, metadata not negative, distance as computed."""
    a, b = sentence_tokens(good), sentence_tokens(bad)
    differ = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))) == F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0)))) & (F.element_at(a, -1) != F.element_at(b, -1))
    numbers = (F.col(distance) >= 0) & (F.col(attractors) >= 0) & (F.col(depth) >= 0) & (F.col(distance) == dependency_distance(good))
    return F.coalesce((F.trim(F.col(good)) != "") & (F.trim(F.col(bad)) != "") & (F.col(good) != F.col(bad)) & differ & numbers, F.lit(False))


def dependency_distance(sentence: str | Column) -> Column:
    """Tokens between subject and verb plus one: the number of tokens less two; null for fewer than three tokens."""
    n = F.size(sentence_tokens(sentence))
    return F.when(n >= 3, n - 2)


def replay_pairs(count: int, seed: int, balanced: bool = True) -> Iterator[dict]:
    """The seeded pairs exactly as the sequential generator draws them: one draw a slot in slot order, then a verb pair.

    Sequential by nature; for fixtures and published data sets. ``generate_pairs`` is the form for scale.
    """
    rng = random.Random(seed)
    kinds = sorted({t[0] for t in TEMPLATES})
    verbs = list(zip(VERBS_SINGULAR, VERBS_PLURAL, strict=True))
    for i in range(count):
        if balanced:
            own = [t for t in TEMPLATES if t[0] == kinds[i % len(kinds)]]
            shape = own[i // len(kinds) % len(own)]
        else:
            shape = TEMPLATES[i % len(TEMPLATES)]
        words = {slot: rng.choice(values) for slot, values in SLOTS.items()}
        one, many = rng.choice(verbs)
        t = dict(zip(TEMPLATE_FIELDS, shape, strict=True))
        good, bad = (one, many) if t["subject_number"] == "singular" else (many, one)
        stem = t["shape"].format(**words)
        yield {"uid": f"{t['template_type']}-{i + 1:04d}", "phenomenon": "agreement", "sentence_good": f"{stem} {good}.", "sentence_bad": f"{stem} {bad}.", **{k: t[k] for k in ("dependency_distance", "attractor_count", "clause_depth", "template_type", "subtype")}}
