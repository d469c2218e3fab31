from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import mixing


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(size):
    one = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 12345))
    assert sorted(one) == list(range(size))
    other = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 999))
    assert size < 64 or (one != other).any()


def test_mix(spark):
    docs = [(i, "big" if i % 10 else " Small ", f"word{i} and some more text number {i} " * 30) for i in range(400)] + [(500, None, "no source at all " * 10), (501, "big", None), (502, "big", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    src = F.lower(F.trim("source"))
    targets = spark.createDataFrame([(1, "big", 1.0, 3), (1, "small", 1.0, 2), (2, "big", 3.0, 1), (2, "absent", 1.0, 5), (3, "small", 0.0, 1), (3, "big", None, 1)], "mix_id long, source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(d, src, targets, block_tokens=64, shard_tokens=4096, seed=3)
    rep = {(r.mix_id, r.source): r for r in report.collect()}
    assert rep[1, "small"].capped and not rep[1, "big"].capped and rep[2, "absent"].capped
    assert rep[2, "absent"].possible_tokens == 0 and rep[2, "absent"].actual_tokens == 0 and not rep[3, "small"].capped
    rows = mixed.where("mix_id = 1").collect()
    uses = Counter((r.source, r.block) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "small") == 2 == rep[1, "small"].most_repeats
    assert len({b for s, b in uses if s == "small"}) == rep[1, "small"].blocks  # all blocks before any is used a third time
    assert all(len(r.tokens) == r.n_tokens <= 64 for r in rows)
    total = rep[1, "big"].tokens + rep[1, "small"].tokens
    assert abs(rep[1, "big"].actual_tokens - total / 2) < 0.1 * total
    again, _ = mixing.mix(d, src, targets, block_tokens=64, shard_tokens=4096, seed=3)
    key = lambda m: sorted((r.mix_id, r.shard, r.source, r.slot, r.block) for r in m.collect())
    assert key(mixed) == key(again)


def _sources(spark, n=300):
    docs = [(i, ["big", "big", "small", "mid"][i % 4] if i % 12 else "tiny", f"text {i * 7919 % 1000} of number {i} and more words {i % 5} " * (5 + i % 30)) for i in range(n)]
    docs += [(1000 + i, "big", "the same copy in a third of all rows " * 9) for i in range(n // 2)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string")


TARGETS = [(1, "big", 1.0, 3), (1, "small", 2.0, 1), (1, "mid", 1.0, 1), (2, "big", 3.0, 1), (2, "absent", 1.0, 5), (2, "tiny", 4.0, 2)]


def test_same_mix_however_the_documents_are_split(spark):
    d, got = _sources(spark), []
    targets = spark.createDataFrame(TARGETS, "mix_id long, source string, target_weight double, max_repeats int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        mixed, report = mixing.mix(d.repartition(parts, "doc_id"), F.col("source"), targets, block_tokens=64, shard_tokens=4096)
        got.append((sorted(tuple(map(str, r)) for r in mixed.collect()), sorted(tuple(map(str, r)) for r in report.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


@pytest.mark.parametrize("refill", [False, True])
def test_totals_are_the_planned_ones(spark, refill):
    targets = spark.createDataFrame(TARGETS, "mix_id long, source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(_sources(spark), F.col("source"), targets, block_tokens=64, shard_tokens=4096, refill=refill)
    rows = report.collect()
    for r in rows:
        assert r.mixed_slots == r.kept_slots <= r.limit_slots and r.most_repeats <= r.max_repeats
        assert r.capped == (r.possible_tokens < r.target_tokens), r
    slots = {(r.mix_id, r.shard, r.slot) for r in mixed.collect()}
    assert len(slots) == mixed.count()
    for m in (1, 2):
        own = [r for r in rows if r.mix_id == m]
        kept, limit, size = (sum(getattr(r, c) for r in own) for c in ("kept_slots", "limit_slots", "wanted_slots"))
        assert size == own[0].mix_slots and (kept == min(size, limit) if refill else kept <= size)
        assert any(r.capped for r in own)
    uses = Counter((r.mix_id, r.source, r.block) for r in mixed.collect())
    for r in rows:
        if r.kept_slots:
            own = [n for (m, s, _), n in uses.items() if (m, s) == (r.mix_id, r.source)]
            assert max(own) - min(own + [0] * (len(own) < r.blocks)) <= 1  # a source repeats evenly


def test_seed_mix_and_source_pick_the_permutation():
    keys = {mixing._key(seed, m, s) for seed in (1, 2, 3) for m in (1, 2, 3) for s in ("course_notes", "other_notes", "my_notes")}
    assert len(keys) == 27


@pytest.mark.parametrize("text", [" " * 900 + "x", "word  two\n\n \t three " * 60, "abc" * 400, "it's they're 1234567 " * 50, "日本語 テキスト " * 80, "\n" * 700 + " a" * 300, "!?!... " * 150])
def test_long_texts_have_the_tokens_of_the_uncut_text(monkeypatch, text):
    data = mixing.vocabulary_bytes()
    want = mixing._encoding(data).encode_ordinary(text)
    for size in (1, 7, 100, 333):
        monkeypatch.setattr(mixing, "PIECE_CHARS", size)
        assert mixing._encode(data, text) == want


def test_blocks_have_a_fixed_length_in_any_split(spark):
    d = _sources(spark, 80)
    for parts in (1, 5):
        blocks = mixing.pack_blocks(d.repartition(parts), F.col("source"), block_tokens=50, ordered=True).collect()
        by = {}
        for b in sorted(blocks, key=lambda b: (b.source, b.local)):
            by.setdefault(b.source, []).append(b)
        assert all([b.local for b in own] == list(range(len(own))) and all(b.n_tokens == len(b.tokens) == 50 for b in own[:-1]) for own in by.values())
    data = mixing.vocabulary_bytes()
    assert sum(b.n_tokens for b in blocks) == sum(len(mixing._encode(data, r.text)) for r in d.collect())


def test_packing_keeps_every_token(spark):
    texts = ["alpha beta", "", None, "gamma " * 500, "délta ünï 日本"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = mixing.pack_blocks(d, F.lit("s"), block_tokens=16).orderBy("local").collect()
    data = mixing.vocabulary_bytes()
    got = mixing._encoding(data).decode([t for b in blocks for t in b.tokens])
    assert got == "".join(t for t in texts if t)
    assert all(b.n_tokens == 16 for b in blocks[:-1])


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([(1, "a", 1.0, 2)], "mix_id long, source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(d, F.col("source"), t)
    assert mixed.isEmpty() and report.count() == 1


def test_draws_before_a_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    rows = [(m, s, k, (k * 7 + m) % 5) for m in (1, 2) for s in ("a", "b") for k in range(11) if (k + m) % 4]
    got = {(r.mix_id, r.source, r.shard): r.first for r in mixing._with_first(spark.createDataFrame(rows, "mix_id long, source string, shard int, drawn long")).collect()}
    assert got == {(m, s, k): sum(d for x, y, j, d in rows if (x, y) == (m, s) and j < k) for m, s, k, _ in rows}
