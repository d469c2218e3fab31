"""Mixing token blocks of several sources to target weights."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight.storage import materialize

#: Ranks of a public byte-level BPE vocabulary: one line "base64 token, rank" each. Read by the driver, sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with that vocabulary (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 256
#: A vocabulary file beyond this is refused: it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters handed to the tokenizer at once; longer texts go in pieces cut where the split pattern cuts, so that the
#: tokens are those of the uncut text.
PIECE_CHARS = 100_000
_SPLIT = regex.compile(SPLIT)


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _encode(data: bytes, text: str | None) -> list[int]:
    if not text:
        return []
    encoding = _encoding(data)
    if len(text) <= PIECE_CHARS:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        if m.end() - at >= PIECE_CHARS:
            out += encoding.encode_ordinary(text[at : m.end()])
            at = m.end()
    return out + encoding.encode_ordinary(text[at:])


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return data


def tokenized(docs: DataFrame, source: Column, text: str = "text", vocabulary: str = VOCABULARY, ordered: bool = True) -> DataFrame:
    """``source, part, start, n, tokens``: each text's tokens, with their place in the source's tokens of their part.

    ``ordered``: the texts are first sorted by source and hash over ranges, so that a source's tokens come in one order
    however the documents are split; equal texts can stand for each other, and a large group of them is split over ranges
    by a running number. Else every task keeps the given order of its documents. Empty and null texts have no row.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict = {}
        part = TaskContext.get().partitionId()
        for pdf in batches:
            out = []
            for s, t in zip(pdf["source"], pdf["text"], strict=True):
                tokens = np.array(_encode(data.value, t), dtype=np.int32)
                out.append((s, part, at.get(s, 0), len(tokens), tokens))
                at[s] = at.get(s, 0) + len(tokens)
            if out:
                yield pd.DataFrame(out, columns=["source", "part", "start", "n", "tokens"])

    rows = docs.select(source.alias("source"), F.col(text).alias("text")).where("length(text) > 0")
    if ordered:
        keys = ["source", "_hash", "_copy"]
        rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_copy", F.monotonically_increasing_id())
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return rows.select("source", "text").mapInPandas(encode, "source string, part int, start long, n int, tokens array<int>")


def _before(keys: list[str], order: str, c: str) -> Column:
    return F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def join_blocks(tokens: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``source, local, n_tokens, tokens``: each source's tokens, part after part, cut into blocks of a fixed length.

    ``local`` numbers a source's blocks 0, 1, ...; only its last one may be shorter. Every part's place in its source is
    the sum of the parts before, so blocks are cut where the rows lie; only the two blocks at the ends of a run of rows
    are put together from pieces by a shuffle. What is cut is written to the shared folder.
    """
    totals = tokens.groupBy("source", "part").agg(F.max(F.col("start") + F.col("n")).alias("_n"))
    offsets = totals.select("source", "part", _before(["source"], "part", "_n").alias("_offset"))
    placed = tokens.alias("t").join(offsets.alias("o"), F.expr("t.source <=> o.source AND t.part = o.part"))
    placed = placed.select("t.source", (F.col("t.start") + F.col("o._offset")).alias("place"), "t.tokens").sortWithinPartitions("source", "place")
    columns = ["source", "local", "at", "n_tokens", "tokens"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, start, end = None, 0, 0  # of the tokens at hand
        held: list[np.ndarray] = []

        def take(whole: bool) -> list[tuple]:
            """Blocks up to the last border at hand; with ``whole`` also what is behind it."""
            nonlocal held, start
            upto = end if whole else end - end % block_tokens
            if upto <= start:
                return []
            data = np.concatenate(held)
            borders = [start, *range(start - start % block_tokens + block_tokens, upto, block_tokens), upto]
            out = [(source, x // block_tokens, x % block_tokens, y - x, data[x - start : y - start]) for x, y in zip(borders, borders[1:], strict=False)]
            held, start = [data[upto - start :]], upto
            return out

        for pdf in batches:
            out = []
            for s, place, own in zip(pdf["source"], pdf["place"], pdf["tokens"], strict=True):
                if s != source or place != end:
                    out += take(True)
                    source, start, end, held = s, place, place, []
                held.append(np.asarray(own, dtype=np.int32))
                end += len(own)
            out += take(False)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if rest := take(True):
            yield pd.DataFrame(rest, columns=columns)

    pieces = materialize(placed.mapInPandas(cut, "source string, local long, at int, n_tokens int, tokens array<int>"))
    whole = pieces.where(F.col("n_tokens") == block_tokens).drop("at")
    ends = pieces.where(F.col("n_tokens") < block_tokens).groupBy("source", "local").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("p"))
    return whole.unionByName(ends.select("source", "local", "n_tokens", F.flatten("p.tokens").alias("tokens")))


def pack_blocks(docs: DataFrame, source: Column, text: str = "text", block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, ordered: bool = False) -> DataFrame:
    """The blocks of ``join_blocks`` out of texts; see ``tokenized``. No token is lost, each text is followed by nothing.

    A null source is a source of its own, which no target names.
    """
    return join_blocks(materialize(tokenized(docs, source, text, vocabulary, ordered)), block_tokens)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``index`` under a pseudo-random permutation of 0 .. ``size`` - 1 that ``key`` picks: a Feistel network over as many
    bits as the size needs, its halves differing by one at most, walked along its cycles until the value is in range."""
    size = np.asarray(size, dtype=np.uint64)
    out = np.asarray(index, dtype=np.uint64).copy()
    key = np.asarray(key, dtype=np.uint64)
    bits = np.full(len(out), 2, dtype=np.uint64)
    while (grow := (np.uint64(1) << bits) < size).any():
        bits += grow.astype(np.uint64)
    low = bits // np.uint64(2)
    masks = ((np.uint64(1) << (bits - low)) - np.uint64(1), (np.uint64(1) << low) - np.uint64(1))
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> low[todo], out[todo] & masks[1][todo]
            for r in range(6):
                x = (right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                left, right = right, left ^ (x & masks[r % 2][todo])
            out[todo] = (left << low[todo]) | right
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def plan_mixes(targets: DataFrame, sizes: DataFrame, total_tokens: int, refill: bool = False) -> DataFrame:
    """One row per mix and source: normalised weight, wanted and possible tokens, and the slots it is to fill.

    ``targets``: ``mix_id, source, target_weight, max_repeats`` (source names folded already; several rows of a source in
    a mix add up their weights and take their largest ``max_repeats``; null or negative weights count 0, null repeats 1).
    ``sizes``: ``source, blocks, tokens``. The size of a mix is ``total_tokens``. A source without documents has size 0.

    ``wanted_slots`` are whole blocks by largest remainder, adding up to ``mix_slots``; ``kept_slots`` are those that
    ``max_repeats`` times the source's blocks can fill. With ``refill`` the sources that are not at their limit share the
    slots that others cannot fill, by their weights, as long as any can.
    """
    t = targets.where("source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("target_weight"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).cast("long").alias("max_repeats"),
    )
    every = W.partitionBy("mix_id")
    share = F.when(F.sum("target_weight").over(every) > 0, F.col("target_weight") / F.sum("target_weight").over(every)).otherwise(0.0)
    t = t.withColumn("target_share", share).join(sizes.select("source", "blocks", "tokens"), "source", "left").fillna(0, ["blocks", "tokens"])
    t = t.withColumn("target_tokens", F.col("target_share") * total_tokens).withColumn("possible_tokens", F.col("tokens") * F.col("max_repeats"))
    t = t.withColumn("wanted_blocks", F.when(F.col("tokens") > 0, F.col("target_tokens") * F.col("blocks") / F.col("tokens")).otherwise(0.0))
    t = t.withColumn("mix_slots", F.floor(F.sum("wanted_blocks").over(every) + 1e-6))
    t = t.withColumn("limit_slots", F.col("blocks") * F.col("max_repeats"))
    t = _whole_slots(t, "wanted_blocks", "wanted_slots")
    t = t.withColumn("kept_slots", F.least("wanted_slots", "limit_slots"))
    if not refill:
        return t
    # By rising limit per wanted block: each source is tested against its part of what those before leave. The first that
    # stays under its limit ends them.
    order = every.orderBy(F.try_divide("limit_slots", "wanted_blocks").asc_nulls_last(), "source")
    left = F.col("mix_slots") - F.coalesce(F.sum("limit_slots").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("wanted_blocks").over(order.rowsBetween(0, W.unboundedFollowing))
    full = (F.col("wanted_blocks") > 0) & (F.col("limit_slots") * behind < F.col("wanted_blocks") * left)
    t = t.withColumn("_full", full).withColumn("_full", F.min("_full").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rest = F.sum(F.when(~F.col("_full"), F.col("wanted_blocks"))).over(every)
    spare = F.col("mix_slots") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("limit_slots"))).over(every), F.lit(0))
    t = t.withColumn("_share", F.when(F.col("_full"), F.col("limit_slots").cast("double")).otherwise(F.coalesce(F.try_divide(spare * F.col("wanted_blocks"), rest), F.lit(0.0))))
    t = _whole_slots(t, "_share", "kept_slots", F.floor(F.sum("_share").over(every) + 1e-6))
    return t.withColumn("kept_slots", F.least("kept_slots", "limit_slots")).drop("_full", "_share")


def _whole_slots(t: DataFrame, wanted: str, name: str, size: Column | None = None) -> DataFrame:
    """Adds ``name``: ``wanted`` in whole numbers by largest remainder, adding up to ``size`` (``mix_slots``)."""
    every = W.partitionBy("mix_id")
    whole = F.floor(F.col(wanted) + 1e-9)
    t = t.withColumn("_whole", whole).withColumn("_over", (size if size is not None else F.col("mix_slots")) - F.sum("_whole").over(every))
    place = F.row_number().over(every.orderBy(F.desc(F.col(wanted) - F.col("_whole")), "source"))
    return t.withColumn("_place", place).withColumn(name, F.col("_whole") + F.when((F.col("_place") <= F.col("_over")) & (F.col(wanted) > F.col("_whole")), 1).otherwise(0)).drop("_whole", "_over", "_place")


#: Shards whose draws are summed in one group; sums of groups are then summed again, so no task gets all shards.
SHARD_GROUP = 4096


def _with_first(drawn: DataFrame) -> DataFrame:
    """Adds ``first``: how many blocks of the source the shards before this one drew in the mix."""
    keys = ["mix_id", "source"]
    rows = drawn.withColumn("_group", F.floor(F.col("shard") / SHARD_GROUP))
    groups = rows.groupBy(*keys, "_group").agg(F.sum("drawn").alias("_n"))
    groups = groups.select(*keys, "_group", _before(keys, "_group", "_n").alias("_before"))
    rows = rows.withColumn("_inside", _before([*keys, "_group"], "shard", "drawn")).join(groups, [*keys, "_group"])
    return rows.select(*drawn.columns, (F.col("_before") + F.col("_inside")).alias("first"))


def _key(*parts: object) -> int:
    """63 bits that depend on all parts alike."""
    parts = tuple(int(p) if isinstance(p, np.integer) else p for p in parts)
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") >> 1


def draw_slots(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``mix_id, source, shard, slot, repeat, block``: which block fills each slot of each output shard.

    Each shard draws its number of blocks per source from a multinomial, from a generator seeded by mix and shard. A
    source's draws are numbered through the shards, in a pseudo-random order if not all can stay; it keeps as many as the plan gives it
    (``kept_slots``) and hands the others, which chance or its limit make too many, to the sources that drew fewer than
    planned, so the totals of the mix are the planned ones; what no source can take stays empty. Number k of a source is
    block ``permutation(k mod blocks)``, another permutation each time round, so a source repeats evenly.
    """
    kind = dict(plan.dtypes)["mix_id"]
    spark = plan.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plan = materialize(plan.where("wanted_blocks > 0"))
    listed = plan.select("mix_id", "mix_slots", F.struct("source", "wanted_blocks").alias("s")).groupBy("mix_id", "mix_slots").agg(F.sort_array(F.collect_list("s")).alias("sources"))
    per_shard = listed.select("mix_id", "mix_slots", "sources", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).repartition(parts, "mix_id", "shard")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for mix, size, sources, shard in zip(pdf["mix_id"], pdf["mix_slots"], pdf["sources"], pdf["shard"], strict=True):
                wanted = np.array([s["wanted_blocks"] for s in sources])
                rng = np.random.default_rng([seed, _key(mix), int(shard)])
                n = int(size) * (int(shard) + 1) // shards - int(size) * int(shard) // shards
                at = 0
                for s, c in zip(sources, rng.multinomial(n, wanted / wanted.sum()), strict=True):
                    if c:
                        rows.append((mix, s["source"], int(shard), int(n), at, int(c)))
                        at += int(c)
            if rows:
                yield pd.DataFrame(rows, columns=["mix_id", "source", "shard", "shard_slots", "at", "drawn"])

    drawn = materialize(per_shard.mapInPandas(draw, f"mix_id {kind}, source string, shard int, shard_slots long, at long, drawn long"))
    totals = drawn.groupBy("mix_id", "source").agg(F.sum("drawn").alias("drawn_all"))
    every = W.partitionBy("mix_id").orderBy("source").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    p = plan.join(totals, ["mix_id", "source"], "left").withColumn("drawn_all", F.coalesce("drawn_all", zero))
    p = p.withColumn("_given", F.greatest(F.col("drawn_all") - F.col("kept_slots"), zero)).withColumn("_taken", F.greatest(F.col("kept_slots") - F.col("drawn_all"), zero))
    p = p.withColumn("give_from", F.coalesce(F.sum("_given").over(every), zero)).withColumn("take_from", F.coalesce(F.sum("_taken").over(every), zero))
    p = materialize(p)
    takers = p.where("_taken > 0").groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("take_from", "_taken", "source", "drawn_all", "blocks"))).alias("takers"))
    counts = _with_first(drawn).join(p.select("mix_id", "source", "blocks", "drawn_all", "kept_slots", "give_from"), ["mix_id", "source"]).join(takers, "mix_id", "left")
    counts = counts.withColumn("takers", F.when(F.col("drawn_all") > F.col("kept_slots"), F.col("takers"))).repartition(parts, "mix_id", "source", "shard")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for a in range(0, r.drawn, 100_000):
                    k = np.arange(a, min(r.drawn, a + 100_000))
                    many = lambda x: np.full(len(k), x)  # noqa: B023, E731
                    slot = permuted(r.at + k, many(r.shard_slots), many(_key(seed, r.mix_id, r.shard)))
                    number = r.first + k
                    if r.drawn_all > r.kept_slots:  # spread what is handed on
                        number = permuted(number, many(r.drawn_all), many(_key(seed, r.mix_id, r.source, "draws")))
                    keeps = number < r.kept_slots
                    given = r.give_from + number - r.kept_slots
                    yield filled(r.mix_id, r.shard, r.source, r.blocks, slot[keeps], number[keeps])
                    for t in r.takers if r.takers is not None else ():
                        own = ~keeps & (given >= t["take_from"]) & (given < t["take_from"] + t["_taken"])
                        yield filled(r.mix_id, r.shard, t["source"], t["blocks"], slot[own], t["drawn_all"] + given[own] - t["take_from"])

    def filled(mix, shard: int, source: str, blocks: int, slot: np.ndarray, number: np.ndarray) -> pd.DataFrame:
        turn = number // max(1, blocks)
        key = np.uint64(_key(seed, mix, source)) + turn.astype(np.uint64) * np.uint64(1_000_003)
        block = permuted(number % max(1, blocks), np.full(len(number), blocks), key) if len(number) else number
        return pd.DataFrame({"mix_id": mix, "source": source, "shard": shard, "slot": slot, "repeat": turn, "block": block})

    return counts.mapInPandas(slots, f"mix_id {kind}, source string, shard int, slot long, repeat long, block long")


def mix(docs: DataFrame, source: Column, targets: DataFrame, text: str = "text", shard_tokens: int = 1 << 20, block_tokens: int = BLOCK_TOKENS, seed: int = 42, vocabulary: str = VOCABULARY, refill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mixed blocks, report). ``targets`` must have folded source names.

    Mixed: ``mix_id, shard, source, slot, repeat, block, n_tokens`` and ``tokens``. Report: one row per mix and source
    with target and actual share, tokens, slots wanted and kept, the most often any block is used, and ``capped``: the mix
    uses up all repeats of the source and still holds less of it than its share of the size of all documents. ``refill``:
    other sources take the slots that a source at its limit leaves empty, see ``plan_mixes``.

    Texts are put in an order of their own, packed and written once to the shared folder, and read by all mixes; slots meet
    blocks in a join by source and block number, which spreads a large source over all tasks. The mixed blocks are written
    once, contents and all, and the report is made from what was written. The same seed gives the same mix, whatever the
    number of partitions, cores or files.
    """
    tokens = materialize(tokenized(docs, source, text, vocabulary))
    sizes = tokens.groupBy("source").agg(F.sum("n").alias("tokens"))
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)))
    total = int(sizes.agg(F.sum("tokens")).first()[0] or 0)
    plan = materialize(plan_mixes(targets, sizes, total, refill))
    slots = draw_slots(plan, max(1, -(-total // shard_tokens)), seed)
    packed = join_blocks(tokens, block_tokens).withColumnRenamed("local", "block")
    # the planner takes the slots for as few as the counts they come from: they must not be broadcast
    mixed = materialize(slots.join(packed.hint("merge"), ["source", "block"]).select("mix_id", "shard", "source", "slot", "repeat", "block", "n_tokens", "tokens"))
    used = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("actual_tokens"), (F.max("repeat") + 1).alias("most_repeats"), F.count("*").alias("mixed_slots"))
    report = plan.join(used, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "most_repeats", "mixed_slots"])
    whole = F.sum("actual_tokens").over(W.partitionBy("mix_id"))
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0))
    used_up = F.col("mixed_slots") >= F.col("limit_slots")
    return mixed, materialize(report.withColumn("capped", used_up & (F.col("actual_tokens") < F.col("target_tokens"))))
