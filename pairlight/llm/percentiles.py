"""Mergeable percentiles with relative rank error, for groups of any size."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one section of a compactor; the relative rank error falls in proportion to it.
SECTION = 64
#: Relative rank error that the estimates are checked against: more than three standard errors at SECTION = 64.
REL_ERROR = 0.02


class RankSketch:
    """Levels of relative-rank compactors (Cormode, Karnin, Liberty, Thaler, Vesely: Relative Error Streaming Quantiles).

    A full compactor keeps its half next to the protected tail untouched and compacts whole sections at the other end:
    sorted, every second item moves up a level with twice the weight. How many sections go follows the trailing ones of
    a counter, so sections far from the protected tail go most often. The rank error is then a fixed share of the rank
    counted from the protected tail. Sketches of partitions or days merge level by level.
    """

    def __init__(self, protect: str = "low", section: int = SECTION, seed: int = 1) -> None:
        if protect not in ("low", "high"):
            raise ValueError("protect is low or high")
        self.sign = 1.0 if protect == "low" else -1.0
        self.section = section
        self.n = 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state: list[list[int]] = [[0, 3, section]]  # counter, sections, items a section
        self.coin = seed

    def _capacity(self, level: int) -> int:
        _, sections, size = self.state[level]
        return 2 * sections * size

    def _toss(self) -> int:
        self.coin = (self.coin * 6364136223846793005 + 1442695040888963407) % 2**64
        return self.coin >> 63

    def _compact(self, level: int) -> None:
        counter, sections, size = self.state[level]
        items = np.sort(self.levels[level], kind="stable")
        trailing = (counter ^ (counter + 1)).bit_length()
        keep = self._capacity(level) // 2 + (sections - min(trailing, sections)) * size
        cut = items[keep:]
        odd = len(cut) % 2
        keep += odd  # an even number goes
        cut = items[keep:]
        self.levels[level] = items[:keep]
        counter += 1
        if counter >= 2 ** (sections - 1):
            sections, size = sections * 2, max(8, int(size / math.sqrt(2)) // 2 * 2)
        self.state[level] = [counter, sections, size]
        if not len(cut):
            return
        if level + 1 == len(self.levels):
            self.levels.append(np.empty(0))
            self.state.append([0, 3, self.section])
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], cut[self._toss() :: 2]])

    def _settle(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self._capacity(level):
                before = len(self.levels[level])
                self._compact(level)
                if len(self.levels[level]) == before:
                    break
            level += 1

    def update(self, values: np.ndarray) -> None:
        values = self.sign * np.asarray(values, dtype=float)
        self.n += len(values)
        at = 0
        while at < len(values):
            room = max(1, self._capacity(0) - len(self.levels[0]))
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + room]])
            at += room
            self._settle()

    def merge(self, other: RankSketch) -> None:
        if self.sign != other.sign:
            raise ValueError("the sketches protect different tails")
        self.n += other.n
        for level, items in enumerate(other.levels):
            if level == len(self.levels):
                self.levels.append(np.empty(0))
                self.state.append([0, 3, self.section])
            mine, theirs = self.state[level], other.state[level]
            self.state[level] = [mine[0] | theirs[0], max(mine[1], theirs[1]), min(mine[2], theirs[2])]
            self.levels[level] = np.concatenate([self.levels[level], items])
        self._settle()

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 2**i) for i, x in enumerate(self.levels)])
        order = np.argsort(self.sign * items, kind="stable")
        return self.sign * items[order], np.cumsum(weights[order])

    def quantile(self, q: float) -> float:
        """The item whose rank is nearest rank ``ceil(q n)``; NaN when empty."""
        if not self.n:
            return math.nan
        items, ranks = self._weighted()
        want = max(1, math.ceil(q * self.n - 1e-9)) * ranks[-1] / self.n
        return float(items[min(len(items) - 1, np.searchsorted(ranks, want - 1e-9))])

    def rank_below(self, value: float) -> float:
        """Estimated number of items below ``value``."""
        if not self.n:
            return 0.0
        items, ranks = self._weighted()
        at = np.searchsorted(items, value, side="left")
        return float(ranks[at - 1]) * self.n / float(ranks[-1]) if at else 0.0

    def exact(self) -> bool:
        return len(self.levels) == 1

    def to_bytes(self) -> bytes:
        """A line of JSON, then the items of all levels as doubles."""
        head = [self.sign, self.section, self.n, self.coin, self.state, [len(x) for x in self.levels]]
        return json.dumps(head).encode() + b"\n" + np.concatenate(self.levels).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> RankSketch:
        head, _, items = bytes(data).partition(b"\n")
        s = RankSketch()
        s.sign, s.section, s.n, s.coin, s.state, sizes = json.loads(head)
        s.levels = np.split(np.frombuffer(items, "<f8"), np.cumsum(sizes)[:-1])
        return s


def _seed(*parts: object) -> int:
    """Tosses of different tasks, groups and tails must not go together, else their errors add up instead of cancelling."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def sketch_groups(df: DataFrame, groups: Sequence[str], value: str, section: int = SECTION) -> DataFrame:
    """``groups, n, low, high``: per group one sketch for each tail, as bytes; can be stored and merged with other days'.

    Every task first sketches its own rows (a map-side combine: a group with a third of all rows is spread over all
    tasks and reaches the merge as one small sketch a task), then sketches of a group are merged, first in salted
    parts. Null, NaN and infinite values are left out; null group values form a group of their own.
    """
    groups = list(groups)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n long, low binary, high binary"
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple, tuple[RankSketch, RankSketch]] = {}
        task = TaskContext.get().partitionId()
        for pdf in batches:
            for key, part in pdf.groupby(groups, dropna=False, sort=False)["_value"]:
                pair = own.get(key)
                if pair is None:
                    pair = own[key] = tuple(RankSketch(tail, section, _seed(task, key, tail)) for tail in ("low", "high"))
                for s in pair:
                    s.update(part.to_numpy())
            if len(own) > 20_000:  # many small groups: hand them on, they merge later
                yield table(own)
                own = {}
        if own:
            yield table(own)

    def table(own: dict) -> pd.DataFrame:
        out = pd.DataFrame([[None if pd.isna(k) else k for k in key] for key in own], columns=groups, dtype=object)
        return out.assign(n=[p[0].n for p in own.values()], low=[p[0].to_bytes() for p in own.values()], high=[p[1].to_bytes() for p in own.values()])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = (RankSketch.from_bytes(pdf[c].iloc[0]) for c in ("low", "high"))
        for a, b in zip(pdf["low"].iloc[1:], pdf["high"].iloc[1:], strict=True):
            low.merge(RankSketch.from_bytes(a))
            high.merge(RankSketch.from_bytes(b))
        return pdf[groups].iloc[:1].assign(n=[low.n], low=[low.to_bytes()], high=[high.to_bytes()])

    parts = df.where(finite).select(*groups, F.col(value).cast("double").alias("_value")).mapInPandas(build, schema)
    # about as many sketches meet in the first merge as first merges in the second
    salts = max(16, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.groupBy(*groups, "_salt").applyInPandas(merged, schema)
    return first.groupBy(*groups).applyInPandas(merged, schema)


def percentiles(sketches: DataFrame, groups: Sequence[str], pcts: Sequence[int], threshold: float = 0.0, rel_error: float = REL_ERROR) -> DataFrame:
    """``groups, n, pct, value, below, sure``: nearest-rank percentiles out of sketches.

    Percentiles up to 50 come from the sketch that protects the low tail, the others from the high one. ``below``: is the
    percentile under ``threshold``, by the estimated rank of the threshold; ``sure`` is false where that rank is within
    the relative error of the asked one, so that only an exact count can tell.
    """
    groups = list(groups)
    kinds = dict(sketches.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n long, pct int, value double, below boolean, sure boolean"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                d = row._asdict() if not groups else dict(zip(pdf.columns, row, strict=True))
                low, high = RankSketch.from_bytes(d["low"]), RankSketch.from_bytes(d["high"])
                for pct in pcts:
                    s = low if pct <= 50 else high
                    want = max(1, math.ceil(pct * s.n / 100))
                    under = s.rank_below(threshold)
                    from_tail = max(under, want) if pct <= 50 else s.n - min(under, want) + 1
                    sure = s.exact() or abs(under - want) > rel_error * from_tail + 1
                    out.append([*[d[g] for g in groups], s.n, pct, s.quantile(pct / 100), under >= want, sure])
            yield pd.DataFrame(out, columns=[*groups, "n", "pct", "value", "below", "sure"])

    return sketches.mapInPandas(ask, schema)
