"""Rows by their rank in an order, without sorting or scanning the whole table again.

A rank index is a stored table of order keys, dealt out by range: Spark's range partitioner samples the keys,
each range is written by itself, and one small row per range tells how many rows lie before it. A
rank is then a range and an offset in it, and looking one up reads that range alone. Keys may
carry a weight ``n``: value counts stand for their rows, so one value in a third of all rows is one key.
Ties are no problem where the last key is the row identity.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from gleanframe.session import stored

RANGE, RANK = "_range", "_rank"


@dataclass(frozen=True)
class RankIndex:
    """Keys in stored ranges. ``ranges`` are the numbers of the ranges in order, ``sizes`` their rows."""

    rows: DataFrame
    order: tuple[Column, ...]
    weight: Column
    ranges: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def build(cls, rows: DataFrame, order: Sequence[Column], weighted: bool = False) -> RankIndex:
        """Store ``rows`` by range of ``order``; ``weighted`` rows count as often as their column ``n`` says."""
        # the partition a row was dealt to, frozen by the write: a retry cannot move it
        dealt = rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
        kept = stored(dealt, "ranks", RANGE)
        weight = F.col("n") if weighted else F.lit(1)
        sums = sorted(kept.groupBy(RANGE).agg(F.sum(weight).alias("size")).collect())
        return cls(kept, tuple(order), weight, *(zip(*sums) if sums else ((), ())))

    @cached_property
    def total(self) -> int:
        return sum(self.sizes)

    @cached_property
    def before(self) -> tuple[int, ...]:
        """Rows before each range."""
        return tuple(accumulate((0, *self.sizes[:-1]))) if self.sizes else ()

    def _range_of(self, rank: int) -> int:
        """Position of the range that holds a rank."""
        return bisect_right(self.before, rank) - 1

    def _placed(self, positions: Sequence[int]) -> DataFrame:
        """Keys of some ranges with ``_rank`` within their range; each range is sorted by itself."""
        upto = W.partitionBy(RANGE).orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1)
        rank = F.coalesce(F.sum(self.weight).over(upto), F.lit(0)).cast("bigint")
        return self.rows.where(F.col(RANGE).isin([self.ranges[p] for p in positions])).withColumn(RANK, rank)

    def placed(self) -> DataFrame:
        """All keys with ``_rank`` within their range."""
        return self._placed(range(len(self.ranges)))

    def _inside(self, rank: int) -> Column:
        """Whether the rows of a key hold a rank."""
        p = self._range_of(rank)
        at = rank - self.before[p]
        return (F.col(RANGE) == self.ranges[p]) & (F.col(RANK) <= at) & (F.col(RANK) + self.weight > at)

    def slice(self, rank: int, count: int) -> DataFrame:
        """The keys of ``count`` ranks from ``rank`` on, with the ``_rank`` of their first row; reads the ranges that hold them."""
        end = min(rank + count, self.total)
        if rank >= end:
            return self.rows.limit(0).withColumn(RANK, F.lit(0).cast("bigint"))
        positions = range(self._range_of(rank), self._range_of(end - 1) + 1)
        of = {p: F.col(RANGE) == self.ranges[p] for p in positions}
        before = F.coalesce(*[F.when(here, self.before[p]) for p, here in of.items()])
        placed = self._placed(positions).withColumn(RANK, F.col(RANK) + before)
        return placed.where((F.col(RANK) + self.weight > rank) & (F.col(RANK) < end))

    def at(self, ranks: Sequence[int], key: str) -> dict[int, object]:
        """The value of the column ``key`` at each rank."""
        if not ranks:
            return {}
        wanted = sorted(set(ranks))
        placed = self._placed(sorted({self._range_of(r) for r in wanted}))
        # as many rows as ranks at most
        rows = placed.where(reduce(or_, map(self._inside, wanted))).select(RANGE, RANK, self.weight.alias("weight"), F.col(key).alias("value"))
        found, start = {}, dict(zip(self.ranges, self.before))
        for row in rows.collect():
            low = start[row[RANGE]] + row[RANK]
            found |= {r: row.value for r in wanted if low <= r < low + row.weight}
        return found

    def first(self, count: int) -> DataFrame:
        """The rows of the first ``count`` ranks: whole ranges as they are, and a part of the last."""
        if count >= self.total:
            return self.rows.drop(RANGE)
        last = self._range_of(count)
        whole = self.rows.where(F.col(RANGE).isin(list(self.ranges[:last]))) if last else self.rows.limit(0)
        part = self._placed([last]).where(F.col(RANK) < count - self.before[last]).drop(RANK)
        return whole.unionByName(part).drop(RANGE)


def quantiles(index: RankIndex, key: str, probabilities: Sequence[float]) -> list[float] | None:
    """Linearly interpolated quantiles of a numeric key, None without rows. NaN ranks above everything."""
    if not index.total:
        return None
    places = [p * (index.total - 1) for p in probabilities]
    last = index.total - 1
    found = index.at([r for h in places for r in (int(h), min(int(h) + 1, last))], key)
    values = {rank: float(v) for rank, v in found.items()}
    result = []
    for h in places:
        lower, upper, part = values[int(h)], values[min(int(h) + 1, last)], h - int(h)
        result.append(lower if part == 0 else lower * (1 - part) + upper * part)
    return result


def sample_rows(df: DataFrame, rows: int, rowid: str, total: int, seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows, the same ones every time: those with the smallest hash of row id.

    Hashes are spread evenly, so the cut-off lies below a bound that few more rows pass; it is looked up
    in the order of those alone, and taking the sample is then a plain filter.
    """
    if total <= rows:
        return df
    mix, number = F.xxhash64(F.lit(seed), F.col(rowid)), F.col(rowid).cast("bigint")
    share = min(1.0, (rows + 8 * rows**0.5 + 16) / total)
    bound = F.lit(-(1 << 63) + int(share * ((1 << 64) - 1)))
    keys = df.select(mix.alias("mix"), number.alias("number"))
    index = RankIndex.build(keys.where(F.col("mix") <= bound), [F.asc("mix"), F.asc("number")])
    if index.total < rows:  # the hashes are uneven: nothing can be left out beforehand
        index = RankIndex.build(keys, [F.asc("mix"), F.asc("number")])
    cut: Row = index.slice(rows - 1, 1).first()
    return df.where((mix < F.lit(cut.mix)) | ((mix == F.lit(cut.mix)) & (number <= F.lit(cut.number))))
