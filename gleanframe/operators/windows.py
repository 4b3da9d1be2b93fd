"""Framed windows over keys of any size.

Spark sorts the rows of a window's key in one task, so a key that holds a third of all rows is one task's.
Here the rows are stored in ranges of (key, order), a range per task whatever the keys. A frame of some rows
before and behind reaches over the ends of a range by so many rows only, so each range borrows those from its
neighbours, and its windows see all that their frames hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanframe.functions.columns import col
from gleanframe.operators.ranks import RANGE, RANK, RankIndex

_TARGET, _LOW, _HIGH = "_target", "_low", "_high"


def _borrowed(index: RankIndex, preceding: int, following: int) -> list[tuple[int, int, int, int]]:
    """``(range, target, low, high)``: the rows of a range, by rank in it, that a range's frames need."""
    ends = [b + s for b, s in zip(index.before, index.sizes)]
    found, first = [], 0
    for t, target in enumerate(index.ranges):
        low, high = index.before[t] - preceding, ends[t] + following
        while ends[first] <= low:
            first += 1
        s = first
        while s < len(ends) and index.before[s] < high:
            start = index.before[s]
            found.append((index.ranges[s], target, max(low - start, 0), min(high, ends[s]) - start))
            s += 1
    return found


def framed_window(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str | Column],
    columns: Mapping[str, Column],
    preceding: int = 0,
    following: int = 0,
) -> DataFrame:
    """``df`` with aggregates over ``ROWS BETWEEN preceding PRECEDING AND following FOLLOWING`` of each key.

    ``order_by`` should put the rows of a key in a total order, as any frame of rows should. Null keys
    form one key. Same rows as the SQL window, in no order; the rows are written once.
    """
    for name in (preceding, following):
        if isinstance(name, bool) or not isinstance(name, int) or name < 0:
            raise ValueError("a frame reaches over a whole number of rows, 0 or more")
    missing = [c for c in partition_by if c not in df.columns]
    if missing or not order_by:
        raise ValueError(f"Invalid window column: {', '.join(missing) or 'no order given'}")
    keys = [col(c) for c in partition_by]
    order = [c if isinstance(c, Column) else col(c) for c in order_by]
    index = RankIndex.build(df, [*[k.asc_nulls_first() for k in keys], *order])
    # a few rows per range, which the driver knows already
    schema = f"{RANGE} int, {_TARGET} int, {_LOW} long, {_HIGH} long"
    spans = df.sparkSession.createDataFrame(_borrowed(index, preceding, following), schema)
    sent = index.placed().join(F.broadcast(spans), RANGE).where((F.col(RANK) >= F.col(_LOW)) & (F.col(RANK) < F.col(_HIGH)))
    frame = W.partitionBy(_TARGET, *keys).orderBy(*order).rowsBetween(-preceding, following)
    framed = sent.select("*", *[c.over(frame).alias(name) for name, c in columns.items()])
    return framed.where(F.col(RANGE) == F.col(_TARGET)).drop(RANGE, RANK, _TARGET, _LOW, _HIGH)
