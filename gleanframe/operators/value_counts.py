"""The value-count table of a column: the one shuffle its profile shares.

Partial aggregation collapses repeated values before the shuffle, so a value that fills a third of
the rows still arrives as one row per input task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """``(v, n)``: rows per value, nulls as one group of their own."""
    return df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, rows: int) -> DataFrame:
    """The most frequent values: count descending, then value ascending (a per-partition top-k)."""
    return counts.orderBy(F.desc("n"), F.asc("v")).limit(rows)



#: Characters of a text that travel with its digest, to put equal scores in order.
PREFIX = 32


def digest(text: Column) -> Column:
    """16 bytes that stand for a text where texts are counted."""
    return F.unhex(F.md5(text.cast("binary")))


def top_texts(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """``(v, score)`` of the ``k`` texts ``v`` with the highest score, ties by text; no text without a chance is shuffled.

    ``score`` aggregates the rows of a text. Digests with the beginning of their text decide who may be among
    the first: all up to the k-th place and those that tie with it so far. Only their texts are fetched.
    """
    text = digest(F.col("v"))
    groups = rows.groupBy(text.alias("d")).agg(score.alias("score"), F.min(F.substring("v", 1, PREFIX)).alias("p"))
    last = groups.orderBy(F.desc("score"), "p").limit(k).agg(F.max(F.struct((-F.col("score")).alias("s"), "p"))).scalar()
    behind = -F.col("score")
    able = groups.select("d", "score", "p", last.alias("last")).where(
        (behind < F.col("last.s")) | ((behind == F.col("last.s")) & (F.col("p") <= F.col("last.p")))
    )
    fetched = rows.select(text.alias("d"), "v").join(able.select("d", "score"), "d")
    return fetched.groupBy("d", "score").agg(F.any_value("v").alias("v")).orderBy(F.desc("score"), "v").limit(k).select("v", "score")
