"""Sums of floating-point numbers that do not depend on the order of the rows.

A double is a whole number times a power of two. Values are put into bins of 32 binary orders of magnitude,
67 at most; in each the whole and the broken part are summed as exact numbers, which partial aggregation
may do in any order. The bins are added as fractions and rounded once.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values of the double format: orders of magnitude in a bin, bits of a fraction, the outer bins.
BIN, BITS = 32, 53
LOWEST, HIGHEST = -34, 32


def exact_sum(values: DataFrame) -> tuple[int, Fraction | float]:
    """Number and sum of the rows of ``(v, n)``, value and times it occurs; NaN or an infinity where the sum is that.

    One aggregate of a row per bin.
    """
    data_type = values.schema["v"].dataType
    n, v = F.col("n").cast("decimal(19,0)"), F.col("v")
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        total = values.agg(F.sum("n").alias("rows"), F.sum(v.cast("decimal(38,0)") * n if _whole(data_type) else v * n).alias("total")).first()
        return total.rows or 0, Fraction(total.total or 0)
    x = v.cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    order = F.floor(F.log2(F.abs("x")) / BIN).cast("int")
    bin_ = F.when(F.col("x") == 0, 0).otherwise(F.greatest(F.lit(LOWEST), F.least(order, F.lit(HIGHEST))))
    # two halves of the power, since the whole one is beyond a double for the outer bins
    half = F.element_at(F.array(*[F.lit(2.0 ** (-BIN // 2 * k)) for k in range(LOWEST, HIGHEST + 1)]), F.col("bin") - LOWEST + 1)
    split = values.select(finite.alias("x"), F.when(finite.isNull(), x).alias("beyond"), n.alias("n"))
    scaled = split.select("*", F.when(F.col("x").isNotNull(), bin_).alias("bin")).withColumn("y", F.col("x") * half * half)
    whole = F.col("y").cast("bigint")
    broken = ((F.col("y") - whole) * 2.0**BITS).cast("bigint")
    sums = scaled.groupBy("bin").agg(
        F.sum("n").alias("rows"),
        F.sum(whole.cast("decimal(19,0)") * F.col("n")).alias("whole"),
        F.sum(broken.cast("decimal(19,0)") * F.col("n")).alias("broken"),
        F.sum("beyond").alias("beyond"),
    )
    rows, total, beyond = 0, Fraction(0), None
    for r in sums.collect():
        rows += int(r.rows)
        if r.bin is None:
            beyond = r.beyond
        else:
            total += (Fraction(int(r.whole)) + Fraction(int(r.broken), 1 << BITS)) * Fraction(2) ** (BIN * r.bin)
    return rows, total if beyond is None else beyond


def _whole(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def rounded(total: Fraction | float) -> float:
    """The nearest double; an infinity beyond the largest."""
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def exact_mean(rows: int, total: Fraction | float) -> float | None:
    if not rows:
        return None
    return rounded(total / rows)
