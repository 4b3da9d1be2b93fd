"""Rounding and percentages."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def round_to(x: Column, digits: int) -> Column:
    """Round half away from zero on the double itself; huge values pass unchanged.

    ``F.round`` rounds the decimal text of the double instead, which differs in the last digit.
    """
    scale = float(10**digits)
    scaled = F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / F.lit(scale)
    # above 2**53 / scale a double carries no digit that could be rounded away
    return F.when(F.abs(x) < 2.0**53 / scale, F.signum(x) * scaled).otherwise(x)


def rounded_to(x: float, digits: int) -> float:
    """:func:`round_to` of a finite number on the driver."""
    scale = float(10**digits)
    if abs(x) >= 2.0**53 / scale:
        return x
    return math.copysign(math.floor(abs(x) * scale + 0.5) / scale, x) if x else 0.0


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def share(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` unrounded, 0 for an empty whole."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.when(whole > 0, ratio).otherwise(F.lit(0.0))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_to(share(part, whole), digits)
