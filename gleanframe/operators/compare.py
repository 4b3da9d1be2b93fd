"""Two table queries side by side."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.functions.numbers import round_to
from gleanframe.operators.table_query import table_query


@dataclass(frozen=True)
class Comparison:
    left: DataFrame
    right: DataFrame
    delta: DataFrame


def _delta(left: Column, right: Column) -> tuple[Column, Column]:
    diff = left - right
    ratio = F.try_divide(diff.cast("double"), right.cast("double")) * F.lit(100.0)
    return diff, round_to(ratio, 1)


def compare(
    left: DataFrame,
    left_spec: Mapping[str, Any],
    right: DataFrame,
    right_spec: Mapping[str, Any],
) -> Comparison:
    """Run two specs (on two tables or one) and compare the shapes of their results.

    ``delta`` is one row: row and column counts of both sides, their difference, the difference in
    percent of the right side (null when that is 0), and each shape as ``rows x columns``.
    """
    results, problems = [], []
    for df, spec in ((left, left_spec), (right, right_spec)):
        try:
            results.append(table_query(df, spec))
        except ValueError as exc:
            problems.append(str(exc))
    if problems:
        raise ValueError(" | ".join(problems))
    one, two = results
    count = F.count(F.lit(1))
    shapes = one.agg(count.alias("left_rows")).select(
        "left_rows",
        two.agg(count).scalar().alias("right_rows"),
        F.lit(len(one.columns)).cast("bigint").alias("left_columns"),
        F.lit(len(two.columns)).cast("bigint").alias("right_columns"),
    )
    rows, rows_pct = _delta(F.col("left_rows"), F.col("right_rows"))
    cols, cols_pct = _delta(F.col("left_columns"), F.col("right_columns"))
    shape = lambda side: F.concat_ws("x", f"{side}_rows", f"{side}_columns")
    delta = shapes.select(
        "*",
        rows.alias("rows_delta"),
        rows_pct.alias("rows_delta_pct"),
        cols.alias("columns_delta"),
        cols_pct.alias("columns_delta_pct"),
        shape("left").alias("left_shape"),
        shape("right").alias("right_shape"),
    )
    return Comparison(one, two, delta)
