"""Value suggestions for filter inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.apptypes import field_map
from gleanframe.functions.columns import as_text, col, display_text
from gleanframe.operators.substrings import SubstringIndex

DEFAULT_LIMIT, MAX_LIMIT = 10, 100


def suggest_values(
    df: DataFrame, column: str, query: str | None = None, limit: int = DEFAULT_LIMIT, index: SubstringIndex | None = None
) -> DataFrame:
    """``(value, count)``: frequent values as text, optionally those containing ``query``.

    The text is matched before grouping, so only matching values are shuffled. With an ``index`` of the column
    (:func:`suggestion_index`) only the values that may match are read.
    """
    fields = field_map(df)
    if column not in fields:
        raise ValueError(f"Invalid filter column: {column}")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    needle = (query or "").strip()
    if index is not None and index.column != column:
        raise ValueError(f"the index is one of column {index.column}")
    if index is not None and needle:
        return index.suggest(needle, limit)
    rows = df.select(_text(df, column).alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    if needle:
        rows = rows.where(F.contains(F.lower("value"), F.lower(F.lit(needle))))
    return (
        rows.groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(limit)
    )


def _text(df: DataFrame, column: str) -> Column:
    data_type = field_map(df)[column].dataType
    moment = isinstance(data_type, (T.TimestampType, T.TimestampNTZType))
    text = as_text if moment else display_text  # the plain cast, without padded fractions
    return text(col(column), data_type)


def suggestion_index(df: DataFrame, column: str) -> SubstringIndex:
    """The substring index of a column's values as they are suggested."""
    if column not in field_map(df):
        raise ValueError(f"Invalid filter column: {column}")
    return SubstringIndex.build(df, column, _text(df, column))
