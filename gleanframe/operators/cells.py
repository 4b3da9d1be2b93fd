"""Free-form cells: SQL text and Python functions over a dataset."""

from __future__ import annotations

import io
import sys
import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import redirect_stdout
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from gleanframe.apptypes import ROWID, visible_fields
from gleanframe.functions.columns import col, display_text
from gleanframe.functions.numbers import finite

DATA_VIEW = "data"
PREVIEW_ROWS = 1000
_views = threading.Lock()


def run_sql(df: DataFrame, text: str, datasets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL with ``df`` as the view ``data`` and other datasets under their names.

    The views exist only while the statement is analysed; the returned frame is lazy and unbounded.
    Temporary views of the same names come back afterwards; tables of the catalog are only hidden
    meanwhile. A statement without a result gives a frame without columns.
    """
    if not text.strip():
        raise ValueError("SQL query is empty")
    spark = df.sparkSession
    views = {**(datasets or {}), DATA_VIEW: df}
    with _views:
        temporary = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
        hidden = {n: spark.table(n) for n in views if n.lower() in temporary}
        for name, frame in views.items():
            frame.drop(ROWID).createOrReplaceTempView(name)
        try:
            return spark.sql(text)
        finally:
            for name in views:
                spark.catalog.dropTempView(name)
                if name in hidden:
                    hidden[name].createOrReplaceTempView(name)


def transform(df: DataFrame, fn: Callable[[DataFrame], Any]) -> DataFrame:
    """Apply a Python function over Spark frames: the result as a frame.

    A frame stays a frame, a column becomes a one-column frame ``value``, anything else one row of
    text in ``text_output``: what the function printed, then its result.
    """
    source, printed = df.drop(ROWID), io.StringIO()
    with redirect_stdout(printed):
        result = fn(source)
    if isinstance(result, (DataFrame, Column)):
        sys.stdout.write(printed.getvalue())
        return result if isinstance(result, DataFrame) else source.select(result.alias("value"))
    parts = [printed.getvalue().strip(), "" if result is None else str(result)]
    text = "\n".join(p for p in parts if p)
    return df.sparkSession.range(1).select(F.lit(text).alias("text_output"))


def transform_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply pandas code batch by batch inside the tasks; no partition is held whole."""
    return df.drop(ROWID).mapInPandas(fn, schema)


def transform_groups(
    df: DataFrame,
    by: list[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply pandas code to each group of equal ``by`` columns; nulls form a group.

    One task holds a whole group as a pandas frame, so this is for keys whose groups fit there; for
    others aggregate first, or use :func:`transform_batches`.
    """
    missing = [c for c in by if c not in df.columns]
    if missing or not by:
        raise ValueError(f"Invalid group column: {', '.join(missing) or 'none given'}")
    return df.drop(ROWID).groupBy(*[col(c) for c in by]).applyInPandas(fn, schema)


_FLOATS = (T.FloatType, T.DoubleType)
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _shown(f: T.StructField, python: bool) -> Column:
    c = col(f.name)
    if isinstance(f.dataType, _FLOATS):
        return finite(c).alias(f.name) if python else c
    if isinstance(f.dataType, _PLAIN):
        return c
    text = display_text(c, f.dataType)
    if python and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.replace(text, F.lit(" "), F.lit("T"))
    return text.alias(f.name)


def display(df: DataFrame, python: bool = False) -> DataFrame:
    """The columns as shown: numbers, text and booleans as they are, everything else as text.

    ``python`` shows the results of Python cells: NaN and infinities as null, ISO timestamps.
    """
    return df.select(*[_shown(f, python) for f in visible_fields(df)])


@dataclass(frozen=True)
class Preview:
    columns: list[str]
    rows: list[Row]
    row_count: int


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, python: bool = False) -> Preview:
    """The first rows on the driver (at most ``rows``) and the full row count."""
    shown = display(df, python)
    return Preview(shown.columns, shown.limit(rows).collect(), df.count())
