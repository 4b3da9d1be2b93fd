"""Column references, display text and round-trip text for keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def col(name: str) -> Column:
    """A column by its literal name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(c: Column, data_type: T.DataType) -> Column:
    """Text of a column that is profiled, filtered or sorted as a string."""
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def comparable(c: Column, data_type: T.DataType) -> Column:
    """The column itself where Spark can order it as a scalar, else its text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return as_text(c, data_type) if isinstance(data_type, nested) else c


def comparable_type(data_type: T.DataType) -> T.DataType:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return T.StringType() if isinstance(data_type, nested) else data_type


def _double_text(c: Column) -> Column:
    # Spark writes 1.0E7 where plain notation is expected up to 1e16 and from 1e-4.
    size = F.abs(c)
    trim_zeros = lambda d: F.regexp_replace(
        F.regexp_replace(d.cast("string"), "0+$", ""), r"\.$", ".0"
    )
    sci = F.regexp_replace(c.cast("string"), r"\.0E", "E")
    sci = F.regexp_replace(sci, r"E(\d)$", "E0$1")
    sci = F.regexp_replace(sci, r"E-(\d)$", "E-0$1")
    sci = F.lower(F.regexp_replace(sci, r"E(\d)", "E+$1"))
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((c == 0) | ((size >= 1e-3) & (size < 1e7)), c.cast("string"))
        .when((size >= 1e7) & (size < 1e16), trim_zeros(c.try_cast("decimal(38,12)")))
        .when((size >= 1e-4) & (size < 1e-3), trim_zeros(c.try_cast("decimal(38,25)")))
        .otherwise(sci)
    )


def _timestamp_text(c: Column) -> Column:
    text = c.cast("string")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    return F.when(fraction == "", text).otherwise(
        F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(fraction, 6, "0"))
    )


def display_text(c: Column, data_type: T.DataType) -> Column:
    """The text shown for a value: plain decimals, ``YYYY-MM-DD HH:MM:SS`` times."""
    if isinstance(data_type, T.DoubleType):
        return _double_text(c)
    if isinstance(data_type, T.FloatType):
        # through text, so that 0.1 stays 0.1 and does not widen to 0.10000000149011612
        return _double_text(c.cast("string").cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp_text(c)
    return as_text(c, data_type)


def key_text(c: Column, data_type: T.DataType) -> Column:
    """Text from which :func:`key_literal` rebuilds exactly the same value."""
    return F.base64(c) if isinstance(data_type, T.BinaryType) else c.cast("string")


def key_literal(text: str, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BinaryType):
        return F.unbase64(F.lit(text))
    return F.lit(text).cast(data_type)
