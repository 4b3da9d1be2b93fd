"""The five application types a column can have, and what each one permits."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

ROWID = "_rowid"

# Filter operators per application type.
EQUALITY = ("=", "!=", "in", "not_in", "is_null", "is_not_null")
ORDERING = (">", "<", ">=", "<=")
TEXT_MATCH = ("contains", "starts_with", "ends_with")
OPERATORS = {
    "string": EQUALITY + TEXT_MATCH,
    "integer": EQUALITY + ORDERING,
    "float": EQUALITY + ORDERING,
    "date": EQUALITY + ORDERING,
    "boolean": EQUALITY,
}
HAVING_OPERATORS = ("=", "!=", ">", "<", ">=", "<=")
AGGREGATES = ("count", "sum", "avg", "min", "max")

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Spark reads an unsigned 64-bit Parquet column as this decimal.
_UNSIGNED_64 = T.DecimalType(20, 0)


def app_type(data_type: T.DataType) -> str:
    """Collapse a Spark type to ``string``, ``integer``, ``float``, ``date`` or ``boolean``."""
    if isinstance(data_type, _INTEGERS) or data_type == _UNSIGNED_64:
        return "integer"
    if isinstance(data_type, _FLOATS + (T.DecimalType,)):
        return "float"
    if isinstance(data_type, _DATES):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "string"


def visible_fields(df: DataFrame) -> list[T.StructField]:
    """Fields of ``df`` without the hidden row identity."""
    return [f for f in df.schema.fields if f.name != ROWID]


def field_map(df: DataFrame) -> dict[str, T.StructField]:
    return {f.name: f for f in visible_fields(df)}
