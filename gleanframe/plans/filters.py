"""Filters: ``{column, operator, value}`` dictionaries, AND-ed into one predicate."""

from __future__ import annotations

import operator as op
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.apptypes import OPERATORS, app_type, field_map
from gleanframe.functions.columns import as_text, col
from gleanframe.plans.values import exact_items, exact_test, literal, typed, typed_list

COMPARISONS = {"=": op.eq, "!=": op.ne, ">": op.gt, "<": op.lt, ">=": op.ge, "<=": op.le}


def compared(c: Column, operator: str, value: Any, data_type: T.DataType) -> Column:
    """``c operator value``; null where the column is."""
    test = exact_test(operator, value, data_type)
    if test.operator in COMPARISONS:
        return COMPARISONS[test.operator](c, literal(test.value, data_type))
    return F.when(c.isNotNull(), F.lit(test.operator == "always"))


@dataclass(frozen=True)
class Filter:
    """One checked filter; ``value`` is typed, a tuple for ``in``/``not_in``, None for null tests."""

    column: str
    operator: str
    value: Any = None

    @classmethod
    def check(cls, raw: Mapping[str, Any], fields: Mapping[str, T.StructField]) -> "Filter":
        column, operator = raw.get("column"), raw.get("operator")
        if not isinstance(column, str) or not column:
            raise ValueError("Filter column is required")
        if column not in fields:
            raise ValueError(f"Invalid filter column: {column}")
        if not isinstance(operator, str) or not operator:
            raise ValueError(f"Filter operator is required for column: {column}")
        data_type = fields[column].dataType
        app = app_type(data_type)
        if operator not in OPERATORS[app]:
            raise ValueError(f"Unsupported operator '{operator}' for column '{column}' ({app})")
        if operator in ("is_null", "is_not_null"):
            return cls(column, operator)
        read = typed_list if operator in ("in", "not_in") else typed
        return cls(column, operator, read(raw.get("value"), data_type, column, operator))

    def predicate(self, fields: Mapping[str, T.StructField]) -> Column:
        data_type = fields[self.column].dataType
        c = col(self.column)
        if self.operator == "is_null":
            return c.isNull()
        if self.operator == "is_not_null":
            return c.isNotNull()
        if app_type(data_type) == "string":
            c = as_text(c, data_type)
        if self.operator in ("in", "not_in"):
            items = [literal(v, data_type) for v in exact_items(self.value, data_type)]
            hit = c.isin(items) if items else F.when(c.isNotNull(), F.lit(False))
            return hit if self.operator == "in" else ~hit
        if self.operator in COMPARISONS:
            return compared(c, self.operator, self.value, data_type)
        text, needle = F.lower(c), F.lower(F.lit(self.value))
        return {
            "contains": F.contains,
            "starts_with": F.startswith,
            "ends_with": F.endswith,
        }[self.operator](text, needle)


def check_filters(
    raw: Any, fields: Mapping[str, T.StructField]
) -> tuple[Filter, ...]:
    if raw is None:
        return ()
    if isinstance(raw, (str, Mapping)) or not isinstance(raw, Iterable):
        raise ValueError("filters must be an array of objects")
    items = list(raw)
    if not all(isinstance(f, (Mapping, Filter)) for f in items):
        raise ValueError("filters must be an array of objects")
    return tuple(
        Filter.check(f if isinstance(f, Mapping) else vars(f), fields) for f in items
    )


def predicate(filters: Iterable[Filter], fields: Mapping[str, T.StructField]) -> Column | None:
    """Conjunction of the filters, or None when there are none."""
    parts = [f.predicate(fields) for f in filters]
    return reduce(op.and_, parts) if parts else None


def apply_filters(df: DataFrame, raw: Any) -> DataFrame:
    """Rows of ``df`` that pass every filter."""
    fields = field_map(df)
    condition = predicate(check_filters(raw, fields), fields)
    return df if condition is None else df.where(condition)
