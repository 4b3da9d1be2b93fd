"""Structured queries: filter, group, aggregate, having, sort, limit."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.apptypes import ROWID, app_type, field_map
from gleanframe.functions.columns import col, comparable, comparable_type
from gleanframe.operators.ranks import RankIndex
from gleanframe.plans.filters import COMPARISONS, compared, predicate
from gleanframe.plans.table_query import Aggregation, TableQuery
from gleanframe.plans.values import exact_items, exact_test, literal_type

#: Rows that a limit may put in order in one task; more are dealt out by range.
ONE_TASK_ROWS = 10_000


def _aggregate(a: Aggregation, fields: Mapping[str, T.StructField]) -> Column:
    if a.column == "*":
        return F.count(F.lit(1)).alias(a.alias)
    data_type, c = fields[a.column].dataType, col(a.column)
    if a.op == "sum" and app_type(data_type) == "integer":
        # wide enough for any number of 64-bit values; a BIGINT sum would overflow
        c = c.cast("decimal(38,0)")
    elif a.op in ("min", "max"):
        c = comparable(c, data_type)
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.op](c).alias(
        a.alias
    )


def _sort_keys(types: Mapping[str, T.DataType], query: TableQuery) -> list[tuple[str, bool]]:
    """Columns of a total order with their direction, none when the query asks for no order.

    Requested keys come first, then the row identity or else the other columns. A limit needs an
    order too, so that it always cuts the same rows.
    """
    if not query.sort and query.limit is None:
        return []
    named = {s.column: s.descending for s in query.sort}
    ties = [ROWID] if ROWID in types else [n for n in types if n not in named]
    return [*named.items(), *((n, False) for n in ties)]


def _selected(df: DataFrame, query: TableQuery) -> DataFrame:
    """The query without its order and limit."""
    fields = field_map(df)
    condition = predicate(query.filters, fields)
    out = df if condition is None else df.where(condition)
    groups = [col(c) for c in query.group_by]
    if query.aggregations:
        aggregates = [_aggregate(a, fields) for a in query.aggregations]
        out = out.groupBy(*groups).agg(*aggregates) if groups else out.agg(*aggregates)
        types = {f.name: f.dataType for f in out.schema.fields}
        for h in query.having:
            out = out.where(compared(col(h.metric), h.operator, h.value, types[h.metric]))
    elif groups:
        out = out.select(*groups).distinct()
    return out


def table_query(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Run a spec. Raises ``ValueError`` before planning when the spec is invalid.

    Without ``limit`` every row of the result is there. Sort and a small limit together plan as a
    per-partition top-k, so no full sort is shuffled. For a large one the result is stored in ranges of its order:
    those before the cut are read whole, and the one that holds it in part.
    """
    query = TableQuery.check(spec, field_map(df))
    out = _selected(df, query)
    types = {f.name: f.dataType for f in out.schema.fields}
    keys = []
    for name, descending in _sort_keys(types, query):
        c = comparable(col(name), types[name])
        keys.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    if query.limit is not None and query.limit > ONE_TASK_ROWS:
        return RankIndex.build(out, keys).first(query.limit).orderBy(*keys).drop(ROWID)
    if keys:
        out = out.orderBy(*keys)
    return (out if query.limit is None else out.limit(query.limit)).drop(ROWID)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _comparable_sql(text: str, data_type: T.DataType) -> str:
    if isinstance(data_type, T.VariantType):
        return f"to_json({text})"
    return text if comparable_type(data_type) == data_type else f"CAST({text} AS STRING)"


def table_query_sql(df: DataFrame, spec: Mapping[str, Any], table: str = "data") -> tuple[str, dict[str, Any]]:
    """The same query as SQL text with ``:name`` markers and the arguments by name.

    ``spark.sql(text, args)`` over a view of ``df`` named ``table`` gives the rows of
    :func:`table_query`, in the same order and cut at the same row.
    """
    fields = field_map(df)
    query = TableQuery.check(spec, fields)
    result = {f.name: f.dataType for f in _selected(df, query).schema.fields}
    args: dict[str, Any] = {}

    def mark(value: Any, data_type: T.DataType) -> str:
        name = f"v{len(args) + 1}"
        args[name] = value
        target = literal_type(value, data_type)
        return f":{name}" if target is None else f"CAST(:{name} AS {target})"

    def comparison(name: str, operator: str, value: Any, data_type: T.DataType) -> str:
        test = exact_test(operator, value, data_type)
        if test.operator in COMPARISONS:
            return f"{name} {test.operator} {mark(test.value, data_type)}"
        return f"{name} IS NOT NULL" if test.operator == "always" else "FALSE"

    def condition(f) -> str:
        data_type = fields[f.column].dataType
        name = _quoted(f.column)
        if f.operator in ("is_null", "is_not_null"):
            return f"{name} IS {'NOT ' if f.operator == 'is_not_null' else ''}NULL"
        if app_type(data_type) == "string" and not isinstance(data_type, T.StringType):
            name = f"to_json({name})" if isinstance(data_type, T.VariantType) else f"CAST({name} AS STRING)"
        if f.operator in ("in", "not_in"):
            marks = ", ".join(mark(v, data_type) for v in exact_items(f.value, data_type))
            if not marks:
                return "FALSE" if f.operator == "in" else f"{name} IS NOT NULL"
            return f"{name} {'IN' if f.operator == 'in' else 'NOT IN'} ({marks})"
        if f.operator in COMPARISONS:
            return comparison(name, f.operator, f.value, data_type)
        call = {"contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}
        return f"{call[f.operator]}(lower({name}), lower({mark(f.value, data_type)}))"

    def aggregate(a: Aggregation) -> str:
        if a.column == "*":
            return f"count(*) AS {_quoted(a.alias)}"
        target = _quoted(a.column)
        data_type = fields[a.column].dataType
        if a.op == "sum" and app_type(data_type) == "integer":
            target = f"CAST({target} AS DECIMAL(38,0))"
        elif a.op in ("min", "max"):
            target = _comparable_sql(target, data_type)
        return f"{a.op}({target}) AS {_quoted(a.alias)}"

    output = [_quoted(c) for c in query.group_by] + [aggregate(a) for a in query.aggregations]
    text = "SELECT " + (", ".join(output) or ", ".join(_quoted(c) for c in fields))
    text += f" FROM {_quoted(table)}"
    if query.filters:
        text += " WHERE " + " AND ".join(condition(f) for f in query.filters)
    if query.group_by:
        text += f" GROUP BY {', '.join(_quoted(c) for c in query.group_by)}"
    if query.having:
        text += " HAVING " + " AND ".join(
            comparison(_quoted(h.metric), h.operator, h.value, result[h.metric]) for h in query.having
        )
    if keys := _sort_keys(result, query):
        text += " ORDER BY " + ", ".join(
            f"{_comparable_sql(_quoted(n), result[n])} {'DESC' if down else 'ASC'} NULLS LAST" for n, down in keys
        )
    if query.limit is not None:
        args["row_limit"] = query.limit
        text += " LIMIT :row_limit"
    return text, args
