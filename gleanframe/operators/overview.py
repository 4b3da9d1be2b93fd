"""Schema overview: type, null and distinct counts, and a sparkline per column.

Rows and nulls of all columns are counted in one pass without a shuffle. Distinct values are counted exactly, each
column in a small plan over only its own Parquet column, texts by digest: no text is shuffled and no row is
expanded once per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.apptypes import ROWID, app_type, field_map
from gleanframe.functions.columns import col, comparable, comparable_type
from gleanframe.functions.numbers import share
from gleanframe.operators.ranks import sample_rows
from gleanframe.operators.value_counts import digest, value_counts

# Bins of a sparkline and the null-rate bands.
BINS = 8
NULL_ERROR_PCT, NULL_WARNING_PCT = 25, 5


def _chosen(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    fields = field_map(df)
    for name in columns or ():
        if name not in fields:
            raise ValueError(f"Column not found: {name}")
    chosen = [fields[c] for c in columns] if columns is not None else list(fields.values())
    if not chosen:
        raise ValueError("no columns to describe")
    return list(enumerate(chosen))


def column_types(df: DataFrame) -> dict[str, str]:
    """Application type of every visible column."""
    return {name: app_type(f.dataType) for name, f in field_map(df).items()}


def _banded(rows: DataFrame) -> DataFrame:
    null_pct = share(F.col("null_count"), F.col("total_count"))
    band = (
        F.when(null_pct >= NULL_ERROR_PCT, "error")
        .when(null_pct >= NULL_WARNING_PCT, "warning")
        .otherwise("normal")
    )
    return rows.select("*", null_pct.alias("null_pct"), band.alias("null_band"))


def _present(df: DataFrame, f: T.StructField) -> DataFrame:
    """Value counts of a column without nulls: shared by its distinct count and its sparkline. Texts stand as digests."""
    c = comparable(col(f.name), f.dataType)
    return value_counts(df.where(col(f.name).isNotNull()), digest(c) if isinstance(comparable_type(f.dataType), (T.StringType, T.BinaryType)) else c)


def _named(i: int, f: T.StructField, *facts: Column) -> Column:
    return F.struct(
        F.lit(i).alias("position"),
        F.lit(f.name).alias("column"),
        F.lit(app_type(f.dataType)).alias("type"),
        *facts,
    )


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One row per struct. Every fact in it is a scalar subquery over its own column alone."""
    one = df.sparkSession.range(1).select(F.array(*structs).alias("columns"))
    return one.select(F.inline_outer("columns"))


def _nulls(df: DataFrame, chosen: list[tuple[int, T.StructField]]) -> Column:
    """Rows of the table, and nulls of each column as an array."""
    nulls = F.array(*[F.count_if(col(f.name).isNull()) for _, f in chosen])
    return df.agg(F.struct(F.count(F.lit(1)).alias("total"), nulls.alias("nulls"))).scalar()


def _distinct(df: DataFrame, f: T.StructField) -> Column:
    return _present(df, f).agg(F.count("v")).scalar().alias("unique_count")


def _described(rows: DataFrame, nulls: Column) -> DataFrame:
    """Rows of (position, column, type, unique_count, more) with the counts of rows and nulls."""
    counted = rows.select("*", nulls.alias("counts"))
    return _banded(
        counted.select(
            "position", "column", "type", F.col("counts.total").alias("total_count"),
            F.get(F.col("counts.nulls"), F.col("position")).alias("null_count"), "unique_count", *rows.columns[4:],
        )
    )


def overview(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """One row per column: ``position, column, type, total_count, null_count, unique_count,
    null_pct, null_band``.

    ``approximate`` estimates the distinct counts in one pass without any shuffle of values.
    """
    chosen = _chosen(df, columns)
    if approximate:
        return _banded(_approximate(df, chosen))
    return _described(_rows(df, [_named(i, f, _distinct(df, f)) for i, f in chosen]), _nulls(df, chosen))


def _approximate(df: DataFrame, chosen: list[tuple[int, T.StructField]]) -> DataFrame:
    cells = []
    for i, f in chosen:
        c = comparable(col(f.name), f.dataType)
        cells.append(
            _named(
                i,
                f,
                F.count(F.lit(1)).alias("total_count"),
                F.count_if(c.isNull()).alias("null_count"),
                F.approx_count_distinct(c, 0.02).alias("unique_count"),
            )
        )
    return df.agg(F.inline(F.array(*cells)))


def _epoch_seconds(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("double") * 86400.0
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    # a timestamp without a zone, counted as it reads on the clock
    minutes = F.unix_date(F.to_date(c)).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
    micros = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return (minutes * 60_000_000 + micros) / F.lit(1e6)


def _number(c: Column, data_type: T.DataType) -> Column:
    if app_type(data_type) == "date":
        return _epoch_seconds(c, data_type)
    return c.cast("double")


def _numeric_bars(df: DataFrame, f: T.StructField) -> Column:
    """Counts per distinct value when at most 8, else counts of 8 equal-width bins.

    The bins are conditional counts of the rows, and a column is known to have more than 8 values
    without a shuffle: k distinct values set at most k registers of the estimate, which therefore
    cannot exceed k. Only columns with an estimate of at most 8 have their values counted.
    NaN and infinities are left out.
    """
    x = _number(col(f.name), f.dataType)
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = df.where(finite).select(x.alias("x"))
    bounds = kept.agg(
        F.struct(
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.approx_count_distinct("x").alias("values"),
        )
    ).scalar()
    low, high = F.col("b.lo"), F.col("b.hi")
    at = F.least(F.floor((F.col("x") - low) / ((high - low) / BINS)).cast("int"), F.lit(BINS - 1))
    placed = kept.select("x", bounds.alias("b")).select(F.when(low < high, at).alias("at"))
    tally = F.array(*[F.count_if(F.col("at") == i) for i in range(BINS)])
    bins = placed.agg(F.when(F.count("at") > 0, tally)).scalar()

    candidates = df.where(bounds["values"] <= BINS)
    counts, number = _present(candidates, f), _number(F.col("v"), f.dataType)
    whole = ~F.isnan(number) & (F.abs(number) < float("inf"))
    smallest = counts.where(F.when(F.col("n") > 0, whole)).orderBy("v").limit(BINS + 1)
    few = smallest.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("a")).select(
        F.when(F.size("a").between(1, BINS), F.transform("a", lambda s: s["n"]))
    )
    return F.coalesce(few.scalar(), bins)


def _text_bars(df: DataFrame, f: T.StructField) -> Column:
    """Counts in key order when there are at most 8 values, else the 8 largest counts.

    The largest counts need no texts. Texts are put in order only where an estimate, which cannot
    exceed so few, says that there are at most 8.
    """
    text = comparable(col(f.name), f.dataType)
    filled = df.where(col(f.name).isNotNull())
    largest = _present(df, f).orderBy(F.desc("n")).limit(BINS).agg(F.sort_array(F.collect_list("n"), asc=False)).scalar()
    estimate = filled.agg(F.approx_count_distinct(text)).scalar()
    counts = value_counts(filled.where(estimate <= BINS), text).orderBy("v").limit(BINS + 1)
    few = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("a")).select(
        F.when(F.size("a").between(1, BINS), F.transform("a", lambda s: s["n"]))
    )
    return F.coalesce(few.scalar(), largest)


def _boolean_bars(df: DataFrame, f: T.StructField) -> Column:
    c = col(f.name)
    pair = F.array(F.count_if(~c), F.count_if(c))
    return df.agg(F.when(F.count(c) > 0, pair)).scalar()


def _bars(df: DataFrame, f: T.StructField) -> Column:
    kind = app_type(f.dataType)
    if kind == "boolean":
        bars = _boolean_bars(df, f)
    elif kind == "string":
        bars = _text_bars(df, f)
    else:
        bars = _numeric_bars(df, f)
    return F.coalesce(bars, F.array().cast("array<bigint>"))


def sparklines(
    df: DataFrame, columns: Sequence[str] | None = None, max_rows: int | None = None
) -> DataFrame:
    """Long form ``(position, column, idx, count)``; a column without values has no rows.

    All rows count by default; ``max_rows`` takes one deterministic sample for all columns.
    """
    chosen = _chosen(df, columns)
    source = _sampled(df, max_rows)
    rows = _rows(df, [_named(i, f, _bars(source, f).alias("bars")) for i, f in chosen])
    # the outer form: for the inner one Spark would copy the subqueries into a filter on the array
    bars = F.posexplode_outer("bars").alias("idx", "count")
    return rows.select("position", "column", bars).where(F.col("idx").isNotNull())


def _sampled(df: DataFrame, max_rows: int | None) -> DataFrame:
    return df if max_rows is None else sample_rows(df, max_rows, ROWID, df.count())


def schema_overview(
    df: DataFrame, columns: Sequence[str] | None = None, max_rows: int | None = None
) -> DataFrame:
    """The overview with each column's sparkline as an array, ``[]`` where nothing can be drawn.

    Without sampling the sparkline reads the same shuffled value counts as the distinct count.
    """
    source, chosen = _sampled(df, max_rows), _chosen(df, columns)
    facts = [_named(i, f, _distinct(df, f), _bars(source, f).alias("sparkline")) for i, f in chosen]
    return _described(_rows(df, facts), _nulls(df, chosen))
