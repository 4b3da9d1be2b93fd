"""CSV and Parquet scans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleanframe.functions.columns import col
from gleanframe.sources.records import recut

# Fixed value: the only timestamp text inferred as a timestamp, so that a bare time stays text.
TIMESTAMP_FORMAT = "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS][.SSS]"
# What may separate fields, and how a day may be written, in the order they are tried.
DELIMITERS = (",", ";", "\t", "|")
DATE_FORMATS = ("dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd")


@dataclass(frozen=True)
class Dialect:
    """How a CSV input is written."""

    delimiter: str = ","
    quote: str = '"'
    multiline: bool = False
    date_format: str | None = None
    timestamp_format: str = TIMESTAMP_FORMAT


def _outside(line: Column, delimiter: str, quote: str) -> Column:
    """The line without its whole quoted fields. Doubled quotes go first: they open and close nothing."""
    d, q = re.escape(delimiter), re.escape(quote)
    plain = F.replace(line, F.lit(quote * 2), F.lit(""))
    rest = F.regexp_replace(plain, f"(?<=^|{d}){q}[^{q}]*{q}(?=$|{d})", "")
    return F.when(F.contains(line, F.lit(quote)), rest).otherwise(line)


def detect(spark: SparkSession, path: str, quote: str = '"', delimiter: str | None = None) -> Dialect:
    """Delimiter and line breaks of an input, from one aggregate over its lines.

    The delimiter is the one that most lines have in the same number, more than none. A line on which a
    quoted field stays open shows that fields span lines.
    """
    line, tried = F.col("value"), (delimiter,) if delimiter else DELIMITERS
    facts = []
    for i, d in enumerate(tried):
        rest = _outside(line, d, quote)
        count = F.length(rest) - F.length(F.replace(rest, F.lit(d), F.lit("")))
        q = re.escape(quote)
        facts += [
            F.coalesce(F.mode(count), F.lit(0)).alias(f"usual{i}"),
            F.coalesce(F.bool_or(F.contains(line, F.lit(quote)) & rest.rlike(f"(^|{re.escape(d)}){q}")), F.lit(False)).alias(f"open{i}"),
        ]
    found = spark.read.text(path).where(F.length("value") > 0).agg(*facts).first()
    best = max(range(len(tried)), key=lambda i: (found[f"usual{i}"] > 0, found[f"usual{i}"], -i))
    return Dialect(tried[best], quote, found[f"open{best}"])


def _days(df: DataFrame) -> DataFrame:
    """Text columns that hold days in one known form as dates, after one pass over them.

    Where days first and months first both fit, nothing tells which is meant, and the column stays text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    read = lambda name, form: F.try_to_timestamp(col(name), F.lit(form)).cast("date")
    shaped = lambda name: col(name).rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}$")
    facts = [
        F.count_if(col(n).isNotNull() & F.when(shaped(n), read(n, form).isNull()).otherwise(True)).alias(f"{i} {k}")
        for i, n in enumerate(texts)
        for k, form in enumerate(DATE_FORMATS)
    ]
    found = df.agg(*facts, *[F.count(col(n)).alias(f"n {i}") for i, n in enumerate(texts)]).first()
    form_of = {}
    for i, name in enumerate(texts):
        fits = [form for k, form in enumerate(DATE_FORMATS) if found[f"{i} {k}"] == 0]
        if len(fits) == 1 and found[f"n {i}"]:
            form_of[name] = fits[0]
    return df.withColumns({n: F.to_date(col(n), form) for n, form in form_of.items()}) if form_of else df


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool | None = None,
    delimiter: str | None = None,
    quote: str = '"',
    date_format: str | None = None,
    timestamp_format: str | None = None,
) -> DataFrame:
    """Delimited text with a header row; empty fields are null.

    What is not given is found out: the delimiter and line breaks in quoted fields by one pass over the lines,
    types by another, days that are not written the ISO way by a third over the text columns. With
    ``schema``, ``delimiter`` and ``multiline`` the input is read once. A value that does not fit its type
    fails the read instead of turning into null.

    Files are split over tasks. Where quoted fields hold line breaks, the records are cut first by tasks in
    parallel and stored in the shared folder (:mod:`gleanframe.sources.records`).
    """
    if multiline is None or delimiter is None:
        found = detect(spark, path, quote, delimiter)
        delimiter, multiline = found.delimiter, found.multiline if multiline is None else multiline
    reader = spark.read.option("header", not multiline)
    names = None
    if multiline:
        path, separator, names = recut(spark, path, delimiter, quote)
        reader = reader.option("lineSep", separator).option("recursiveFileLookup", True)
    reader = (
        reader.option("sep", delimiter)
        .option("quote", quote)
        .option("escape", quote)
        .option("mode", "FAILFAST")
        .option("timestampFormat", timestamp_format or TIMESTAMP_FORMAT)
    )
    if date_format is not None:
        reader = reader.option("dateFormat", date_format)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    if names is not None:
        df = df.toDF(*names) if df.columns else spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    # CSV timestamps carry no zone
    moments = {
        f.name: col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)
    }
    df = df.withColumns(moments) if moments else df
    return df if date_format is not None else _days(df)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Every column of a Parquet file or folder; filters and column choices reach the scan."""
    return spark.read.parquet(path)
