"""Datasets: discover what a path holds, load it with a row identity, register, import, export."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gleanframe.apptypes import ROWID, app_type, visible_fields
from gleanframe.functions.columns import col, comparable, display_text
from gleanframe.operators.overview import schema_overview
from gleanframe.plans.filters import apply_filters
from gleanframe.session import shared_folder
from gleanframe.sources.sqlite import discover_sqlite, scan_sqlite
from gleanframe.sources.records import count_records
from gleanframe.sources.tabular import detect, scan_csv, scan_parquet
from gleanframe.sources.workbook import discover_workbook, scan_workbook

# File suffixes and the formats they stand for.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".xlsx": "excel", ".sqlite": "sqlite", ".db": "sqlite"}
ENTITY_FORMATS = ("excel", "sqlite")


def format_of(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/*")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported file format: {suffix}")
    return FORMATS[suffix]


#: By session and view, the dataset that made it.
_names: dict[tuple[int, str], str] = {}


@dataclass(frozen=True)
class Dataset:
    """A loaded table: Parquet files with ``_rowid``, known to SQL under ``view``."""

    name: str
    source_type: str
    path: str
    frame: DataFrame
    row_count: int

    @property
    def columns(self) -> dict[str, str]:
        return {f.name: app_type(f.dataType) for f in visible_fields(self.frame)}

    @property
    def view(self) -> str:
        """The name as an SQL identifier: ``sales.csv`` is the view ``sales_csv``."""
        return re.sub(r"\W", "_", self.name)

    def overview(self) -> DataFrame:
        """Type, nulls, distinct values and sparkline of every column."""
        return schema_overview(self.frame)

    def register(self) -> "Dataset":
        """Make the view. Two names that differ only in signs would share one, so that is refused."""
        spark = self.frame.sparkSession
        held = _names.get((id(spark), self.view), self.name)
        if held != self.name and spark.catalog.tableExists(self.view):
            raise ValueError(f"Dataset '{self.name}' would replace the view of '{held}'")
        _names[id(spark), self.view] = self.name
        self.frame.drop(ROWID).createOrReplaceTempView(self.view)
        return self

    def remove(self) -> None:
        """Forget the view and any cached data; files stay."""
        self.frame.unpersist()
        self.frame.sparkSession.catalog.dropTempView(self.view)


#: Bits of a row id below the rank of its file: a file may have so many bytes, or rows.
FILE_BITS = 42


def _place(df: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with their place: rank of the file by name, then the place in the file.

    Parquet knows the row's number. Of a text file the start of the read block is known, and rows
    follow each other in it; a row takes a byte at least, so start plus position stays below the next
    block. A frame that is no plain scan has its rows in the order in which Spark deals them out.
    """
    scanned = F.monotonically_increasing_id()
    try:
        located = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        return df, scanned
    # One row for each file, and for each block: broadcast, since a shuffle would deal all rows of a file to one task.
    files = located.select("_file").distinct()
    ranks = files.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("bigint").alias("_rank"))
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        inside = F.col("_at")
    except AnalysisException:
        numbered = located.withColumn("_at", scanned)
        first = numbered.groupBy("_file", "_block").agg(F.min("_at").alias("_first"))
        rows = numbered.join(F.broadcast(first), ["_file", "_block"])
        inside = F.col("_block") + F.col("_at") - F.col("_first")
    return rows.join(F.broadcast(ranks), "_file"), F.shiftleft("_rank", FILE_BITS) + inside


def with_rowid(df: DataFrame, folder: str) -> DataFrame:
    """Write the rows with a stable ``_rowid`` that follows the order of the source, and read them back.

    Files come in the order of their names, rows in the order of their file. The id is frozen by the
    write: later reads, retries and lost executors all see the same ids, and Parquet statistics prune
    a page's range of them.
    """
    if ROWID in df.columns:
        raise ValueError(f"a column is already named {ROWID}")
    rows, place = _place(df)
    rows.select(place.alias(ROWID), *[col(c) for c in df.columns]).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def scan(
    spark: SparkSession, path: str, file_format: str | None = None, entity: str | None = None, schema=None, **csv: Any
) -> DataFrame:
    """Read a source without materialising it. ``csv`` are options of :func:`scan_csv`."""
    file_format = file_format or format_of(path)
    if file_format == "csv":
        return scan_csv(spark, path, schema, **csv)
    if file_format == "parquet":
        return scan_parquet(spark, path)
    if file_format == "excel":
        return scan_workbook(spark, path, entity)
    if file_format == "sqlite":
        return scan_sqlite(spark, path, entity)
    raise ValueError(f"Unsupported file format: {file_format}")


def load(
    spark: SparkSession,
    path: str,
    name: str,
    file_format: str | None = None,
    entity: str | None = None,
    schema: T.StructType | str | None = None,
    store: str | None = None,
    **csv: Any,
) -> Dataset:
    """Load a source once into Parquet with row identity and register it as ``name``."""
    file_format = file_format or format_of(path)
    rows = scan(spark, path, file_format, entity, schema, **csv)
    frame = with_rowid(rows, store or shared_folder(spark, "dataset"))
    return Dataset(name, "file", path, frame, frame.count()).register()


def discover(spark: SparkSession, path: str, file_format: str | None = None, **csv: Any) -> DataFrame:
    """``(path, name, kind, row_count)`` of everything that can be imported from a path.

    Records of a CSV input are counted without reading fields; one may span lines.
    """
    file_format = file_format or format_of(path)
    if file_format == "excel":
        return discover_workbook(spark, path)
    if file_format == "sqlite":
        return discover_sqlite(spark, path)
    if file_format == "csv":
        found = detect(spark, path, csv.get("quote", '"'), csv.get("delimiter"))
        if csv.get("multiline", found.multiline):
            rows = spark.range(count_records(spark, path, found.delimiter, found.quote))
        else:
            # One text column: the header gives the count of rows, the fields do not matter.
            rows = spark.read.option("header", True).schema("line string").csv(path)
    else:
        rows = scan(spark, path, file_format)
    return rows.agg(
        F.lit(path).alias("path"),
        F.lit("data").alias("name"),
        F.lit("dataset").alias("kind"),
        F.count(F.lit(1)).alias("row_count"),
    )


def import_entities(
    spark: SparkSession,
    path: str,
    entities: Sequence[str] = (),
    mode: str = "selected",
    naming: str = "filename_entity",
    file_format: str | None = None,
) -> list[Dataset]:
    """Load the chosen sheets or tables of a source (or its only table), one dataset each."""
    if mode not in ("selected", "all"):
        raise ValueError(f"Unsupported import mode: {mode}")
    if naming not in ("filename_entity", "entity_only"):
        raise ValueError(f"Unsupported naming: {naming}")
    file_format = file_format or format_of(path)
    file_name = PurePosixPath(path.rstrip("/")).name
    if file_format not in ENTITY_FORMATS:
        return [load(spark, path, file_name, file_format)]
    found = discover(spark, path, file_format).select("name").distinct().orderBy("name")
    available = [row["name"] for row in found.collect()]
    chosen = available if mode == "all" else list(entities)
    if not chosen:
        raise ValueError("No entities selected for import")
    unknown = [e for e in chosen if e not in available]
    if unknown:
        raise ValueError(f"Unknown entities selected: {', '.join(unknown)}")
    stem = PurePosixPath(file_name).stem
    name = {e: e if naming == "entity_only" else f"{stem}_{e}" for e in chosen}
    return [load(spark, path, name[e], file_format, e) for e in chosen]


def _csv_text(f: T.StructField) -> Column:
    c = col(f.name)
    if isinstance(f.dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False").alias(f.name)
    return display_text(c, f.dataType).alias(f.name)


def export_csv(
    df: DataFrame,
    folder: str,
    filters: Any = (),
    sort: str | None = None,
    direction: str = "asc",
) -> None:
    """Write all columns of the filtered rows as CSV part files with headers, in sort order.

    The sort is a range shuffle on the sort column and the row id, so equal sort values spread
    over tasks; part files in name order hold the whole order. Unsorted rows come in the order of their ids: where
    the stored ranges of a loaded table are read, each task's rows are a range, so nothing is shuffled and the
    files are named by their range. Nulls are empty.
    """
    fields = {f.name: f for f in visible_fields(df)}
    if sort is not None and sort not in fields:
        raise ValueError(f"Invalid sort column: {sort}")
    rows = apply_filters(df, filters)
    descending = direction == "desc" and sort is not None
    order: list[Column] = []
    if sort is not None:
        key = comparable(col(sort), fields[sort].dataType)
        order.append(key.desc_nulls_last() if descending else key.asc_nulls_last())
    if ROWID in df.columns:
        order.append(F.desc(ROWID) if descending else F.asc(ROWID))
    spans = _spans(rows) if sort is None and order else None
    if spans is not None:
        rows = rows.sortWithinPartitions(ROWID)
    elif order:
        rows = rows.orderBy(*order)
    (
        rows.select(*[_csv_text(f) for f in fields.values()])
        .write.option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    if spans is not None and spans != sorted(spans):
        _name_by_rank(df.sparkSession, folder, spans)


def _spans(rows: DataFrame) -> list[int] | None:
    """Numbers of the tasks in the order of their row ids, if each task's ids are a range of their own."""
    task = F.spark_partition_id().alias("task")
    ends = rows.select(task, ROWID).groupBy("task").agg(F.min(ROWID).alias("low"), F.max(ROWID).alias("high"))
    found = sorted(ends.collect(), key=lambda r: r.low)
    if any(a.high >= b.low for a, b in zip(found, found[1:])):
        return None
    return [r.task for r in found]


def _name_by_rank(spark: SparkSession, folder: str, spans: list[int]) -> None:
    """Rename part files, which bear the number of their task, so that their names are in the order of ``spans``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rank = {task: i for i, task in enumerate(spans)}
    for status in files.listStatus(path):
        name = status.getPath().getName()
        part = re.match(r"part-(\d+)-(.*)", name)
        if part:
            place = rank.get(int(part[1]), len(spans) + int(part[1]))
            files.rename(status.getPath(), path.suffix(f"/part-r{place:08d}-{part[2]}"))
