"""Tables of SQLite database files: a file, folder or glob that every executor can open.

One Spark partition reads one row-id range of one file, so a large file is read by many tasks.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_PARTITION = 1_000_000
BATCH_ROWS = 10_000
SUFFIXES = (".sqlite", ".db")

LIST_TABLES = (
    "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' "
    "ESCAPE '\\' ORDER BY name"
)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        names = [os.path.join(path, n) for n in sorted(os.listdir(path))]
        return [n for n in names if n.endswith(SUFFIXES)]
    return sorted(glob.glob(path)) or [path]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _storage(declared: str) -> str:
    """The Arrow-side type of a declared column type, by SQLite's affinity rules."""
    declared = declared.upper()
    if "INT" in declared:
        return "integer"
    if any(word in declared for word in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if "BLOB" in declared:
        return "blob"
    if any(word in declared for word in ("REAL", "FLOA", "DOUB", "DEC", "NUM")):
        return "real"
    return "text"


_SPARK = {
    "integer": T.LongType(),
    "real": T.DoubleType(),
    "text": T.StringType(),
    "blob": T.BinaryType(),
}
_ARROW = {"integer": pa.int64(), "real": pa.float64(), "text": pa.string(), "blob": pa.binary()}
_CONVERT = {
    "integer": lambda v: v,
    "real": float,
    "text": lambda v: v if isinstance(v, str) else str(v),
    "blob": lambda v: v if isinstance(v, bytes) else str(v).encode(),
}


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    connection = _open(path)
    try:
        info = connection.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    finally:
        connection.close()
    return [(row[1], row[2] or "") for row in info]


@dataclass
class RowRange(InputPartition):
    path: str
    first: int | None = None
    last: int | None = None

    def __init__(self, path: str, first: int | None = None, last: int | None = None):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class TableReader(DataSourceReader):
    def __init__(self, options):
        self.table = options["table"]
        self.files = _files(options["path"])
        self.step = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))
        self.columns = next(c for f in self.files if (c := _columns(f, self.table)))

    def partitions(self) -> list[RowRange]:
        return [r for f in self.files if _columns(f, self.table) for r in self._ranges(f)]

    def _ranges(self, path: str) -> list[RowRange]:
        connection = _open(path)
        try:
            ends = connection.execute(
                f"SELECT min(_rowid_), max(_rowid_) FROM {_name(self.table)}"
            ).fetchone()
        except sqlite3.OperationalError:  # a table without row ids
            return [RowRange(path)]
        finally:
            connection.close()
        if ends[0] is None:
            return []
        return [
            RowRange(path, at, min(at + self.step - 1, ends[1]))
            for at in range(ends[0], ends[1] + 1, self.step)
        ]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_name(n) for n, _ in self.columns)
        text, args = f"SELECT {names} FROM {_name(self.table)}", ()
        if partition.first is not None:
            text += " WHERE _rowid_ BETWEEN ? AND ? ORDER BY _rowid_"
            args = (partition.first, partition.last)
        kinds = [_storage(declared) for _, declared in self.columns]
        connection = _open(partition.path)
        try:
            cursor = connection.execute(text, args)
            while block := cursor.fetchmany(BATCH_ROWS):
                arrays = [
                    pa.array(
                        [None if v is None else _CONVERT[kind](v) for v in values], _ARROW[kind]
                    )
                    for kind, values in zip(kinds, zip(*block))
                ]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in self.columns])
        finally:
            connection.close()


class SqliteTables(DataSource):
    """``spark.read.format("sqlite_tables").option("table", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def schema(self) -> T.StructType:
        columns = TableReader(self.options).columns
        return T.StructType([T.StructField(n, _SPARK[_storage(d)]) for n, d in columns])

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(self.options)


def scan_sqlite(
    spark: SparkSession, path: str, table: str | None, rows_per_partition: int = ROWS_PER_PARTITION
) -> DataFrame:
    """One table, over all database files of a folder that have it."""
    if not table:
        raise ValueError("SQLite import requires a table name")
    columns = next((c for f in _files(path) if (c := _columns(f, table))), None)
    if columns is None:
        raise ValueError(f"Table not found: {table}")
    spark.dataSource.register(SqliteTables)
    df = (
        spark.read.format(SqliteTables.name())
        .option("table", table)
        .option("rowsPerPartition", rows_per_partition)
        .load(path)
    )
    moments = {"DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz"}
    cast = {n: moments[d.upper()] for n, d in columns if d.upper() in moments}
    return df.select(
        *[
            F.col(f"`{n}`").cast(cast[n]).alias(n) if n in cast else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def discover_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, kind, row_count)`` per user table; one task counts one file."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                connection = _open(file)
                try:
                    names = [row[0] for row in connection.execute(LIST_TABLES)]
                    sizes = [
                        connection.execute(f"SELECT count(*) FROM {_name(n)}").fetchone()[0]
                        for n in names
                    ]
                finally:
                    connection.close()
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([file] * len(names), pa.string()),
                        "name": pa.array(names, pa.string()),
                        "row_count": pa.array(sizes, pa.int64()),
                    }
                )

    files = _files(path)
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))
    found = listed.mapInArrow(tables, "path string, name string, row_count bigint")
    return found.select("path", "name", F.lit("table").alias("kind"), "row_count")
