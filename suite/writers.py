"""Source files of the registered queries: workbooks and SQLite files written by Spark tasks."""

from __future__ import annotations

import os
import sqlite3
import sys
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date
from itertools import chain
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
STYLES = (
    f'<styleSheet xmlns="{MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
    "</styleSheet>"
)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, date):
        return f'<c s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _sheet(rows: Iterable[tuple]) -> Iterator[str]:
    yield f'<worksheet xmlns="{MAIN}"><sheetData>'
    for row in rows:
        yield f"<row>{''.join(map(_cell, row))}</row>"
    yield "</sheetData></worksheet>"


def save_workbook(path: str, sheets: dict[str, Iterable[tuple]]) -> None:
    """A workbook of sheets; the first tuple of each is its header. Rows are written as they come, none is held."""
    names = "".join(
        f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
    )
    links = "".join(
        f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(sheets) + 1)
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>',
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                for text in _sheet(rows):
                    part.write(text.encode())


def _write(df: DataFrame, folder: str, suffix: str, save) -> None:
    """Each task saves its rows, batch by batch, as one file under its own number, so a retry replaces it."""
    os.makedirs(folder, exist_ok=True)
    names = df.columns

    def task(batches):
        size = 0

        def rows():
            nonlocal size
            for batch in batches:
                size += batch.num_rows
                yield from zip(*(column.to_pylist() for column in batch.columns))

        target = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        save(f"{target}.tmp", names, rows())
        os.replace(f"{target}.tmp", f"{target}{suffix}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([size], pa.int64())})

    df.mapInArrow(task, "n bigint").collect()


def write_workbooks(df: DataFrame, folder: str, sheet: str) -> None:
    def save(path, names, rows):
        save_workbook(path, {sheet: chain([tuple(names)], rows), "notes": [("note",), ("made by a task",)]})

    _write(df, folder, ".xlsx", save)


def write_sqlite(df: DataFrame, folder: str, table: str, declared: dict[str, str]) -> None:
    columns = ", ".join(f"{n} {t}" for n, t in declared.items())
    marks = ", ".join("?" * len(declared))

    def save(path, names, rows):
        if os.path.exists(path):
            os.truncate(path, 0)
        connection = sqlite3.connect(path)
        with connection:
            connection.execute(f"CREATE TABLE {table} ({columns})")
            connection.executemany(f"INSERT INTO {table} VALUES ({marks})", rows)
        connection.close()

    _write(df, folder, ".sqlite", save)
