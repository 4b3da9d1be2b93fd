"""Spreadsheet workbooks (.xlsx): a file, folder or glob, one workbook per input row.

Tasks decode the sheet XML into rows of typed cells; finding the header, typing the columns and
casting are DataFrame work.
"""

from __future__ import annotations

import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# XML names of the workbook format, and its built-in date number formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BUILT_IN_DATES = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
EPOCH_1900, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)

BLOCK_ROWS = 10_000

SHEET_SCHEMA = "header boolean, cells array<struct<c:int,t:string,v:string>>"
NAMES_SCHEMA = "path string, name string, row_count bigint"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


class _Book:
    """One open workbook: its sheets, shared strings and date styles."""

    def __init__(self, path: pa.StringScalar, content: pa.BinaryScalar):
        name = "/" + path.as_py().removeprefix("file:").lstrip("/")
        self.zip = zipfile.ZipFile(pa.BufferReader(content.as_buffer()) if content.is_valid else name)
        book = self._xml("xl/workbook.xml")
        targets = {
            r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")
        }
        self.sheets = {}
        for sheet in book.iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            self.sheets[sheet.get("name").strip()] = part
        settings = book.find(f"{MAIN}workbookPr")
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        self.epoch = EPOCH_1904 if since_1904 else EPOCH_1900

    def _xml(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def _texts(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        texts, root = [], None
        with self.zip.open("xl/sharedStrings.xml") as part:
            for event, element in ElementTree.iterparse(part, events=("start", "end")):
                root = element if root is None else root
                if event == "end" and element.tag == f"{MAIN}si":
                    texts.append(_text(element))
                    root.clear()
        return texts

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = self._xml("xl/styles.xml")
        dates = set(BUILT_IN_DATES)
        for fmt in styles.iter(f"{MAIN}numFmt"):
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", "")).lower()
            if re.search("[ymdhs]", code):
                dates.add(int(fmt.get("numFmtId")))
        formats = styles.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in dates}

    def rows(self, sheet: str) -> Iterator[list[dict]]:
        """Non-empty cells ``{c: column, t: type, v: text}`` of each filled row, streamed."""
        texts, dates = self._texts(), self._date_styles()
        with self.zip.open(self.sheets[sheet]) as part:
            data = None
            for event, element in ElementTree.iterparse(part, events=("start", "end")):
                if element.tag == f"{MAIN}sheetData":
                    data = element
                if event != "end" or element.tag != f"{MAIN}row":
                    continue
                cells, at = [], -1
                for cell in element.iter(f"{MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else at + 1
                    value = self._value(cell, texts, dates)
                    if value is not None:
                        cells.append({"c": at, "t": value[0], "v": value[1]})
                data.clear()
                if cells:
                    yield cells

    def _value(self, cell, texts: list[str], dates: set[int]) -> tuple[str, str] | None:
        kind, raw = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return _filled("s", _text(cell))
        if raw is None:
            return None
        if kind == "s":
            return _filled("s", texts[int(raw)])
        if kind in ("str", "d"):
            return _filled("s" if kind == "str" else "d", raw)
        if kind == "b":
            return "b", "true" if raw == "1" else "false"
        if kind == "e":
            return None
        if int(cell.get("s", 0)) in dates:
            moment = self.epoch + timedelta(seconds=round(float(raw) * 86400, 3))
            return "d", moment.isoformat(sep=" ")
        return "n", raw


def _filled(kind: str, text: str) -> tuple[str, str] | None:
    return (kind, text) if text else None


def _text(element) -> str:
    """Text of a string item, without its phonetic hints."""
    parts = []
    for child in element:
        if child.tag == f"{MAIN}rPh":
            continue
        parts.append(child.text or "" if child.tag == f"{MAIN}t" else _text(child))
    return "".join(parts)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every workbook; the scan packs files into tasks by size.

    Tasks open files of a mounted folder themselves and read them in pieces, so their content stays null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    mounted = all(name.startswith("file:") for name in files.inputFiles())
    return files.select("path", F.lit(None).cast("binary").alias("content") if mounted else "content")


def _column_letters(at: int) -> str:
    letters = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def sheet_rows(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """``(header, cells)`` rows of one sheet of every workbook that has it; the first filled row
    of each workbook is its header."""

    def block(rows: list[list[dict]], first: bool) -> pa.RecordBatch:
        cell = pa.struct([("c", pa.int32()), ("t", pa.string()), ("v", pa.string())])
        flags = [first and i == 0 for i in range(len(rows))]
        return pa.RecordBatch.from_arrays(
            [pa.array(flags, pa.bool_()), pa.array(rows, pa.list_(cell))], ["header", "cells"]
        )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in map(_Book, batch.column("path"), batch.column("content")):
                if sheet not in book.sheets:
                    continue
                rows, first = [], True
                for cells in book.rows(sheet):
                    rows.append(cells)
                    if len(rows) == BLOCK_ROWS:
                        yield block(rows, first)
                        rows, first = [], False
                yield block(rows, first)

    return _files(spark, path).mapInArrow(decode, SHEET_SCHEMA)


def discover_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, kind, row_count)`` per sheet of every workbook; the header is not counted."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                book = _Book(name, content)
                sheets = list(book.sheets)
                sizes = [max(sum(1 for _ in book.rows(s)) - 1, 0) for s in sheets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([name.as_py()] * len(sheets), pa.string()),
                        "name": pa.array(sheets, pa.string()),
                        "row_count": pa.array(sizes, pa.int64()),
                    }
                )

    found = _files(spark, path).mapInArrow(names, NAMES_SCHEMA)
    return found.select("path", "name", F.lit("sheet").alias("kind"), "row_count")


def _cell_at(at: int) -> Column:
    return F.get(F.filter("cells", lambda cell: cell["c"] == at), F.lit(0))["v"]


def scan_workbook(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    """One sheet as a table, over all workbooks of a folder.

    One pass finds names and types (at most 16,384 columns): a column is boolean, double, date,
    timestamp or, when its cells differ, string. Workbooks whose headers disagree are rejected.
    """
    if not sheet:
        raise ValueError("Excel import requires a sheet name")
    rows = sheet_rows(spark, path, sheet)
    cell, body = F.col("cell"), ~F.col("header")
    clock = ~F.endswith(cell["v"], F.lit("00:00:00"))
    found = (
        rows.select("header", F.explode("cells").alias("cell"))
        .groupBy(cell["c"].alias("c"))
        .agg(
            F.collect_set(F.when(F.col("header"), cell["v"])).alias("names"),
            F.collect_set(F.when(body, cell["t"])).alias("types"),
            F.max(body & (cell["t"] == "d") & clock).alias("clock"),
        )
        .orderBy("c")
        .collect()
    )
    if not found:
        raise ValueError(f"Sheet not found or empty: {sheet}")
    kinds = {"b": "boolean", "n": "double", "s": "string"}
    columns: list[Column] = []
    taken: set[str] = set()
    for column in found:
        at, names, types = column["c"], column["names"], column["types"]
        if len(names) > 1:
            raise ValueError(f"Workbooks disagree on column {_column_letters(at)}: {sorted(names)}")
        base = names[0] if names else f"{_column_letters(at)}1"
        name = base
        while name in taken:
            name = f"{base}_{sum(t.startswith(base) for t in taken)}"
        taken.add(name)
        value = _cell_at(at)
        if types == ["d"]:
            day = F.substring(value, 1, 10).cast("date")
            value = value.cast("timestamp_ntz") if column["clock"] else day
        elif len(types) == 1:
            value = value.cast(kinds[types[0]])
        columns.append(value.alias(name))
    return rows.where(body).select(*columns)
