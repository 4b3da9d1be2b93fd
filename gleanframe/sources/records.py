"""Records of delimited text whose quoted fields hold line breaks, found in parallel.

A line alone does not tell whether it begins inside a quoted field. But each block of lines maps both possible
states at its start to a state at its end. These maps, one row per block, are combined in file order; then
every block knows its state and its task cuts its lines into records. A record that crosses blocks is put together
from its few pieces. So large files are split over tasks as files without line breaks are.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.session import shared_folder

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Control characters one of which ends the records that were cut.
SEPARATORS = "\x1e\x1f\x1d\x1c\x01\x02"
#: White space and control characters, of which a line without a record consists.
BLANK = "".join(map(chr, range(33)))
#: Place of what is open at the end of a block: behind all records that end in it.
OPEN = 1 << 62

_BLOCKS = "file string, block long, closed boolean, opened boolean, ends_closed long, ends_opened long, cuts_closed boolean, cuts_opened boolean, held string, header string"
_PIECES = "file string, block long, at long, part long, first boolean, text string"


def ends_inside(line: str, inside: bool, delimiter: str, quote: str) -> bool:
    """Whether a quoted field is open behind ``line``; a quote opens at the start of a field only, doubled ones close nothing."""
    at, width = 0, len(quote)
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                continue
            at += width
        at = line.find(quote, at)
        while at >= 0 and line.startswith(quote, at + width):
            at = line.find(quote, at + 2 * width)
        if at < 0:
            return True
        inside, at = False, line.find(delimiter, at + width)
        if at < 0:
            return False
        at += len(delimiter)


def _lines(batches) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of lines of one block: ``(file, block, lines)``, in order."""
    for batch in batches:
        values, files, blocks = (c.to_pylist() for c in batch.columns)
        start = 0
        for at in range(1, len(values) + 1):
            if at == len(values) or blocks[at] != blocks[start] or files[at] != files[start]:
                yield files[start], blocks[start], values[start:at]
                start = at


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


@dataclass
class _State:
    """What follows from one state at the start of a block."""

    inside: bool
    ends: int = 0
    cuts: bool = False

    def step(self, line: str, delimiter: str, quote: str) -> None:
        blank = not self.inside and not line.strip(BLANK)
        if quote in line:
            self.inside = ends_inside(line, self.inside, delimiter, quote)
        if not self.inside:
            self.cuts = True
            self.ends += not blank


@dataclass(frozen=True)
class Block:
    """Where a block of a file starts: inside a field or not, and in which block the open record began."""

    inside: bool
    origin: int


@dataclass(frozen=True)
class Layout:
    """The blocks of an input, its records with headers, and a separator that does not occur."""

    blocks: dict[tuple[str, int], Block]
    records: int
    files: int
    separator: str
    header: str | None


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")


def layout(spark: SparkSession, path: str, delimiter: str, quote: str) -> Layout:
    """One pass over the lines; the driver combines one row per block."""

    def states(batches):
        key, closed, opened, held, header = None, None, None, set(), []

        def row():
            ends = (closed.inside, opened.inside, closed.ends, opened.ends, closed.cuts, opened.cuts)
            return (*key, *ends, "".join(sorted(held)), "\n".join(header) or None)

        for file, block, lines in _lines(batches):
            if (file, block) != key:
                if key is not None:
                    yield _record_batch([row()], _BLOCKS)
                key, closed, opened, held, header = (file, block), _State(False), _State(True), set(), []
            for line in lines:
                if not block and not closed.ends and (closed.inside or line.strip(BLANK)):
                    header.append(line)
                closed.step(line, delimiter, quote)
                opened.step(line, delimiter, quote)
            held.update(s for s in SEPARATORS if any(s in line for line in lines))
        if key is not None:
            yield _record_batch([row()], _BLOCKS)

    rows = _scan(spark, path).mapInArrow(states, _BLOCKS).collect()
    blocks, records, held = {}, 0, set()
    file, inside, origin = None, False, 0
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != file:
            records += inside  # a field that the end of the file closes
            file, inside, origin = r.file, False, r.block
        blocks[r.file, r.block] = Block(inside, origin)
        records += r.ends_opened if inside else r.ends_closed
        cuts = r.cuts_opened if inside else r.cuts_closed
        if cuts or not inside:
            origin = r.block
        inside = r.opened if inside else r.closed
        held.update(r.held)
    free = [s for s in SEPARATORS if s not in held]
    if not free:
        raise ValueError(f"{path} holds all characters that could part its records")
    headers = sorted((r.file, r.header) for r in rows if r.header is not None)
    return Layout(blocks, records + inside, len(headers), free[0], headers[0][1] if headers else None)


def count_records(spark: SparkSession, path: str, delimiter: str, quote: str) -> int:
    """Records behind the headers."""
    found = layout(spark, path, delimiter, quote)
    return max(found.records - found.files, 0)


def records(spark: SparkSession, path: str, found: Layout, delimiter: str, quote: str) -> DataFrame:
    """``file, block, at, first, text``: every record with the place of its beginning; ``first`` marks headers."""
    starts = spark.sparkContext.broadcast(found.blocks)  # as many rows as blocks
    begin = {}
    for file, block in found.blocks:
        begin[file] = min(block, begin.get(file, block))

    def pieces(batches):
        key, state, text, at, line_at = None, None, [], 0, 0

        def rest():
            """What is open at the end of a block goes to where it began."""
            if not text:
                return []
            origin = key[1] if at >= 0 else starts.value[key].origin
            return [(key[0], origin, OPEN, key[1], at == 0 and key[1] == begin[key[0]], "\n".join(text))]

        for file, block, lines in _lines(batches):
            rows = []
            if (file, block) != key:
                rows += rest() if key is not None else []
                key, text, line_at = (file, block), [], 0
                state = starts.value[key].inside
                at = -1 if state else 0
            for line in lines:
                if not text and not state:
                    at = line_at
                line_at += 1
                if not text and not state and not line.strip(BLANK):
                    continue
                if quote in line:
                    state = ends_inside(line, state, delimiter, quote)
                text.append(line)
                if state:
                    continue
                if at >= 0:
                    rows.append((file, block, at, 0, at == 0 and block == begin[file], "\n".join(text)))
                else:  # the end of a record that began in an earlier block
                    rows.append((file, starts.value[key].origin, OPEN, block, False, "\n".join(text)))
                text, at = [], 0
            if rows:
                yield _record_batch(rows, _PIECES)
        if key is not None and text:
            yield _record_batch(rest(), _PIECES)

    cut = _scan(spark, path).mapInArrow(pieces, _PIECES)
    whole = cut.where(F.col("at") < OPEN).select("file", "block", "at", "first", "text")
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    crossing = cut.where(F.col("at") == OPEN).groupBy("file", "block", "at").agg(F.bool_or("first").alias("first"), joined.alias("text"))
    return whole.unionByName(crossing)


def _safe_names(header: list[str]) -> list[str]:
    """Column names as Spark makes them: empty ones by position, repeated ones with it."""
    seen = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if seen.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def recut(spark: SparkSession, path: str, delimiter: str, quote: str) -> tuple[str, str, list[str]]:
    """Write the records, without headers and in order, parted by a character of their own: ``(folder, separator, names)``.

    One row per block is broadcast, the only other copy of what the tasks know of the blocks.
    """
    found = layout(spark, path, delimiter, quote)
    rows = records(spark, path, found, delimiter, quote)
    names = next(csv.reader([found.header], delimiter=delimiter, quotechar=quote)) if found.header else []
    folder = shared_folder(spark, "records")
    # a folder per block, named by its rank; a record that crosses blocks follows the others of the block it began in
    order = {key: i for i, key in enumerate(sorted(found.blocks))}
    ranks = spark.createDataFrame([(*key, f"{i:09d}") for key, i in order.items()], "file string, block long, rank string")
    placed = rows.where("NOT first").join(F.broadcast(ranks), ["file", "block"])
    ordered = placed.sortWithinPartitions("rank", "at").select("text", "rank")
    ordered.write.partitionBy("rank").option("lineSep", found.separator).text(folder)
    return folder, found.separator, _safe_names(names)
