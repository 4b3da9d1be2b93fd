"""Paging through a filtered, sorted table by keyset cursor or by page number.

A page is found by a per-partition top-k over filter and sort columns and the row id alone; then its
rows are read by id, through ranges that Parquet row groups can be pruned by. A cursor adds a
predicate on the sort column and the row id. A page by number is looked up in a rank index of (sort key,
row id): stored ranges with their cumulative counts, built on the first jump, of which a jump reads one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

from gleanframe.apptypes import ROWID, field_map
from gleanframe.functions.columns import (
    col,
    comparable,
    comparable_type,
    key_literal,
    key_text,
)
from gleanframe.operators.ranks import RankIndex
from gleanframe.plans.cursor import Cursor, filter_fingerprint
from gleanframe.plans.filters import check_filters, predicate

DEFAULT_SIZE = 200
MAX_SIZE = 10_000
ID_RANGES = 8
_KEY, _KEY_TEXT = "_sort_key", "_sort_key_text"


@dataclass(frozen=True)
class FetchedPage:
    rows: list[Row]
    has_more: bool
    next_cursor: str | None


class Pager:
    """One table view: its filters, sort and visible columns. ``df`` carries ``_rowid``."""

    def __init__(
        self,
        df: DataFrame,
        filters: Any = (),
        sort: str | None = None,
        direction: str = "asc",
        columns: Sequence[str] | None = None,
        size: int = DEFAULT_SIZE,
    ):
        if ROWID not in df.columns:
            raise ValueError(f"paging needs the row identity column {ROWID}")
        if isinstance(size, bool) or not isinstance(size, int) or not 1 <= size <= MAX_SIZE:
            raise ValueError(f"page size must be between 1 and {MAX_SIZE}")
        fields = field_map(df)
        if sort is not None and sort not in fields:
            raise ValueError(f"Invalid sort column: {sort}")
        for name in columns or ():
            if name not in fields:
                raise ValueError(f"Invalid column: {name}")
        checked = check_filters(filters, fields)
        self.source, self.size, self.sort = df, size, sort
        self.descending = direction == "desc" and sort is not None
        self.columns = list(columns) if columns is not None else list(fields)
        self.condition = predicate(checked, fields)
        self.fingerprint = filter_fingerprint(checked)
        self.filtered = df if self.condition is None else df.where(self.condition)
        self.rowid = F.col(ROWID)
        if sort is not None:
            self.key_type = comparable_type(fields[sort].dataType)
            self.key = comparable(col(sort), fields[sort].dataType)

    def _order(self, key: Column | None = None) -> list[Column]:
        if self.sort is None:
            return [self.rowid.asc()]
        key = self.key if key is None else key
        if self.descending:
            return [key.desc_nulls_last(), self.rowid.desc()]
        return [key.asc_nulls_last(), self.rowid.asc()]

    def _after(self, key: str | None, rowid: int) -> Column:
        """Rows behind an anchor in page order; ``key`` None anchors among the nulls."""
        forward = self.rowid < rowid if self.descending else self.rowid > rowid
        if self.sort is None:
            return forward
        if key is None:
            return self.key.isNull() & forward
        anchor = key_literal(key, self.key_type)
        beyond = self.key < anchor if self.descending else self.key > anchor
        return beyond | ((self.key == anchor) & forward) | self.key.isNull()

    def _rows(self, cursor: str | None) -> DataFrame:
        if cursor is None:
            return self.filtered
        at = Cursor.decode(cursor, self.sort, self.descending, self.fingerprint)
        return self.filtered.where(self._after(at.key, at.rowid))

    def _narrow(self, rows: DataFrame, limit: int) -> DataFrame:
        """Row ids and sort keys of the first ``limit`` rows in page order."""
        keys = [] if self.sort is None else [key_text(self.key, self.key_type).alias(_KEY_TEXT)]
        return rows.orderBy(*self._order()).limit(limit).select(self.rowid, *keys)

    def _read(self, rows: DataFrame) -> DataFrame:
        """The first page of ``rows`` with the row id and, where there is one, the sort key."""
        return self._of_ids([r[0] for r in self._narrow(rows, self.size).select(self.rowid).collect()])

    def _of_ids(self, ids: list[int]) -> DataFrame:
        """The rows with the ids of one page, in page order."""
        wanted = self.source.where(self._with_ids(ids)) if ids else self.source.limit(0)
        keys = [] if self.sort is None else [self.key.alias(_KEY)]
        page = wanted.orderBy(*self._order()).limit(self.size)
        return page.select(*[col(c) for c in self.columns], self.rowid, *keys)

    def _visible(self, page: DataFrame) -> DataFrame:
        return page.select(*[col(c) for c in self.columns])

    def page(self, cursor: str | None = None) -> DataFrame:
        """The first page, or the page behind ``cursor``. Its ids are looked up at once."""
        return self._visible(self._read(self._rows(cursor)))

    def next_cursor(self, cursor: str | None = None) -> str | None:
        """The cursor behind the page at ``cursor``, or None after the last; no row is read for it."""
        return self._token(self._narrow(self._rows(cursor), self.size + 1).collect())

    def _token(self, anchors: list[Row]) -> str | None:
        """A cursor behind the page, from the anchors of its rows and of one more if there is one."""
        if len(anchors) <= self.size:
            return None
        last = anchors[self.size - 1]
        key = last[_KEY_TEXT] if self.sort is not None else None
        return Cursor(self.sort, self.descending, last[ROWID], key, self.fingerprint).encode()

    def fetch(self, cursor: str | None = None) -> FetchedPage:
        """Rows of one page on the driver (at most 10,000) and the cursor of the next."""
        anchors = self._narrow(self._rows(cursor), self.size + 1).collect()
        ids = [a[ROWID] for a in anchors[: self.size]]
        rows = {}
        if ids:
            wanted = self.source.where(self._with_ids(ids))
            whole = wanted.select(*[col(c) for c in self.columns], self.rowid).collect()
            rows = {r[-1]: r[:-1] for r in whole}
        visible = Row(*self.columns)
        return FetchedPage(
            [visible(*rows[i]) for i in ids], len(anchors) > self.size, self._token(anchors)
        )

    def _with_ids(self, ids: Sequence[int]) -> Column:
        """Rows with these ids; a few ranges around them let Parquet skip row groups."""
        known = sorted(ids)
        gaps = sorted(range(1, len(known)), key=lambda i: known[i - 1] - known[i])
        starts = [0, *sorted(gaps[: ID_RANGES - 1])]
        ends = [s - 1 for s in starts[1:]] + [len(known) - 1]
        # As one text: a call for each id would take longer than the read.
        ranges = " OR ".join(f"{ROWID} BETWEEN {known[a]} AND {known[b]}" for a, b in zip(starts, ends))
        return F.expr(f"({ranges}) AND {ROWID} IN ({', '.join(map(str, known))})")

    def has_more(self, cursor: str | None = None) -> DataFrame:
        """One row: rows on the page and whether another page follows."""
        window = self._narrow(self._rows(cursor), self.size + 1)
        n = F.count(F.lit(1))
        return window.agg(
            F.least(n, F.lit(self.size)).alias("rows"), (n > self.size).alias("has_more")
        )

    def counts(self) -> DataFrame:
        """One row: total rows, rows that pass the filters, and the number of pages."""
        total = F.count(F.lit(1))
        kept = total if self.condition is None else F.count_if(self.condition)
        pages = F.greatest(F.lit(1), F.ceil(kept / F.lit(self.size))).cast("bigint")
        return self.source.agg(
            total.alias("total_rows"), kept.alias("filtered_rows"), pages.alias("total_pages")
        )

    @cached_property
    def index(self) -> RankIndex:
        """Sort keys and row ids of the filtered rows in page order, stored by range."""
        keys = [] if self.sort is None else [self.key.alias(_KEY)]
        return RankIndex.build(self.filtered.select(*keys, self.rowid), self._order(F.col(_KEY)))

    def with_index(self, index: RankIndex) -> Pager:
        """The same pager with the rank index of another one over the same rows, filters and sort."""
        self.__dict__["index"] = index
        return self

    def jump(self, page: int) -> DataFrame:
        """Any page by its 0-based number: its ids are looked up in the range that holds them."""
        return self._visible(self._at_page(page))

    def _at_page(self, page: int) -> DataFrame:
        if isinstance(page, bool) or not isinstance(page, int) or page < 0:
            raise ValueError("page must be at least 0")
        if not page:
            return self._read(self.filtered)
        return self._of_ids([r[0] for r in self.index.slice(page * self.size, self.size).select(ROWID).collect()])

    def numbered(self, page: int) -> DataFrame:
        """A page with the table-wide row number of each row, counted from 1."""
        taken, first = self._at_page(page), page * self.size
        # the window sees one page only, so its single partition is bounded by the page size
        order = self._order(F.col(_KEY))
        number = F.row_number().over(W.orderBy(*order)) + F.lit(first)
        return taken.select(number.cast("bigint").alias("row_number"), *[col(c) for c in self.columns])

