"""Pages joined are the whole sorted table, whatever the nulls, ties and types."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleanframe import ROWID, Pager
from gleanframe.operators.paging import ID_RANGES
from gleanframe.plans.cursor import Cursor


@pytest.fixture(scope="module")
def edge(spark):
    """203 rows with heavy ties, nulls, NaN and infinities."""
    rows = []
    for i in range(203):
        x = [1.5, float("nan"), -2.0, float("inf"), 1e-7, None][i * 5 % 6]
        rows.append(
            (
                i * 3,
                None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 4}",
                x,
                None if i % 11 == 0 else datetime.date(2024, 1, 1 + i % 5),
                None if i % 13 == 0 else datetime.datetime(2024, 1, 1, i % 3, 0, 0, i % 2),
                None if i % 5 == 0 else bytes([i % 3, 255]),
                None if i % 4 == 0 else [i % 3],
            )
        )
    schema = f"{ROWID} bigint, k string, x double, d date, ts timestamp_ntz, b binary, a array<int>"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def _expected(edge, column, direction):
    if column is None:
        order = [F.asc(ROWID)]
    else:
        c = F.col(column).cast("string") if column == "a" else F.col(column)
        desc = direction == "desc"
        order = [c.desc_nulls_last() if desc else c.asc_nulls_last(), F.desc(ROWID) if desc else F.asc(ROWID)]
    return [r[0] for r in edge.orderBy(*order).select(ROWID).collect()]


def _walk(pager):
    ids, cursor = [], None
    while True:
        page = pager.fetch(cursor)
        ids += [r["id"] for r in page.rows]
        assert page.has_more == (page.next_cursor is not None)
        assert page.next_cursor == pager.next_cursor(cursor)
        if not page.has_more:
            return ids
        assert len(page.rows) == pager.size
        cursor = page.next_cursor


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("column", ["k", "x", "d", "ts", "b", "a"])
def test_cursor_pages_join_to_the_sorted_table(edge, column, direction):
    rows = edge.withColumn("id", F.col(ROWID))
    assert _walk(Pager(rows, sort=column, direction=direction, size=40)) == _expected(edge, column, direction)


def test_cursor_pages_unsorted(edge):
    rows = edge.withColumn("id", F.col(ROWID))
    assert _walk(Pager(rows, size=101)) == _expected(edge, None, "asc")


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("column", [None, "k", "x", "ts"])
def test_far_jumps_equal_cursor_pages(edge, column, direction):
    rows = edge.withColumn("id", F.col(ROWID))
    pager = Pager(rows, sort=column, direction=direction, size=50)
    want = _expected(edge, column, direction)
    for page in (0, 2, 4, 5):
        got = [r["id"] for r in pager.jump(page).collect()]
        assert got == want[page * 50 : page * 50 + 50]


def test_unsorted_pages_across_wide_gaps_of_ids(spark):
    """Row ids jump by 2**33 from one written partition to the next."""
    rows = spark.range(0, 300, 1, 6).select(F.monotonically_increasing_id().alias(ROWID), "id")
    assert _walk(Pager(rows, size=70)) == list(range(300))
    odd = Pager(rows, filters=[{"column": "id", "operator": ">=", "value": 280}], size=7)
    assert _walk(odd) == list(range(280, 300))


def test_rows_by_id_are_read_through_few_ranges(edge):
    pager = Pager(edge, sort="k", size=10)
    condition = pager._with_ids([i * i for i in range(500)])
    plan = edge.where(condition)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" OR ") == ID_RANGES - 1 and " INSET " in plan


def test_filters_counts_numbers_and_columns(edge):
    rows = edge.withColumn("id", F.col(ROWID))
    hot = [{"column": "k", "operator": "=", "value": "hot"}]
    pager = Pager(rows, filters=hot, sort="d", size=30, columns=["d", "id"])
    counts = pager.counts().first()
    kept = edge.where("k = 'hot'").count()
    assert tuple(counts) == (203, kept, -(-kept // 30))
    numbered = pager.numbered(1).collect()
    assert numbered[0].asDict().keys() == {"row_number", "d", "id"}
    assert [r.row_number for r in numbered] == list(range(31, 61))
    assert [r.id for r in numbered] == [r.id for r in pager.jump(1).collect()]
    none = Pager(rows, filters=[{"column": "k", "operator": "=", "value": "no"}])
    assert tuple(none.counts().first()) == (203, 0, 1)
    assert none.fetch().rows == [] and none.fetch().next_cursor is None


def test_cursor_is_bound_to_its_pages(edge):
    first = Pager(edge, sort="k", size=10)
    token = first.fetch().next_cursor
    for other, message in (
        (Pager(edge, sort="x", size=10), "current sort"),
        (Pager(edge, sort="k", direction="desc", size=10), "current sort"),
        (
            Pager(edge, filters=[{"column": "k", "operator": "is_null"}], sort="k", size=10),
            "current filters",
        ),
    ):
        with pytest.raises(ValueError, match=message):
            other.fetch(token)
    for broken in ("%%%", "a.b", "....", "", token[:-1] + "!!", token.replace(".", "", 1)):
        with pytest.raises(ValueError, match="Invalid cursor"):
            first.fetch(broken)
    assert Cursor("k", False, 5, "v", "f").encode() == Cursor("k", False, 5, "v", "f").encode()
