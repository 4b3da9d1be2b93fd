"""Paging: first pages, sorts, cursors, counts, jumps, visible columns, row numbers."""

from __future__ import annotations

from gleanframe import Pager
from suite.common import JUDGED_SQL, identified, judged_identified


def _pager(name, **options):
    def build(spark, folder):
        judged = name == "judged"
        df = judged_identified(spark, folder) if judged else identified(spark, folder, name)
        return Pager(df, **options)

    return build


def _behind(pager, pages):
    """The page after following the cursor of ``pages`` pages."""

    def run(spark, folder):
        p, cursor = pager(spark, folder), None
        for _ in range(pages):
            cursor = p.next_cursor(cursor)
            if cursor is None:  # no further page
                return p.page().limit(0)
        return p.page(cursor)

    return run


def _first(pager):
    return lambda spark, folder: pager(spark, folder).page()


_BIG = [{"column": "o_totalprice", "operator": ">", "value": 200000}]
_STATUS_DESC = dict(sort="o_orderstatus", direction="desc", size=150)
_COLUMNS = ["event_type", "value", "event_id"]

QUERIES = {
    "page_first": (
        _first(_pager("orders")),
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200",
    ),
    "page_sorted_asc": (
        _first(_pager("events", sort="event_type", size=300)),
        "SELECT * FROM events ORDER BY event_type, event_id LIMIT 300",
    ),
    "page_sorted_desc": (
        _first(_pager("orders", **_STATUS_DESC)),
        "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 150",
    ),
    "page_filtered": (
        _first(_pager("orders", filters=_BIG, sort="o_orderdate", size=250)),
        "SELECT * FROM orders WHERE o_totalprice > 200000 "
        "ORDER BY o_orderdate, o_orderkey LIMIT 250",
    ),
    "page_next_unsorted": (
        _behind(_pager("part", size=100), 2),
        "SELECT * FROM part ORDER BY p_partkey LIMIT 100 OFFSET 200",
    ),
    "page_next_asc": (
        _behind(_pager("events", sort="event_type", size=300), 2),
        "SELECT * FROM events ORDER BY event_type, event_id LIMIT 300 OFFSET 600",
    ),
    "page_next_desc": (
        _behind(_pager("orders", **_STATUS_DESC), 2),
        "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 150 OFFSET 300",
    ),
    "page_next_date": (
        _behind(_pager("orders", filters=_BIG, sort="o_orderdate", size=250), 2),
        "SELECT * FROM orders WHERE o_totalprice > 200000 "
        "ORDER BY o_orderdate, o_orderkey LIMIT 250 OFFSET 500",
    ),
    "page_next_into_nulls": (
        _behind(_pager("judged", sort="quality", direction="desc", size=200), 2),
        f"SELECT * FROM {JUDGED_SQL} ORDER BY quality DESC NULLS LAST, doc_id DESC "
        "LIMIT 200 OFFSET 400",
    ),
    "page_counts": (
        lambda spark, folder: _pager("orders", filters=_BIG, size=300)(spark, folder).counts(),
        "SELECT count(*) AS total_rows, count(*) FILTER (o_totalprice > 200000) AS filtered_rows, "
        "greatest(1, (count(*) FILTER (o_totalprice > 200000) + 299) // 300)::BIGINT AS total_pages "
        "FROM orders",
    ),
    "page_has_more": (
        lambda spark, folder: _pager("part", size=2000)(spark, folder).has_more(),
        "SELECT least(count(*), 2000) AS rows, count(*) > 2000 AS has_more FROM part",
    ),
    "page_jump": (
        lambda spark, folder: _pager("orders", sort="o_orderpriority", size=200)(spark, folder).jump(30),
        "SELECT * FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 200 OFFSET 6000",
    ),
    "page_jump_far_number": (
        lambda spark, folder: _pager("orders", sort="o_totalprice", direction="desc")(
            spark, folder
        ).jump(50),
        "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 200 OFFSET 10000",
    ),
    "page_jump_far_text": (
        lambda spark, folder: _pager("events", sort="event_type")(spark, folder).jump(33),
        "SELECT * FROM events ORDER BY event_type, event_id LIMIT 200 OFFSET 6600",
    ),
    "page_jump_far_unsorted": (
        lambda spark, folder: _pager("customer", size=500)(spark, folder).jump(2),
        "SELECT * FROM customer ORDER BY c_custkey LIMIT 500 OFFSET 1000",
    ),
    "page_jump_far_nulls": (
        lambda spark, folder: _pager("judged", sort="quality", size=100)(spark, folder).jump(8),
        f"SELECT * FROM {JUDGED_SQL} ORDER BY quality NULLS LAST, doc_id LIMIT 100 OFFSET 800",
    ),
    "page_visible_columns": (
        _first(_pager("events", columns=_COLUMNS, sort="value", direction="desc", size=120)),
        "SELECT event_type, value, event_id FROM events "
        "ORDER BY value DESC, event_id DESC LIMIT 120",
    ),
    "page_row_numbers": (
        lambda spark, folder: _pager("events", columns=_COLUMNS, sort="value", size=120)(
            spark, folder
        ).numbered(3),
        "SELECT row_number() OVER (ORDER BY value, event_id) AS row_number, "
        "event_type, value, event_id FROM events ORDER BY value, event_id LIMIT 120 OFFSET 360",
    ),
}
