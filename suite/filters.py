"""Every filter operator, and filters combined."""

from __future__ import annotations

from gleanframe import apply_filters
from suite.common import JUDGED_SQL, judged, table


def _filter(name, *filters):
    raw = [{"column": c, "operator": o, "value": v} for c, o, v in filters]
    return lambda spark, folder: apply_filters(table(spark, folder, name), raw)


def _judged_filter(*filters):
    raw = [{"column": c, "operator": o, "value": v} for c, o, v in filters]
    return lambda spark, folder: apply_filters(judged(spark, folder), raw)


QUERIES = {
    "filter_equals": (
        _filter("orders", ("o_orderstatus", "=", "F")),
        "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    ),
    "filter_not_equals": (
        _judged_filter(("quality", "!=", 1)),
        f"SELECT * FROM {JUDGED_SQL} WHERE quality <> 1",
    ),
    "filter_greater": (
        _filter("orders", ("o_totalprice", ">", "250000.5")),
        "SELECT * FROM orders WHERE o_totalprice > 250000.5",
    ),
    "filter_less": (
        _filter("customer", ("c_acctbal", "<", 0)),
        "SELECT * FROM customer WHERE c_acctbal < 0",
    ),
    "filter_greater_equal_date": (
        _filter("orders", ("o_orderdate", ">=", "1997-01-01")),
        "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
    ),
    "filter_less_equal": (
        _filter("part", ("p_size", "<=", "10")),
        "SELECT * FROM part WHERE p_size <= 10",
    ),
    "filter_timestamp": (
        _filter("events", ("ts", ">", "2024-01-10T12:30:00"), ("ts", "<", "2024-01-20 06:00:00")),
        "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10 12:30:00' "
        "AND ts < TIMESTAMP '2024-01-20 06:00:00'",
    ),
    "filter_in": (
        _filter("part", ("p_size", "in", "1, 5\n9")),
        "SELECT * FROM part WHERE p_size IN (1, 5, 9)",
    ),
    "filter_not_in": (
        _judged_filter(("quality", "not_in", [0, 7]), ("lang", "not_in", "en,de")),
        f"SELECT * FROM {JUDGED_SQL} WHERE quality NOT IN (0, 7) AND lang NOT IN ('en', 'de')",
    ),
    "filter_contains": (
        _filter("documents", ("text", "contains", "ÉA")),
        "SELECT * FROM documents WHERE contains(lower(text), 'éa')",
    ),
    "filter_contains_literal": (
        _filter("pages", ("url", "contains", "?PAGE=2&r")),
        "SELECT * FROM pages WHERE contains(lower(url), '?page=2&r')",
    ),
    "filter_starts_with": (
        _filter("part", ("p_name", "starts_with", "SMALL")),
        "SELECT * FROM part WHERE starts_with(lower(p_name), 'small')",
    ),
    "filter_ends_with": (
        _filter("part", ("p_name", "ends_with", "Ring")),
        "SELECT * FROM part WHERE suffix(lower(p_name), 'ring')",
    ),
    "filter_is_null": (
        _judged_filter(("quality", "is_null", None)),
        f"SELECT * FROM {JUDGED_SQL} WHERE quality IS NULL",
    ),
    "filter_is_not_null": (
        _judged_filter(("quality", "is_not_null", "")),
        f"SELECT * FROM {JUDGED_SQL} WHERE quality IS NOT NULL",
    ),
    "filter_boolean": (
        _judged_filter(("good", "=", "yes")),
        f"SELECT * FROM {JUDGED_SQL} WHERE good",
    ),
    "filter_conjunction": (
        _filter(
            "lineitem",
            ("l_shipdate", ">=", "1996-01-01"),
            ("l_discount", "in", [0.05, 0.06]),
            ("l_quantity", "<", 24),
            ("l_returnflag", "!=", "R"),
        ),
        "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' "
        "AND l_discount IN (0.05, 0.06) AND l_quantity < 24 AND l_returnflag <> 'R'",
    ),
}
