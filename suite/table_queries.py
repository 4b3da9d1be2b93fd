"""Structured queries and their SQL form, and two queries compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe import compare, table_query, table_query_sql
from suite.common import JUDGED_SQL, judged, table


def _query(name, spec):
    return lambda spark, folder: table_query(table(spark, folder, name), spec)


def _rounded(name, spec, *sums):
    """Sums of doubles depend on the order of addition in their last digits."""

    def run(spark, folder):
        out = table_query(table(spark, folder, name), spec)
        return out.select(
            *[F.round(c, 2).alias(c) if c in sums else F.col(c) for c in out.columns]
        )

    return run


def _as_sql(name, spec):
    def run(spark, folder):
        df = table(spark, folder, name)
        text, args = table_query_sql(df, spec, f"spec_{name}")
        df.createOrReplaceTempView(f"spec_{name}")
        return spark.sql(text, args=args)

    return run


def _agg(op, column, alias=None):
    return {"op": op, "column": column, "as": alias}


def _by(column, direction="asc"):
    return {"column": column, "direction": direction}


def _where(column, operator, value=None):
    return {"column": column, "operator": operator, "value": value}


PRICING = {
    "filters": [_where("l_shipdate", "<=", "2001-06-30")],
    "groupBy": ["l_returnflag", "l_linestatus"],
    "aggregations": [
        _agg("sum", "l_quantity", "sum_qty"),
        _agg("avg", "l_discount", "avg_disc"),
        _agg("count", "*", "count_order"),
        _agg("max", "l_shipdate", "last_ship"),
    ],
    "having": [{"metric": "count_order", "operator": ">", "value": 100}],
    "sort": [_by("l_returnflag"), _by("l_linestatus", "desc")],
}
PRICING_SQL = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
  round(avg(l_discount), 2) AS avg_disc, count(*) AS count_order, max(l_shipdate) AS last_ship
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-30' GROUP BY ALL HAVING count(*) > 100
ORDER BY l_returnflag, l_linestatus DESC"""

_TOP_CUSTOMERS = {
    "filters": [_where("o_orderstatus", "in", ["F", "O"])],
    "groupBy": ["o_custkey"],
    "aggregations": [_agg("count", "*"), _agg("max", "o_totalprice"), _agg("min", "o_orderdate")],
    "having": [
        {"metric": "count_all", "operator": ">=", "value": "8"},
        {"metric": "max_o_totalprice", "operator": "<", "value": 490000},
    ],
    "sort": [_by("count_all", "desc"), _by("max_o_totalprice", "desc")],
    "limit": 60,
}
_TOP_CUSTOMERS_SQL = """SELECT o_custkey, count(*) AS count_all, max(o_totalprice) AS max_o_totalprice,
  min(o_orderdate) AS min_o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O')
GROUP BY o_custkey HAVING count(*) >= 8 AND max(o_totalprice) < 490000
ORDER BY count_all DESC, max_o_totalprice DESC, o_custkey, min_o_orderdate LIMIT 60"""


def _integer_sums(spark, folder):
    spec = {"groupBy": ["o_orderstatus"], "aggregations": [_agg("sum", "o_custkey", "keys")]}
    out = table_query(table(spark, folder, "orders"), spec)
    return out.select("o_orderstatus", F.col("keys").cast("bigint").alias("keys"))


def _compare(spark, folder):
    orders, lineitem = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    left = {"filters": [_where("o_totalprice", ">", 480000)]}
    right = {"groupBy": ["l_suppkey"], "aggregations": [_agg("count", "*")]}
    return compare(orders, left, lineitem, right).delta


def _compare_complete(spark, folder):
    """More rows on both sides than any page holds."""
    lineitem, events = table(spark, folder, "lineitem"), table(spark, folder, "events")
    return compare(lineitem, {}, events, {"groupBy": ["event_id", "user_id"]}).delta


_HEAVY_TIES = {"sort": [_by("o_orderstatus", "desc"), _by("o_orderpriority")], "limit": 500}


def _ties_as_sql(spark, folder):
    """A limit in the middle of equal keys, over rows dealt to many partitions."""
    orders = table(spark, folder, "orders").repartition(7)
    text, args = table_query_sql(orders, _HEAVY_TIES, "spec_ties")
    orders.createOrReplaceTempView("spec_ties")
    return spark.sql(text, args=args)


def _exact_prices(spark, folder):
    """Prices with more digits than a double holds."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice").cast("decimal(12,2)").cast("decimal(38,2)") * 10**15 + F.col("l_orderkey")).cast("decimal(38,2)").alias("price"),
    )


_EXACT_PRICES_SQL = """(SELECT l_orderkey, l_linenumber,
  (l_extendedprice::DECIMAL(12,2)::DECIMAL(38,2) * 1000000000000000::DECIMAL(16,0) + l_orderkey)::DECIMAL(38,2) AS price FROM lineitem)"""


def _exact_having(spark, folder):
    spec = {
        "groupBy": ["l_linenumber"],
        "aggregations": [_agg("max", "price", "top"), _agg("count", "*", "n")],
        "having": [{"metric": "top", "operator": ">=", "value": "1000000000000000001.005"}],
        "sort": [_by("l_linenumber")],
    }
    return table_query(_exact_prices(spark, folder), spec)


def _compare_same_table(spark, folder):
    orders = table(spark, folder, "orders")
    empty = {"filters": [_where("o_orderstatus", "=", "nothing")]}
    return compare(orders, {"limit": 50}, orders, empty).delta


def _compare_sql(left, left_columns, right, right_columns):
    return f"""WITH s AS (SELECT (SELECT count(*) FROM ({left})) AS left_rows,
  (SELECT count(*) FROM ({right})) AS right_rows,
  {left_columns}::BIGINT AS left_columns, {right_columns}::BIGINT AS right_columns)
SELECT *, left_rows - right_rows AS rows_delta,
  round((left_rows - right_rows)::DOUBLE / nullif(right_rows, 0)::DOUBLE * 100.0, 1) AS rows_delta_pct,
  left_columns - right_columns AS columns_delta,
  round((left_columns - right_columns)::DOUBLE / right_columns::DOUBLE * 100.0, 1) AS columns_delta_pct,
  left_rows || 'x' || left_columns AS left_shape,
  right_rows || 'x' || right_columns AS right_shape FROM s"""


QUERIES = {
    "query_pricing_summary": (_rounded("lineitem", PRICING, "avg_disc"), PRICING_SQL),
    "query_plain_select": (
        _query("customer", {"filters": [_where("c_mktsegment", "=", "BUILDING")]}),
        "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "query_group_by": (
        lambda spark, folder: table_query(
            judged(spark, folder),
            {"groupBy": ["lang", "quality"], "aggregations": [_agg("count", "quality", "n")]},
        ),
        f"SELECT lang, quality, count(quality) AS n FROM {JUDGED_SQL} GROUP BY lang, quality",
    ),
    "query_group_all_customers": (
        _query("orders", {"groupBy": ["o_custkey"], "aggregations": [_agg("count", "*", "n"), _agg("max", "o_orderdate", "last")]}),
        "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey",
    ),
    "query_having_exact_decimal": (
        _exact_having,
        f"SELECT l_linenumber, max(price) AS top, count(*) AS n FROM {_EXACT_PRICES_SQL} GROUP BY l_linenumber "
        "HAVING max(price) >= 1000000000000000001.005 ORDER BY l_linenumber",
    ),
    "query_as_sql_text_with_ties": (
        _ties_as_sql,
        "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey LIMIT 500",
    ),
    "query_distinct": (
        _query("part", {"groupBy": ["p_brand", "p_type"]}),
        "SELECT DISTINCT p_brand, p_type FROM part",
    ),
    "query_global_aggregate": (
        _rounded(
            "lineitem",
            {
                "aggregations": [
                    _agg("count", "*"),
                    _agg("sum", "l_extendedprice"),
                    _agg("avg", "l_quantity"),
                    _agg("min", "l_shipdate"),
                    _agg("max", "l_returnflag"),
                ]
            },
            "sum_l_extendedprice",
            "avg_l_quantity",
        ),
        "SELECT count(*) AS count_all, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, "
        "round(avg(l_quantity), 2) AS avg_l_quantity, min(l_shipdate) AS min_l_shipdate, "
        "max(l_returnflag) AS max_l_returnflag FROM lineitem",
    ),
    "query_count_rows_and_values": (
        lambda spark, folder: table_query(
            judged(spark, folder),
            {"aggregations": [_agg("count", "*"), _agg("count", "quality"), _agg("max", "good")]},
        ),
        f"SELECT count(*) AS count_all, count(quality) AS count_quality, max(good) AS max_good "
        f"FROM {JUDGED_SQL}",
    ),
    "query_sum_integers": (
        _integer_sums,
        "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus",
    ),
    "query_having": (_query("orders", _TOP_CUSTOMERS), _TOP_CUSTOMERS_SQL),
    "query_having_date": (
        _query(
            "orders",
            {
                "groupBy": ["o_custkey"],
                "aggregations": [_agg("min", "o_orderdate", "first_order")],
                "having": [{"metric": "first_order", "operator": ">=", "value": "1996-01-01"}],
                "sort": [_by("o_custkey")],
            },
        ),
        "SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey "
        "HAVING min(o_orderdate) >= TIMESTAMP '1996-01-01' "
        "ORDER BY o_custkey",
    ),
    "query_sort_many_keys": (
        _query(
            "orders",
            {
                "filters": [_where("o_orderdate", ">=", "1998-01-01")],
                "sort": [_by("o_orderpriority"), _by("o_orderdate", "desc")],
                "limit": 500,
            },
        ),
        "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' "
        "ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 500",
    ),
    "query_sort_nulls_last": (
        lambda spark, folder: table_query(
            judged(spark, folder),
            {"sort": [_by("quality", "desc"), _by("lang"), _by("doc_id")], "limit": 700},
        ),
        f"SELECT * FROM {JUDGED_SQL} ORDER BY quality DESC NULLS LAST, lang, doc_id LIMIT 700",
    ),
    "query_limit": (
        _query("events", {"sort": [_by("value", "desc")], "limit": 7}),
        "SELECT * FROM events ORDER BY value DESC, event_id LIMIT 7",
    ),
    "query_limit_large": (
        lambda spark, folder: table_query(table(spark, folder, "lineitem"), {"sort": [_by("l_extendedprice", "desc")], "limit": 50_000}),
        "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
        "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 50000",
    ),
    "query_as_sql_text": (_as_sql("orders", _TOP_CUSTOMERS), _TOP_CUSTOMERS_SQL),
    "query_as_sql_text_plain": (
        _as_sql(
            "events",
            {
                "filters": [
                    _where("ts", ">=", "2024-01-05"),
                    _where("event_type", "contains", "UR"),
                    _where("value", "not_in", "1.5, 2.5"),
                    _where("props", "is_not_null"),
                ],
                "sort": [_by("event_id")],
                "limit": 1000,
            },
        ),
        "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' "
        "AND contains(lower(event_type), 'ur') AND value NOT IN (1.5, 2.5) "
        "AND props IS NOT NULL ORDER BY event_id LIMIT 1000",
    ),
    "compare_two_tables": (
        _compare,
        _compare_sql(
            "SELECT * FROM orders WHERE o_totalprice > 480000",
            6,
            "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey",
            2,
        ),
    ),
    "compare_complete_results": (
        _compare_complete,
        _compare_sql(
            "SELECT * FROM lineitem", 11, "SELECT DISTINCT event_id, user_id FROM events", 2
        ),
    ),
    "compare_with_empty_side": (
        _compare_same_table,
        _compare_sql(
            "SELECT * FROM orders LIMIT 50",
            6,
            "SELECT * FROM orders WHERE o_orderstatus = 'nothing'",
            6,
        ),
    ),
}
