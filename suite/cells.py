"""SQL cells and Python cells over the given tables."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanframe import display, framed_window, run_sql, transform, transform_batches, transform_groups
from suite.common import table

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sql(data, text, *others):
    def run(spark, folder):
        datasets = {n: table(spark, folder, n) for n in others}
        return run_sql(table(spark, folder, data), text, datasets)

    return run


def _cell(data, text, oracle=None, *others):
    """The same text for Spark and the oracle, but for the name of the dataset."""
    return _sql(data, text, *others), (oracle or text).replace("FROM data", f"FROM {data}")


def _high_value(df):
    return (
        df.where("o_totalprice > 400000")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("highest"))
    )


def _price_bands(batches):
    for batch in batches:
        yield pd.DataFrame(
            {
                "o_orderkey": batch["o_orderkey"],
                "band": (batch["o_totalprice"] // 100000).astype("int64"),
            }
        )


def _three_longest(group):
    """Needs the whole group in order: the three dearest orders and their share of its sum, by running total."""
    top = group.nlargest(3, ["o_totalprice", "o_orderkey"])
    running = top["o_totalprice"].cumsum()
    return pd.DataFrame({"o_orderpriority": top["o_orderpriority"], "o_orderkey": top["o_orderkey"], "running": running.round(2)})


def _hot_key_window(spark, folder):
    """A third of all events have one user."""
    events = table(spark, folder, "events").withColumn("user", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")))
    facts = {"recent": F.count(F.lit(1)), "peak": F.max("value"), "first_id": F.min("event_id")}
    return framed_window(events, ["user"], ["ts", "event_id"], facts, preceding=30, following=2).select("event_id", *facts)


_HOT_FRAME = (
    "(PARTITION BY CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END ORDER BY ts, event_id "
    "ROWS BETWEEN 30 PRECEDING AND 2 FOLLOWING)"
)

QUERIES = {
    "window_framed_hot_key": (
        _hot_key_window,
        f"SELECT event_id, count(*) OVER {_HOT_FRAME} AS recent, max(value) OVER {_HOT_FRAME} AS peak, "
        f"min(event_id) OVER {_HOT_FRAME} AS first_id FROM events",
    ),
    "python_groups": (
        lambda spark, folder: transform_groups(
            table(spark, folder, "orders"), ["o_orderpriority"], _three_longest, "o_orderpriority string, o_orderkey bigint, running double"
        ),
        "SELECT o_orderpriority, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority "
        "ORDER BY o_totalprice DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders "
        "QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) <= 3",
    ),
    "sql_group": _cell(
        "customer",
        "SELECT c_mktsegment, COUNT(*) AS cnt, MAX(c_acctbal) AS best FROM data "
        "GROUP BY c_mktsegment ORDER BY cnt DESC",
    ),
    "sql_inner_join": _cell(
        "orders",
        "SELECT c.c_mktsegment, o.o_orderpriority, COUNT(*) AS n FROM data o "
        "JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, o.o_orderpriority",
        None,
        "customer",
    ),
    "sql_left_join": _cell(
        "customer",
        "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM data c "
        "LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
        None,
        "orders",
    ),
    "sql_semi_and_anti_join": _cell(
        "customer",
        "SELECT c_custkey, 'buyer' AS kind FROM data c WHERE EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) "
        "UNION ALL SELECT c_custkey, 'none' AS kind FROM data c WHERE NOT EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1996-01-01')",
        None,
        "orders",
    ),
    "sql_union_and_except": _cell(
        "customer",
        "SELECT c_nationkey AS nation FROM data WHERE c_acctbal > 9900 UNION "
        "(SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)",
        None,
        "nation",
        "supplier",
    ),
    "sql_rollup": _cell(
        "orders",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM data "
        "GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "sql_ranking_window": _cell(
        "part",
        "SELECT p_partkey, p_brand, CAST(r AS BIGINT) AS r FROM (SELECT p_partkey, p_brand, ROW_NUMBER() OVER "
        "(PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM data) x WHERE r <= 3",
    ),
    "sql_framed_window": _cell(
        "events",
        "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent, MAX(value) OVER (PARTITION BY user_id "
        "ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS peak FROM data",
    ),
    "sql_json_extraction": _cell(
        "events",
        "SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, COUNT(*) AS n FROM data GROUP BY 1",
        "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, COUNT(*) AS n FROM data GROUP BY 1",
    ),
    "python_frame": (
        lambda spark, folder: transform(table(spark, folder, "orders"), _high_value),
        "SELECT o_orderpriority, count(*) AS orders, max(o_totalprice) AS highest FROM orders "
        "WHERE o_totalprice > 400000 GROUP BY o_orderpriority",
    ),
    "python_column": (
        lambda spark, folder: transform(
            table(spark, folder, "customer"), lambda df: F.upper(df["c_mktsegment"])
        ),
        "SELECT upper(c_mktsegment) AS value FROM customer",
    ),
    "python_text": (
        lambda spark, folder: transform(table(spark, folder, "orders"), lambda df: df.count()),
        "SELECT count(*)::VARCHAR AS text_output FROM orders",
    ),
    "python_batches": (
        lambda spark, folder: transform_batches(
            table(spark, folder, "orders"), _price_bands, "o_orderkey bigint, band bigint"
        ),
        "SELECT o_orderkey, floor(o_totalprice / 100000)::BIGINT AS band FROM orders",
    ),
    "display_columns": (
        lambda spark, folder: display(table(spark, folder, "events")),
        "SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 "
        "THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, user_id, event_type, value, props FROM events",
    ),
}
