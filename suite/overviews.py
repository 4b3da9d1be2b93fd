"""Schema overview, sparklines and value suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe import SubstringIndex, overview, schema_overview, sparklines, suggest_values, suggestion_index
from suite.common import JUDGED_SQL, judged, table

_TYPES = {
    "lineitem": {
        "l_orderkey": "integer",
        "l_partkey": "integer",
        "l_suppkey": "integer",
        "l_linenumber": "integer",
        "l_quantity": "float",
        "l_extendedprice": "float",
        "l_discount": "float",
        "l_tax": "float",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "date",
    },
    "customer": {
        "c_custkey": "integer",
        "c_name": "string",
        "c_nationkey": "integer",
        "c_acctbal": "float",
        "c_mktsegment": "string",
    },
    "judged": {
        "doc_id": "integer",
        "lang": "string",
        "source": "string",
        "n_chars": "integer",
        "quality": "integer",
        "good": "boolean",
    },
}


def _overview_sql(name, source=None):
    source = source or name
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS total_count, "
        f"count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count "
        f"FROM {source} t"
        for i, (c, kind) in enumerate(_TYPES[name].items())
    ]
    return f"""SELECT *, null_count::DOUBLE / total_count::DOUBLE * 100.0 AS null_pct,
  CASE WHEN null_count::DOUBLE / total_count::DOUBLE * 100.0 >= 25 THEN 'error'
       WHEN null_count::DOUBLE / total_count::DOUBLE * 100.0 >= 5 THEN 'warning'
       ELSE 'normal' END AS null_band
FROM ({' UNION ALL '.join(parts)})"""


def _bars_sql(column, source, expression, kind):
    """One column's sparkline as SQL, ``idx`` and ``count``."""
    counts = f"(SELECT {expression} AS v, count(*) AS n FROM {source} t WHERE {expression} IS NOT NULL GROUP BY 1)"
    few = f"(SELECT count(*) FROM {counts}) <= 8"
    if kind == "boolean":
        return f"""SELECT unnest([0, 1]) AS idx, unnest([count(*) FILTER (NOT {expression}),
  count(*) FILTER ({expression})]) AS count FROM {source} t"""
    if kind == "text":
        return f"""SELECT row_number() OVER (ORDER BY v) - 1 AS idx, n AS count FROM {counts} WHERE {few}
UNION ALL SELECT r - 1, n FROM (SELECT n, row_number() OVER (ORDER BY n DESC, v) AS r FROM {counts})
WHERE NOT {few} AND r <= 8"""
    return f"""SELECT row_number() OVER (ORDER BY v) - 1 AS idx, n AS count FROM {counts} WHERE {few}
UNION ALL SELECT s.i, coalesce(b.n, 0) FROM range(8) s(i) LEFT JOIN (
  SELECT least(floor((v - lo) / ((hi - lo) / 8.0::DOUBLE)), 7) AS i, sum(n) AS n
  FROM {counts}, (SELECT min(v) AS lo, max(v) AS hi FROM {counts}) GROUP BY 1) b ON s.i = b.i
WHERE NOT {few}"""


def _sparklines_sql(*columns):
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", idx::INTEGER AS idx, count::BIGINT AS count "
        f"FROM ({_bars_sql(c, source, expression, kind)})"
        for i, (c, source, expression, kind) in enumerate(columns)
    )


def _sparklines(name, *columns):
    return lambda spark, folder: sparklines(table(spark, folder, name), columns)


def _schema(spark, folder):
    full = schema_overview(judged(spark, folder))
    bars = F.posexplode_outer("sparkline").alias("idx", "count")
    return full.select("column", "null_band", bars).where("idx is not null")


_JUDGED_BARS = (
    ("doc_id", JUDGED_SQL, "doc_id::DOUBLE", "number"),
    ("lang", JUDGED_SQL, "lang", "text"),
    ("source", JUDGED_SQL, "source", "text"),
    ("n_chars", JUDGED_SQL, "n_chars::DOUBLE", "number"),
    ("quality", JUDGED_SQL, "quality::DOUBLE", "number"),
    ("good", JUDGED_SQL, "good", "boolean"),
)


def _numbers(name, *columns):
    return [(c, name, f"{c}::DOUBLE", "number") for c in columns]


def _approximate(spark, folder):
    """The estimated distinct counts lie within a seventh of the exact ones (3 x 5 % standard error)."""
    customer = table(spark, folder, "customer")
    close = F.abs(F.col("a.unique_count") - F.col("e.unique_count")) * 7 <= F.col("e.unique_count")
    estimated, exact = overview(customer, approximate=True).alias("a"), overview(customer).alias("e")
    return estimated.join(exact, F.col("a.column") == F.col("e.column")).select("a.column", close.alias("close"))


def _suggested(df, column, text, limit):
    return suggest_values(df, column, text, limit, index=suggestion_index(df, column))


def _held(df, column, text):
    return SubstringIndex.build(df, column).filter(df, text)


QUERIES = {
    "overview_lineitem": (
        lambda spark, folder: overview(table(spark, folder, "lineitem")),
        _overview_sql("lineitem"),
    ),
    "overview_customer": (
        lambda spark, folder: overview(table(spark, folder, "customer")),
        _overview_sql("customer"),
    ),
    "overview_with_nulls": (
        lambda spark, folder: overview(judged(spark, folder)),
        _overview_sql("judged", JUDGED_SQL),
    ),
    "overview_approximate_types": (
        lambda spark, folder: overview(table(spark, folder, "customer"), approximate=True).select(
            "column", "type", "total_count", "null_count"
        ),
        'SELECT "column", type, total_count, null_count '
        f"FROM ({_overview_sql('customer')})",
    ),
    "overview_approximate_counts": (
        _approximate,
        f"""SELECT "column", true AS close FROM ({_overview_sql('customer')})""",
    ),
    "schema_overview_with_sparklines": (
        _schema,
        'SELECT o."column", o.null_band, s.idx, s.count '
        f"FROM ({_overview_sql('judged', JUDGED_SQL)}) o "
        f"JOIN ({_sparklines_sql(*_JUDGED_BARS)}) s ON o.position = s.position",
    ),
    "sparkline_few_values": (
        _sparklines("lineitem", "l_linenumber"),
        _sparklines_sql(*_numbers("lineitem", "l_linenumber")),
    ),
    "sparkline_numbers": (
        _sparklines("lineitem", "l_extendedprice", "l_quantity", "l_discount"),
        _sparklines_sql(*_numbers("lineitem", "l_extendedprice", "l_quantity", "l_discount")),
    ),
    "sparkline_dates": (
        _sparklines("lineitem", "l_shipdate"),
        _sparklines_sql(("l_shipdate", "lineitem", "epoch_us(l_shipdate) / 1000000.0::DOUBLE", "number")),
    ),
    "sparkline_timestamps": (
        _sparklines("events", "ts"),
        _sparklines_sql(("ts", "events", "epoch_us(ts) / 1000000.0::DOUBLE", "number")),
    ),
    "sparkline_text": (
        _sparklines("documents", "lang", "source"),
        _sparklines_sql(("lang", "documents", "lang", "text"), ("source", "documents", "source", "text")),
    ),
    "sparkline_boolean": (
        lambda spark, folder: sparklines(judged(spark, folder), ["good"]),
        _sparklines_sql(("good", JUDGED_SQL, "good", "boolean")),
    ),
    "suggest_frequent_values": (
        lambda spark, folder: suggest_values(table(spark, folder, "customer"), "c_mktsegment", limit=3),
        "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1 "
        "ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "suggest_matching_text": (
        lambda spark, folder: suggest_values(table(spark, folder, "part"), "p_name", " RING ", 8),
        "SELECT p_name AS value, count(*) AS count FROM part WHERE contains(lower(p_name), 'ring') "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    ),
    "suggest_by_index": (
        lambda spark, folder: _suggested(table(spark, folder, "part"), "p_name", " RING ", 8),
        "SELECT p_name AS value, count(*) AS count FROM part WHERE contains(lower(p_name), 'ring') "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    ),
    "filter_contains_by_index": (
        lambda spark, folder: _held(table(spark, folder, "pages"), "url", "?PAGE=2&r"),
        "SELECT * FROM pages WHERE contains(lower(url), '?page=2&r')",
    ),
    "suggest_matching_numbers": (
        lambda spark, folder: suggest_values(table(spark, folder, "orders"), "o_totalprice", "99.9", 100),
        "SELECT o_totalprice::VARCHAR AS value, count(*) AS count FROM orders "
        "WHERE contains(o_totalprice::VARCHAR, '99.9') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    ),
    "suggest_timestamps": (
        lambda spark, folder: suggest_values(table(spark, folder, "orders"), "o_orderdate", "1997-0", 40),
        "SELECT o_orderdate::VARCHAR AS value, count(*) AS count FROM orders "
        "WHERE contains(o_orderdate::VARCHAR, '1997-0') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    ),
}
