"""Rejected input: the message says what is wrong, before any job runs."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gleanframe import ROWID, Pager, Profile, apply_filters, compare, run_sql, suggest_values, table_query


def _filter(column, operator, value=None):
    return [{"column": column, "operator": operator, "value": value}]


@pytest.mark.parametrize(
    "filters, message",
    [
        (_filter("", "="), "Filter column is required"),
        (_filter("colour", "=", 1), "Invalid filter column: colour"),
        (_filter("harbour", None, 1), "Filter operator is required for column: harbour"),
        (_filter("harbour", "like", "Brest"), "Unsupported operator 'like'"),
        (_filter("harbour", ">", "Brest"), r"Unsupported operator '>' for column 'harbour' \(string\)"),
        (_filter("level", "contains", "1"), "Unsupported operator"),
        (_filter("checked", "<", True), "Unsupported operator"),
        (_filter("samples", ">", "abc"), "Invalid integer value for column 'samples': abc"),
        (_filter("samples", "=", 5.7), "Invalid integer value"),
        (_filter("level", "=", "x"), "Invalid float value"),
        (_filter("checked", "=", "maybe"), "Invalid boolean value"),
        (_filter("checked", "=", 1), "Invalid boolean value"),
        (_filter("taken", "=", "01/02/2024"), "Expected YYYY-MM-DD"),
        (_filter("taken", "=", 20240101), "Invalid date value"),
        (_filter("harbour", "="), "Filter value is required for column 'harbour' and operator '='"),
        (_filter("harbour", "in", 5), "must be a list or comma/newline-separated string"),
        (_filter("harbour", "in", " , \n"), "Filter value list is empty for column 'harbour'"),
        ({"column": "harbour"}, "filters must be an array of objects"),
        ([42], "filters must be an array of objects"),
    ],
)
def test_filters(tides, filters, message):
    with pytest.raises(ValueError, match=message):
        apply_filters(tides, filters)


SUM = {"op": "sum", "column": "level", "as": "total"}


@pytest.mark.parametrize(
    "spec, message",
    [
        ({"groupBy": "harbour"}, "groupBy must be an array"),
        ({"groupBy": ["nope"]}, "Invalid groupBy column: nope"),
        ({"aggregations": ["sum"]}, "aggregations must be an array of objects"),
        ({"aggregations": [{"op": "median", "column": "level"}]}, "Unsupported aggregation op: median"),
        ({"aggregations": [{"op": "sum", "column": ""}]}, "Aggregation column is required"),
        ({"aggregations": [{"op": "sum", "column": "weight"}]}, "Invalid aggregation column"),
        ({"aggregations": [{"op": "avg", "column": "harbour"}]}, "Aggregation avg requires numeric column: harbour"),
        ({"aggregations": [{"op": "sum", "column": "*"}]}, "Aggregation sum requires a column"),
        ({"aggregations": [SUM, SUM]}, "Duplicate output column"),
        ({"having": "x"}, "having must be an array of objects"),
        ({"groupBy": ["harbour"], "having": [{"metric": "total"}]}, "HAVING requires at least one aggregation"),
        ({"aggregations": [SUM], "having": [{"metric": "total"}]}, "HAVING requires groupBy"),
        ({"groupBy": ["harbour"], "aggregations": [SUM], "having": [{}]}, "HAVING metric is required"),
        (
            {"groupBy": ["harbour"], "aggregations": [SUM], "having": [{"metric": "harbour", "operator": "="}]},
            "Invalid HAVING metric: harbour",
        ),
        (
            {"groupBy": ["harbour"], "aggregations": [SUM], "having": [{"metric": "total", "operator": "in"}]},
            "Unsupported HAVING operator 'in' for metric 'total'",
        ),
        ({"sort": {"column": "id"}}, "sort must be an array of sort objects"),
        ({"sort": [{"column": ""}]}, "Sort column is required"),
        ({"sort": [{"column": "nope"}]}, "Invalid sort column: nope"),
        ({"groupBy": ["harbour"], "aggregations": [SUM], "sort": [{"column": "id"}]}, "Invalid sort column: id"),
        ({"limit": 0}, "limit must be an integer of at least 1"),
        ({"limit": 2.5}, "limit must be an integer"),
        ({"limit": True}, "limit must be an integer"),
    ],
)
def test_table_query(tides, spec, message):
    with pytest.raises(ValueError, match=message):
        table_query(tides, spec)


def test_pages_and_profiles(tides):
    rows = tides.withColumn(ROWID, F.col("id"))
    with pytest.raises(ValueError, match="Invalid sort column: weight"):
        Pager(rows, sort="weight")
    with pytest.raises(ValueError, match="page size must be between 1 and 10000"):
        Pager(rows, size=10001)
    with pytest.raises(ValueError, match="page must be at least 0"):
        Pager(rows).jump(-1)
    with pytest.raises(ValueError, match="row identity"):
        Pager(tides)
    with pytest.raises(ValueError, match="Column not found: nope"):
        Profile(tides, "nope")
    with pytest.raises(ValueError, match="Invalid filter column: nope"):
        suggest_values(tides, "nope")
    with pytest.raises(ValueError, match="limit must be between 1 and 100"):
        suggest_values(tides, "harbour", limit=101)
    with pytest.raises(ValueError, match="SQL query is empty"):
        run_sql(tides, "  ")


def test_compare_reports_both_sides(tides):
    with pytest.raises(ValueError, match=r"Invalid groupBy column: a \| limit must be"):
        compare(tides, {"groupBy": ["a"]}, tides, {"limit": 0})


def test_accepted_values(spark, tides):
    ids = lambda *f: [r.id for r in apply_filters(tides, _filter(*f)).orderBy("id").collect()]
    assert ids("samples", "=", " 8 ") == ids("samples", "=", 8) == ids("samples", "=", 8.0) != []
    assert ids("samples", ">", 10**30) == []
    assert len(ids("samples", "<", 10**30)) == 51
    assert ids("checked", "=", "T") == ids("checked", "=", True)
    assert len(ids("checked", "!=", "no")) == 25
    assert ids("taken", ">=", "2023-06-01T00:00:00") == ids("taken", ">=", "2023-06-01")
    assert ids("harbour", "is_not_null", "") == list(range(1, 53))
    assert ids("sky", "!=", "clear") == [i for i in range(1, 53) if i % 3 and i != 49]
    money = spark.sql("SELECT CAST(0.10 AS DECIMAL(9,2)) AS m UNION ALL SELECT 0.20")
    assert apply_filters(money, _filter("m", "=", 0.1)).collect()[0].m == Decimal("0.10")


def test_decimals_compare_exactly(spark):
    texts = ["12345678901234567.89", "12345678901234567.91", "-0.01", "0.00", "99999999999999999999999999999999999.99", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "CAST(t AS DECIMAL(38,2)) AS m")
    got = lambda op, v: sorted(r.t for r in apply_filters(rows, _filter("m", op, v)).collect())
    numbers = {t: Decimal(t) for t in texts if t}
    for value in ("12345678901234567.89", "12345678901234567.9", "0.005", "-0.01", "1e40", "-1e40", "1e-30", 0.1, 0):
        wanted = Decimal(str(value))
        for op, holds in (("=", "__eq__"), ("!=", "__ne__"), (">", "__gt__"), ("<", "__lt__"), (">=", "__ge__"), ("<=", "__le__")):
            assert got(op, value) == sorted(t for t, n in numbers.items() if getattr(n, holds)(wanted)), (op, value)
    assert got("in", "12345678901234567.91, 0.001") == ["12345678901234567.91"]
    assert got("not_in", ["0.001", 10**50]) == sorted(numbers)
    with pytest.raises(ValueError, match="Invalid float value"):
        apply_filters(rows, _filter("m", "=", "NaN"))


def test_integers_of_every_width(spark):
    rows = spark.createDataFrame([(1,), (127,), (-128,), (None,)], "n int").selectExpr("CAST(n AS TINYINT) AS n")
    got = lambda op, v: sorted(r.n for r in apply_filters(rows, _filter("n", op, v)).collect())
    assert got("<", 10**30) == got("!=", 128) == got(">", -129) == [-128, 1, 127]
    assert got("=", 128) == got(">=", 128) == got("in", [500]) == [] and got("<=", 127) == [-128, 1, 127]
    assert got("not_in", [500, 1]) == [-128, 127]


def test_text_matches_are_literal(spark):
    texts = spark.createDataFrame([("50% off",), ("5000 off",), ("a_b",), ("aXb",), ("C:\\x",)], "t string")
    match = lambda op, v: sorted(r.t for r in apply_filters(texts, _filter("t", op, v)).collect())
    assert match("contains", "0% O") == ["50% off"]
    assert match("contains", "a_B") == ["a_b"]
    assert match("starts_with", "c:\\") == ["C:\\x"]
    assert match("ends_with", "OFF") == ["50% off", "5000 off"]
