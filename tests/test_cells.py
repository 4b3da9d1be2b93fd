"""SQL and Python cells, previews and comparisons."""

import pytest
from pyspark.sql import functions as F

from gleanframe import compare, preview, run_sql, table_query, table_query_sql, transform, transform_groups


def test_sql_sees_data_and_other_datasets(spark, tides):
    other = spark.createDataFrame([("Brest", "Ada")], "harbour string, lead string")
    got = run_sql(tides, "SELECT lead, COUNT(*) AS n FROM data JOIN leads USING (harbour) GROUP BY lead", {"leads": other})
    assert [tuple(r) for r in got.collect()] == [("Ada", 13)]
    assert not spark.catalog.tableExists("data") and not spark.catalog.tableExists("leads")


def test_sql_keeps_views_of_the_same_name(spark, tides):
    spark.range(3).createOrReplaceTempView("data")
    assert run_sql(tides, "SELECT COUNT(*) AS n FROM data").first().n == 52
    assert spark.table("data").count() == 3
    spark.catalog.dropTempView("data")


def test_sql_leaves_a_catalog_table_of_the_name_alone(spark, tides):
    spark.range(5).write.mode("overwrite").saveAsTable("data")
    try:
        assert run_sql(tides, "SELECT COUNT(*) AS n FROM data").first().n == 52
        assert [t.isTemporary for t in spark.catalog.listTables() if t.name == "data"] == [False]
        assert spark.table("data").count() == 5
    finally:
        spark.sql("DROP TABLE data")


def test_pandas_code_by_group(tides):
    def widest(group):
        return group.nlargest(1, "samples")[["sky", "id"]]

    got = {r.sky: r.id for r in transform_groups(tides, ["sky"], widest, "sky string, id long").collect()}
    best = {}
    for r in tides.where("samples IS NOT NULL").orderBy("samples", "id").collect():
        best[r.sky] = r.samples
    rows = {r.id: r.samples for r in tides.collect()}
    assert {k: rows[v] for k, v in got.items()} == best and None in got
    with pytest.raises(ValueError, match="Invalid group column: nope"):
        transform_groups(tides, ["nope"], widest, "id long")


def test_statement_without_result(spark, tides):
    out = run_sql(tides, "CREATE OR REPLACE TEMP VIEW made AS SELECT 1 AS n")
    assert out.columns == [] and out.count() == 0
    spark.catalog.dropTempView("made")


def test_python_results(tides):
    frame = transform(tides, lambda df: df.groupBy("harbour").max("samples"))
    assert frame.columns == ["harbour", "max(samples)"] and frame.count() == 4
    assert transform(tides, lambda df: F.col("samples") * 2).columns == ["value"]
    assert transform(tides, lambda df: (df.count(), len(df.columns))).first().text_output == "(52, 9)"
    assert transform(tides, lambda df: print("seen", df.count())).first().text_output == "seen 52"
    assert transform(tides, lambda df: [print("a"), 1][1]).first().text_output == "a\n1"
    with pytest.raises(Exception, match="colour"):
        transform(tides, lambda df: df.select("colour"))


def test_preview(tides):
    shown = preview(tides, 4)
    assert (len(shown.rows), shown.row_count, shown.columns) == (4, 52, tides.columns)
    assert isinstance(shown.rows[0].taken, str) and isinstance(shown.rows[0].level, float)
    odd = tides.selectExpr("CAST('NaN' AS DOUBLE) AS x", "CAST(taken AS TIMESTAMP_NTZ) AS at").limit(1)
    assert tuple(preview(odd, python=True).rows[0]) == (None, "2023-01-04T00:00:00")
    assert str(preview(odd).rows[0].x) == "nan"


SPEC = {
    "filters": [
        {"column": "harbour", "operator": "not_in", "value": "Brest, Esbjerg"},
        {"column": "taken", "operator": ">=", "value": "2023-02-01"},
        {"column": "gauge", "operator": "starts_with", "value": "FLOAT"},
        {"column": "id", "operator": "<", "value": 10**25},
    ],
    "groupBy": ["harbour", "sky"],
    "aggregations": [{"op": "sum", "column": "samples", "as": "q"}, {"op": "max", "column": "taken"}],
    "having": [{"metric": "q", "operator": ">", "value": 10}, {"metric": "max_taken", "operator": ">", "value": "2023-05-01"}],
    "sort": [{"column": "q", "direction": "desc"}],
    "limit": 50,
}


def test_sql_text_gives_the_same_rows(spark, tides):
    text, args = table_query_sql(tides, SPEC, "tide marks")
    assert "HAVING" in text and "GROUP BY" in text and "Cadiz" not in text
    tides.createOrReplaceTempView("`tide marks`")
    want = sorted(map(tuple, table_query(tides, SPEC).collect()), key=repr)
    assert want and sorted(map(tuple, spark.sql(text, args=args).collect()), key=repr) == want
    spark.catalog.dropTempView("tide marks")


def test_sql_text_cuts_ties_like_the_query(spark, tides):
    nested = tides.selectExpr("sky", "array(harbour, gauge) AS both", "id").repartition(5)
    spec = {"sort": [{"column": "sky", "direction": "desc"}], "limit": 8}
    grouped = {"groupBy": ["sky"], "aggregations": [{"op": "max", "column": "both"}], "limit": 2}
    nested.createOrReplaceTempView("tied")
    for one in (spec, grouped):
        text, args = table_query_sql(nested, one, "tied")
        assert spark.sql(text, args=args).collect() == table_query(nested, one).collect()
    spark.catalog.dropTempView("tied")


def test_grouping_keeps_nulls_and_empty_input(tides):
    by_sky = table_query(tides, {"groupBy": ["sky"], "aggregations": [{"op": "count", "column": "*"}]})
    assert {r.sky: r.count_all for r in by_sky.collect()}[None] == 1
    assert sum(r.count_all for r in by_sky.collect()) == 52
    none = table_query(
        tides,
        {
            "filters": [{"column": "harbour", "operator": "=", "value": "none"}],
            "aggregations": [{"op": "count", "column": "*"}, {"op": "sum", "column": "level"}],
        },
    )
    assert tuple(none.first()) == (0, None)
    last = table_query(tides, {"sort": [{"column": "level", "direction": "desc"}], "limit": 52}).collect()
    assert last[-1].level is None


def test_compare_one_table_with_itself(tides):
    west = {"filters": [{"column": "harbour", "operator": "=", "value": "Brest"}]}
    c = compare(tides, {}, tides, {**west, "groupBy": ["harbour"]})
    d = c.delta.first()
    assert (d.left_rows, d.right_rows, d.rows_delta, d.rows_delta_pct) == (52, 1, 51, 5100.0)
    assert (d.columns_delta, d.left_shape, d.right_shape) == (8, "52x9", "1x1")
    assert c.right.collect()[0].harbour == "Brest"
