"""The physical plans: what is read, what is shuffled, and what is not."""

import re

import pytest
from pyspark.sql import functions as F

from gleanframe.operators import table_query as table_query_module
from gleanframe import ROWID, Pager, Profile, apply_filters, overview, profile, sparklines, table_query
from suite import all_queries
from tests.conftest import SMALL


def _plan(df):
    """The formatted physical plan, its node details untruncated."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _shuffles_of_scans(df):
    """Distinct shuffles that ran straight over a file scan, hash partitioned by a key."""
    df.collect()
    adaptive = df._jdf.queryExecution().executedPlan()
    keys = adaptive.context().stageCache().keysIterator()
    found = []
    while keys.hasNext():
        text = keys.next().toString()
        direct = text.count("Exchange ") == 1 and "FileScan" in text
        if direct and "hashpartitioning" in text.splitlines()[0]:
            found.append(text)
    return found


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet").withColumn(ROWID, F.col("o_orderkey"))


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet")


def test_filters_and_columns_reach_the_scan(orders):
    spec = {
        "filters": [
            {"column": "o_totalprice", "operator": ">", "value": 1000},
            {"column": "o_orderkey", "operator": "<=", "value": "700"},
            {"column": "o_orderstatus", "operator": "in", "value": "F,O"},
        ],
        "groupBy": ["o_orderstatus"],
        "aggregations": [{"op": "max", "column": "o_totalprice"}],
    }
    plan = _plan(table_query(orders, spec))
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "LessThanOrEqual(o_orderkey,700)" in plan
    assert "In(o_orderstatus, [F,O])" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_date_filter_keeps_the_column_uncast(orders):
    late = apply_filters(orders, [{"column": "o_orderdate", "operator": ">=", "value": "1997-01-01"}])
    assert "cast(o_orderdate" not in _plan(late)


def test_pages_are_top_k_and_read_visible_columns_only(orders):
    pager = Pager(orders, sort="o_totalprice", direction="desc", columns=["o_orderstatus"], size=20)
    for frame in (pager.page(), pager.page(pager.fetch().next_cursor), pager.jump(3)):
        plan = _plan(frame)
        assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
        assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_far_jump_sorts_one_page_only(orders):
    frame = Pager(orders, sort="o_totalprice", size=20).jump(40)
    plan = _plan(frame)
    assert re.search(r"TakeOrderedAndProject\n.*\nArguments: 20,", plan) and "Exchange" not in plan


def test_grouping_aggregates_before_the_shuffle(lineitem):
    spec = {"groupBy": ["l_returnflag"], "aggregations": [{"op": "sum", "column": "l_quantity", "as": "q"}], "sort": [{"column": "q"}], "limit": 50}
    plan = _plan(table_query(lineitem, spec))
    assert "partial_sum" in plan and len(re.findall(r"\(\d+\) Exchange", plan)) == 1
    assert "rangepartitioning" not in plan


def test_overview_reads_each_column_alone(lineitem):
    plan = _plan(overview(lineitem, ["l_tax", "l_shipdate"]))
    schemas = set(re.findall(r"ReadSchema: (struct<.*?>)", plan))
    both = "struct<l_tax:double,l_shipdate:timestamp_ntz>"  # the one pass that counts rows and nulls
    assert schemas <= {"struct<>", "struct<l_tax:double>", "struct<l_shipdate:timestamp_ntz>", both}
    assert "Expand" not in plan


def test_profile_shuffles_the_values_once(lineitem):
    """All facets that need value counts read the stored ones; a number's histogram shuffles at most 20 bins."""
    assert len(_shuffles_of_scans(profile(lineitem, "l_extendedprice"))) <= 2


def test_string_profile_shuffles_no_text(lineitem):
    """Texts are counted by digest; of labels, tokens, lengths and shapes a row each is shuffled."""
    facets = Profile(lineitem, "l_returnflag")
    for frame in (facets.universal(), facets.string_stats(), facets.pattern_classes(), facets.sentinel_tokens()):
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [v#" not in text and "Aggregate [l_returnflag" not in text


def test_sparkline_counts_values_only_behind_the_estimate(lineitem):
    """The rows whose values are counted pass a filter on the distinct estimate first."""
    frame = sparklines(lineitem, ["l_extendedprice"])
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "values <= 8" in text


def test_no_query_multiplies_rows(spark):
    """No cross product anywhere, and no global sort where a top-k is enough."""
    for name, run in all_queries().items():
        if name.startswith(("filter", "page", "query", "overview", "sparkline", "profile", "suggest", "compare")):
            plan = _plan(run(spark, SMALL))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_looked_up_in_their_ranges(spark, lineitem):
    """No window or sort of the whole column: rows stay in ranges, and only those asked for are read."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = Profile(lineitem, "l_extendedprice")._index
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.ranges) > 1
    plan = _exchanges(index.slice(100, 5))
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan
    assert re.search(r"PartitionFilters: \[.*_range", plan)


def test_a_jump_reads_one_page(orders):
    pager = Pager(orders, sort="o_totalprice", direction="desc", size=20)
    pager.jump(40)
    assert pager.with_index(pager.index).jump(3).count() == 20
    assert len(pager.index.ranges) >= 1


def test_a_large_limit_is_cut_by_range(lineitem):
    spec = {"sort": [{"column": "l_extendedprice", "direction": "desc"}], "limit": lineitem.count() - 900}
    spark, before = lineitem.sparkSession, table_query_module.ONE_TASK_ROWS
    table_query_module.ONE_TASK_ROWS = 100
    try:
        frame = table_query(lineitem, spec)
    finally:
        table_query_module.ONE_TASK_ROWS = before
    plan = _plan(frame)
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan and "rangepartitioning" in plan
    want = lineitem.orderBy(F.desc("l_extendedprice"), *[c for c in lineitem.columns if c != "l_extendedprice"]).limit(spec["limit"])
    assert frame.collect() == want.collect() and spark is frame.sparkSession


def test_no_text_is_shuffled_by_overviews_and_top_texts(spark):
    """Rows are exchanged by digest; a sparkline orders texts only where the estimate says that there are few."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = Profile(documents, "text")
    for frame in (overview(documents), texts.top_values(), texts.length_outliers()):
        assert frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\((text|v)#", plan)
    frame = sparklines(documents, ["text"])
    frame.collect()
    assert "<= 8)" in frame._jdf.queryExecution().executedPlan().toString()
