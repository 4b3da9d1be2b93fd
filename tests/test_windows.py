"""Framed windows of hot keys and the substring index against plain Spark and plain Python."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from gleanframe import SubstringIndex, framed_window, suggest_values, suggestion_index


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("preceding,following", [(0, 0), (3, 0), (0, 2), (700, 5)])
def test_frames_reach_over_ranges(spark, many_ranges, preceding, following):
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 9}", rng.randint(0, 40), rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, k string, t int, x double").repartition(5)
    facts = {"n": F.count(F.lit(1)), "top": F.max("x"), "low": F.min("id")}
    got = framed_window(df, ["k"], [F.desc("t"), "id"], facts, preceding, following)
    frame = W.partitionBy("k").orderBy(F.desc("t"), "id").rowsBetween(-preceding, following)
    want = df.select("*", *[c.over(frame).alias(n) for n, c in facts.items()])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_windows_of_no_rows_and_wrong_frames(spark):
    empty = spark.createDataFrame([], "k string, t int")
    assert framed_window(empty, ["k"], ["t"], {"n": F.count(F.lit(1))}, 2).count() == 0
    for wrong in (dict(preceding=-1), dict(preceding=True), dict(following=1.5)):
        with pytest.raises(ValueError, match="whole number of rows"):
            framed_window(empty, ["k"], ["t"], {}, **wrong)
    with pytest.raises(ValueError, match="Invalid window column: nope"):
        framed_window(empty, ["nope"], ["t"], {})


def test_substrings_are_found_exactly(spark):
    rng = random.Random(7)
    pieces = ["ab", "Ba", "É", "é ", "%", "_", "abc", "aaa", "日本語", "İ", "?x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(300)] + [None, "", "a", "aaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    index = SubstringIndex.build(df, "t")
    for needle in ("abc", "A", "éé", "é a", "AAA", "%_", "本語a", "日本語日", "nothing", "bab?x", "aba"):
        holds = F.contains(F.lower("t"), F.lower(F.lit(needle)))
        want = df.where(holds)
        assert sorted(r.id for r in index.filter(df, needle).collect()) == sorted(r.id for r in want.collect()), needle
        got = suggest_values(df, "t", needle, 20, index=suggestion_index(df, "t")) if needle == "abc" else index.suggest(needle, 20)
        assert got.collect() == suggest_values(df, "t", needle, 20).collect(), needle
    with pytest.raises(ValueError, match="index is one of column t"):
        suggest_values(df, "id", "1", index=index)


def test_a_search_reads_the_lists_of_its_runs(spark):
    df = spark.range(500).select(F.concat(F.lit("name "), "id").alias("t"))
    index = SubstringIndex.build(df, "t")
    plan = index.search("e 49")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1] or plan.count("PartitionFilters") > 1
    assert index.search("e 49").count() == 11
