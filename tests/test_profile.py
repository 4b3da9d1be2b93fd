"""Profiles of awkward columns, beyond what the given tables hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleanframe import Profile, overview, profile, schema_overview, sparklines, suggest_values
from gleanframe.functions.columns import display_text


def _one(spark, values, data_type):
    return spark.createDataFrame([(v,) for v in values], f"v {data_type}").repartition(3)


def _bars(df, column="v"):
    rows = sparklines(df, [column]).orderBy("idx").collect()
    return [r["count"] for r in rows]


def test_non_finite_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = _one(spark, [1.0, 2.0, -0.0, 0.0, nan, inf, -inf, None], "double")
    p = Profile(df, "v")
    u = p.universal().first()
    assert (u.non_null_count, u.null_count, u.unique_count) == (7, 1, 6)
    s = p.numeric_stats().first()
    assert (s.min, s.max, s.zero_rate_pct, s.mean) == (None, None, 28.57, None)
    assert sum(r["count"] for r in p.histogram().collect()) == 4
    assert _bars(df) == [2, 1, 1]


def test_constant_single_and_empty_columns(spark):
    one = Profile(_one(spark, [5.0], "double"), "v").numeric_stats().first()
    assert (one.stddev, one.median, one.iqr, one.outlier_count) == (None, 5.0, 0.0, 0)
    same = _one(spark, [3, 3, 3], "int")
    assert Profile(same, "v").histogram().collect() == []
    assert Profile(same, "v").numeric_stats().first().outlier_rate_pct == 0.0
    assert _bars(same) == [3]
    for empty in (_one(spark, [], "double"), _one(spark, [None, None], "double")):
        s = Profile(empty, "v").numeric_stats().first()
        assert (s.min, s.median, s.zero_rate_pct, s.distinct_count) == (None, None, None, 0)
        u = Profile(empty, "v").universal().first()
        assert (u.cardinality_pct, u.cardinality_band, u.dominant_value) == (0.0, "low", None)
        assert _bars(empty) == []
        assert Profile(empty, "v").histogram().collect() == []
        assert Profile(empty, "v").tail_values().collect() == []
    strings = _one(spark, [None], "string")
    s = Profile(strings, "v").string_stats().first()
    assert (s.min_length, s.blank_pct, s.distinct_pattern_count, s.tail_profile) == (None, 0.0, 0, "high")


def test_decimals_and_wide_sums(spark):
    df = spark.sql("SELECT CAST(id AS DECIMAL(10,2)) / 4 AS m, 9223372036854775807 AS big FROM range(20)")
    s = Profile(df, "m").numeric_stats().first()
    assert (s.min, s.max, s.sum, s.median) == (0.0, 4.75, 47.5, 2.375)
    assert len(_bars(df, "m")) == 8 and sum(_bars(df, "m")) == 20
    assert Profile(df, "big").numeric_stats().first().sum == pytest.approx(20 * (2**63 - 1))


def test_sparkline_at_the_edge_of_eight_values(spark):
    """7, 8, 9 and many more distinct values, whatever their registers in the estimate."""
    for k in (7, 8, 9, 10, 40):
        for base in (0, 1000, 77_777):
            values = [float(base + i * i) for i in range(k) for _ in range(i % 3 + 1)]
            bars = _bars(_one(spark, values, "double"))
            if k <= 8:
                assert bars == [i % 3 + 1 for i in range(k)]
            else:
                assert len(bars) == 8 and sum(bars) == len(values)


def test_outliers_and_tails(spark):
    values = [10.0] * 50 + [11.0] * 45 + [500.0, 500.0, 400.0, -300.0, -300.0]
    p = Profile(_one(spark, values, "double"), "v")
    s = p.numeric_stats().first()
    assert (s.outlier_count, s.high_tail_count, s.low_tail_count) == (5, 3, 2)
    tails = [tuple(r) for r in p.tail_values().orderBy("tail", F.desc("count")).collect()]
    assert tails == [("high", "500.0", 2), ("high", "400.0", 1), ("low", "-300.0", 2)]


def test_dominant_value_ties(spark):
    tied = Profile(_one(spark, [1, 1, 2, 2, 3], "int"), "v").universal().first()
    assert (tied.dominant_value, tied.dominant_count, tied.dominant_share_pct) == ("none", 2, None)
    clear = Profile(_one(spark, ["b", "a", "b", None], "string"), "v").universal().first()
    assert (clear.dominant_value, clear.dominant_count, clear.dominant_share_pct) == ("b", 2, 66.67)
    flags = Profile(_one(spark, [True, False, None], "boolean"), "v")
    assert (flags.universal().first().dominant_value, flags.universal().first().dominant_count) == ("none", 1)
    assert flags.boolean_stats().first().true_share_pct == 33.33
    nothing = Profile(_one(spark, [None, None], "boolean"), "v").universal().first()
    assert (nothing.dominant_value, nothing.dominant_count) == (None, None)
    assert _bars(_one(spark, [None], "boolean")) == []
    assert _bars(_one(spark, [True, True, None], "boolean")) == [0, 2]


def test_key_hints(spark):
    hint = lambda values: Profile(_one(spark, values, "int"), "v").universal().first().key_hint
    assert hint(range(100)) == "strong"
    assert hint([*range(99), 0]) == "possible"
    assert hint([*range(99), None]) == "unlikely"


def test_sentinels_and_length_outliers(spark):
    odd = "THIS_IS_A_VERY_LONG_STRING_VALUE_FOR_OUTLIER_CHECKING_123456789"
    values = ["NA", "n/a", "NULL", "-", " ", "", "ok", odd, " ", "\t", " None ", None]
    p = Profile(_one(spark, values, "string"), "v")
    s = p.string_stats().first()
    assert (s.sentinel_count, s.blank_count, s.outlier_length_count) == (9, 4, 1)
    tokens = [tuple(r) for r in p.sentinel_tokens().collect()]
    assert tokens == [
        ("(whitespace)", 3),
        ("(empty)", 1),
        ("-", 1),
        ("n/a", 1),
        ("na", 1),
        ("none", 1),
        ("null", 1),
    ]
    assert [r.example for r in p.length_outliers().collect()] == [odd]
    assert p.top_values(2).collect()[0].share_pct == 9.1


def test_pattern_classes(spark):
    values = {
        "uuid": ["1B4E28BA-2FA1-41D2-883F-0016D3CCA427", " 1b4e28ba-2fa1-11d2-883f-0016d3cca427 "],
        "email": ["a.b+c@x-y.example.org"],
        "numeric-only": ["007", " 12 "],
        "code-like": ["AB-12_c"],
        "free-text": ["a@b.c", "12.5", "hello", "é1"],
    }
    df = _one(spark, [v for group in values.values() for v in group] + ["  ", None], "string")
    got = {r.label: r["count"] for r in Profile(df, "v").pattern_classes().collect()}
    assert got == {k: len(v) for k, v in values.items()}


def test_dates(spark):
    days = [datetime.date(2024, 1, 30), datetime.date(2024, 1, 30), datetime.date(2024, 2, 9), None]
    p = Profile(_one(spark, days, "date"), "v")
    assert tuple(p.date_stats().first()) == ("2024-01-30", "2024-02-09", 9, 9)
    assert [tuple(r) for r in p.month_histogram().collect()] == [("2024-01", 2), ("2024-02", 1)]
    single = Profile(_one(spark, days[:1], "date"), "v").date_stats().first()
    assert (single.missing_period_days, single.largest_gap_days) == (0, 0)
    none = Profile(_one(spark, [None], "date"), "v").date_stats().first()
    assert tuple(none) == (None, None, None, None)
    stamp = datetime.datetime(2024, 1, 1, 5, 0, 0, 500)
    text = Profile(_one(spark, [stamp], "timestamp_ntz"), "v").date_stats().first()
    assert text.min == "2024-01-01 05:00:00.000500"


def test_nested_and_binary_columns_are_text(spark):
    df = spark.sql(
        "SELECT array(id, 1) AS a, map('k', id) AS m, named_struct('x', id) AS s, "
        "CAST('ab' AS BINARY) AS b, INTERVAL '3' DAY AS i FROM range(4)"
    )
    facts = {r.column: r for r in overview(df).collect()}
    assert {r.type for r in facts.values()} == {"string"}
    assert (facts["a"].unique_count, facts["m"].unique_count, facts["b"].unique_count) == (4, 4, 1)
    for c in df.columns:
        assert Profile(df, c).string_stats().first().min_length > 0
        assert suggest_values(df, c).first()["count"] in (1, 4)
    assert len(_bars(df, "s")) == 4


def test_whole_profile_and_overview(spark, tides):
    row = profile(tides, "level").first()
    assert row.type == "float" and not row.sampled and row.total_rows == 52
    assert row.stats.distinct_count == 51 and sum(b["count"] for b in row.histogram) == 51
    names = profile(tides, "observer").first()
    assert [v["count"] for v in names.top_values] == sorted((v["count"] for v in names.top_values), reverse=True)
    assert names.pattern_classes[0].label == "free-text"
    assert profile(tides, "taken").first().histogram[0].label == "2023-01"
    assert profile(tides, "checked").first().stats.null_count == 1
    for r in schema_overview(tides).collect():
        assert r.total_count == 52 and len(r.sparkline) <= 8 and r.null_band == "normal"
        assert r.unique_count >= 2
    gaps = spark.sql("SELECT IF(id < 3, NULL, id) AS x, IF(id < 1, NULL, id) AS y FROM range(10)")
    assert [r.null_band for r in overview(gaps).orderBy("position").collect()] == ["error", "warning"]


def test_sampled_profile_is_one_sample(spark):
    df = spark.range(3000).selectExpr("id AS _rowid", "id AS v", "id % 7 AS w")
    p = Profile(df, "v", max_rows=500)
    assert p.sampled and p.universal().first().sample_size == 500
    assert p.numeric_stats().first().distinct_count == 500
    bars = sparklines(df, max_rows=100).groupBy("column").agg(F.sum("count").alias("n")).collect()
    assert {r.column: r.n for r in bars} == {"v": 100, "w": 100}


@pytest.mark.parametrize(
    "value, text",
    [
        (0.0, "0.0"),
        (-12.5, "-12.5"),
        (1e7, "10000000.0"),
        (123456789.25, "123456789.25"),
        (9007199254740993.0, "9007199254740992.0"),
        (1e16, "1e+16"),
        (1.5e300, "1.5e+300"),
        (0.001, "0.001"),
        (0.00012345678901234567, "0.00012345678901234567"),
        (1e-5, "1e-05"),
        (2.5e-10, "2.5e-10"),
        (float("nan"), "nan"),
        (float("-inf"), "-inf"),
    ],
)
def test_number_text(spark, value, text):
    df = _one(spark, [value], "double")
    assert df.select(display_text(F.col("v"), df.schema[0].dataType).alias("t")).first().t == text == repr(value)
